import json
import time

import pytest
from pyspark.sql import functions as F

from docketry.operators import evaluation, verification
from docketry.plans import answer, review, source_pack
from docketry.plans.corpus import build_chunks, embed_chunks, parse_corpora, pick_cases, pick_rules, pick_statutes, require_folders, search_table
from docketry.plans.search import Corpus, article_lookup, case_lookup, search, statutes_page
from docketry.operators.embedding import hashing_embedder
from docketry.settings import Settings
from docketry.sources import records
from docketry.streaming import jobs
from test_parsers import STATUTE_HEAD, case, files, head, ordinance, rule

ROWS = "vector array<float>, chunk_id string, doc_id string, parent_id string, doc_type string, jurisdiction string, law_kind string, effective_from string, title string, article_no string, text string, trust_grade string, source_url string, license string, heading string"


def _row(axis, cid, doc_type, date, parent="-", title="가로수법", text="본문", grade="A", score=1.0):
    vec = [0.0] * 4
    vec[axis] = score
    if score < 1:
        vec[3] = (1 - score * score) ** 0.5
    pid = cid.split("#")[0] if parent == "-" else parent
    return (vec, cid, pid, pid, doc_type, "국가", "법률", date, title, cid.split("#")[1], text, grade, "https://e/" + cid, None, title)


@pytest.fixture
def small(spark):
    rows = [
        _row(0, "LAW:1:법률#제1조#0", "law", "2013-01-01", parent=None), _row(1, "ORD:서울:2#제1조#0", "ordinance", "2022-01-01"),
        _row(2, "PREC:3#판결요지#0", "precedent", "2020-01-01"), _row(0, "LAW:4:법률#제2조#0", "law", "2030-01-01", score=0.9),
    ]
    return Corpus(spark.createDataFrame(rows, ROWS))


@pytest.fixture
def axis0(spark):
    return spark.createDataFrame([("q", "질문", [2.0, 0.0, 0.0, 0.0])], "query_id string, text string, vector array<double>")


def ids(hits):
    return [r.chunk_id for r in hits.orderBy("rank").collect()]


def test_search_filters_dates_and_errors(small, axis0, spark):
    assert ids(search(small, axis0, 2)) == ["LAW:1:법률#제1조#0", "LAW:4:법률#제2조#0"]
    assert ids(search(small, axis0, 8, {"doc_type": ["precedent", "ordinance"]})) == ["ORD:서울:2#제1조#0", "PREC:3#판결요지#0"]
    assert "LAW:4:법률#제2조#0" not in ids(search(small, axis0, 8, as_of="2025-01-01"))
    assert ids(search(small, axis0, 8, as_of="2000-01-01")) == []
    with pytest.raises(ValueError):
        search(small, axis0, 8, {"title": "x"})
    with pytest.raises(Exception, match="blank"):
        search(small, axis0.withColumn("text", F.lit("  ")), 2).collect()


def test_overfetch_finds_what_exact_finds(small, axis0):
    """Queries that the first candidates leave short are answered by an exact pass."""
    narrow = Settings(overfetch=1)
    for where in ({"doc_type": "precedent"}, {"doc_type": ["law", "ordinance"]}, {"doc_type": "none"}):
        for k in (1, 3):
            assert ids(search(small, axis0, k, where, mode="overfetch", settings=narrow)) == ids(search(small, axis0, k, where))


def test_hybrid_orders_by_fusion_but_reports_the_dense_score(small, axis0):
    query = axis0.withColumn("text", F.lit("판결법 제1조"))
    hits = search(Corpus(small.rows.withColumn("text", F.when(F.col("doc_type") == "precedent", "판결법 판결법").otherwise("무관")), "chunk_id", "heading", "text"),
                  query, 4, hybrid=True)
    rows = hits.orderBy("rank").collect()
    assert rows[0].chunk_id == "PREC:3#판결요지#0" and rows[0].score == 0.0 and rows[1].score == 1.0
    paged = statutes_page(hits, 2, 0).orderBy("position").collect()
    assert [r.score for r in paged] == [1.0, 0.9]  # the page is sorted by score again


def test_pages_are_disjoint_and_complete(small, axis0):
    hits = search(small, axis0, 4)
    pages = [[r.doc_id for r in statutes_page(hits, 2, o).orderBy("position").collect()] for o in (0, 2, 4)]
    assert [len(p) for p in pages] == [2, 2, 0] and len(set(pages[0] + pages[1])) == 4
    assert statutes_page(hits, 4).select("license").distinct().count() == 1
    with pytest.raises(ValueError):
        statutes_page(hits, 2, -1)


def test_statutes_are_backfilled_only_when_missing(spark, axis0):
    rows = [_row(0, f"PREC:{i}#요지#0", "precedent", "2020-01-01", score=0.95 - i / 100) for i in range(4)]
    rows += [_row(1, f"LAW:{i}:법률#제1조#0", "law", "2020-01-01") for i in range(5)]
    corpus = Corpus(spark.createDataFrame(rows, ROWS))
    hits = search(corpus, axis0, 3)
    full = answer.ensure_statutes(corpus, axis0, hits).orderBy("rank").collect()
    assert [r.doc_type for r in full] == ["precedent"] * 3 + ["law"] * 3 and [r["rank"] for r in full] == [1, 2, 3, 4, 5, 6]
    assert answer.ensure_statutes(corpus, axis0, hits, {"doc_type": "precedent"}).count() == 3
    assert answer.ensure_statutes(corpus, axis0, hits.limit(0)).count() == 0


def test_gate_context_and_citations(small, axis0, spark):
    hits = search(small, axis0, 3)
    both = axis0.unionByName(axis0.withColumn("query_id", F.lit("empty")))
    assert {r.query_id: r.decision for r in answer.gate(both, hits).collect()} == {"q": "answer", "empty": "no_hits"}
    assert answer.gate(axis0, hits, 1.1).first().decision == "low_score"
    text = answer.contexts(hits).first().context
    assert text.startswith("[1] id=LAW:1:법률#제1조#0 | 종류=law | 제목=가로수법 | 위치=제1조 | 등급=A | 출처=") and text.count("\n\n[") == 2
    cites = spark.createDataFrame(
        [("q", 0, "nope", None), ("q", 1, None, None), ("q", 2, "LAW:4:법률#제2조#0", " 제2조 제1항 "), ("q", 3, "LAW:4:법률#제2조#0", "다시"), ("q", 4, "LAW:1:법률#제1조#0", "")],
        "query_id string, ordinal int, source_id string, location string")
    checked = answer.check_citations(cites, hits, "2024-01-01").orderBy("ordinal").collect()
    assert [(r.source_id, r.location, r.status, r.trust_flag) for r in checked] == [
        ("LAW:4:법률#제2조#0", "제2조 제1항", "시행예정", "green"), ("LAW:1:법률#제1조#0", "제1조", "현행", "green")]
    answers = spark.createDataFrame([("q", "가 [2] 나 [9] 다 [1][2] [0]")], "query_id string, answer string")
    assert [r.source_id for r in answer.cited_blocks(answers, hits).orderBy("ordinal").collect()] == ["LAW:4:법률#제2조#0", "LAW:1:법률#제1조#0"]


def test_trust_is_rounded_half_to_even(spark):
    flags = [("q", "green")] + [("q", "yellow")] * 15  # mean 62.5
    checked = spark.createDataFrame(flags, "query_id string, trust_flag string")
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert {r.query_id: r.trust_score for r in answer.trust_score(asked, checked).collect()} == {"q": 62, "none": 0}


def test_source_pack_keeps_undated_rows_and_falls_back_to_child_text(spark):
    rows = [
        ("q", 1, "LAW:1#제1조#0", 0.9, "LAW:1", "LAW:1", "law", "법", "제1조", "2013-01-01", "하나", "A"), ("q", 2, "LAW:1#제2조#0", 0.8, "LAW:1", "LAW:1", "law", "법", "제2조", None, "둘", "A"),
        ("q", 3, "PREC:2#요지#0", 0.7, None, None, "precedent", "사건", "요지", None, "요지", "B"), ("q", 4, "LAW:9#제1조#0", 0.6, "LAW:9", "LAW:9", "law", "새법", "제1조", "2030-01-01", "미래", "A"),
    ]
    hits = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, score double, parent_id string, doc_id string, doc_type string, title string, article_no string, effective_from string, text string, trust_grade string") \
        .withColumns({c: F.lit(None).cast("string") for c in ("law_kind", "jurisdiction", "source_url", "license")})
    parents = hits.where("parent_id = 'LAW:1'").limit(1).select("parent_id", "doc_type", "title", "law_kind", "jurisdiction", "trust_grade", "source_url", "license", "effective_from", F.lit("전체 본문").alias("full_text"))
    packed = source_pack.sources(source_pack.promote(hits, "2024-01-01"), parents, "2024-01-01")
    got = {r.doc_id: r for r in packed.collect()}
    assert set(got) == {"LAW:1", "PREC:2"} and got["LAW:1"].full_text == "전체 본문" and got["LAW:1"].text_origin == "parent"
    assert got["PREC:2"].text_origin == "child" and got["PREC:2"].full_text == "요지" and got["PREC:2"].license
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    text = {r.query_id: r.markdown for r in source_pack.bundle(asked, packed).collect()}
    assert "## [1] 법령 · 법 · 제1조" in text["q"] and "> 전체 본문" in text["q"] and "본문 없음(B등급)" in text["q"]
    assert text["none"] == source_pack.NOTHING_FOUND


def _registry(spark):
    laws = spark.createDataFrame([("민법", "연혁", "1", "20000101", "/a?OC=k", 0), ("민법", "현행", "2", "20240101", "/b?OC=k&x=1", 1), ("형법 시행령", "현행", "3", "20200101", "/c", 2)],
                                 "law_name string, status string, serial string, effective string, link string, position int")
    articles = spark.createDataFrame([("2", "4", "20230101"), ("2", "4의2", None)], "serial string, article_no string, effective string")
    cases = spark.createDataFrame([("2022도1401", "2022.05.06", "/p?OC=k&i=1", 0), ("2024도10062", "2024.01.01", "/p2", 1)], "case_no string, decided string, link string, position int")
    return laws, articles, cases


def test_verification_verdicts(spark):
    cites = spark.createDataFrame([
        (0, None, "민법", "제4조"), (1, None, "민법", "제999조"), (2, None, "없는법", None), (3, "2022 도 1401", None, None), (4, "2022도1402", None, None),
        (5, None, None, "제1조"), (6, None, "형법", None), (7, None, "민법", "제4조의2"), (8, None, "민법", None),
    ], "citation_id int, case_no string, law_name string, article_no string")
    parents = spark.createDataFrame([
        ("P1", "민법", 0, "A", "제4조(성년)\n제4조의2\n", "https://e/1", "2013-01-01", None), ("P2", "민법", 1, "B", "", None, None, None),
        ("P3", "사건", 2, "B", "", None, "2022-05-06", "2022도1401"), ("P4", "형법", 3, "A", "제1조", None, None, None),
    ], "parent_id string, title string, position int, trust_grade string, full_text string, source_url string, effective_from string, case_no string")
    c = verification.classify(cites)
    found = verification.in_corpus(c, parents)
    got = {r.citation_id: r for r in verification.verdict(c, found, verification.in_registry(c, *_registry(spark))).collect()}
    assert len(got) == 9
    assert (got[0].verified, got[0].trust_score, got[0].flag, got[0].effective_from, got[0].location) == (True, 100, "green", "2023-01-01", "제4조")
    assert got[0].source_url == "https://www.law.go.kr/b?x=1"
    assert (got[1].verified, got[1].trust_score, got[1].flag, got[1].api_match, got[1].db_match) == (False, 0, "red", False, False)
    assert got[2].api_match is False and got[2].flag == "red"
    assert (got[3].verified, got[3].trust_score, got[3].trust_grade, got[3].effective_from) == (True, 95, "B", "2022-05-06")
    assert got[4].api_match is False and not got[4].verified
    assert (got[5].kind, got[5].verified, got[5].api_match, got[5].trust_score) == ("malformed", False, None, None)
    assert got[6].api_match is True  # found through a longer registry title
    assert got[7].verified and got[8].verified
    off = {r.citation_id: r for r in verification.verdict(c, found, None, "2010-01-01").collect()}
    assert off[0].api_match is None and off[0].verified is False and off[0].trust_score == 15
    assert off[6].verified is True and off[6].trust_score == 70 and off[6].flag == "yellow"


def test_scorecard(spark):
    golden = spark.createDataFrame([("a", "law", ["민법"], ["성년"], "제4조"), ("b", None, [], [], None), ("c", "law", [], [], "제1조")],
                                   "query_id string, expect_doc_type string, expect_title array<string>, expect_keywords array<string>, expect_article string")
    results = spark.createDataFrame([("a", 1, "law", "형법", "성년", "제4조"), ("a", 2, "law", "민법", "성년은 19세", "제3조"), ("b", 1, None, None, None, None)],
                                    "query_id string, rank int, doc_type string, title string, text string, article_no string")
    scored = evaluation.score_questions(golden, results)
    got = {r.query_id: (r.n_rows, r["rank"], r.hit, r.article_hit) for r in scored.collect()}
    assert got == {"a": (2, 2, True, True), "b": (1, 1, True, None), "c": (0, None, False, False)}
    card = evaluation.scorecard(scored).first()
    assert card.hit_at_k == pytest.approx(2 / 3) and card.mrr == pytest.approx(0.5) and card.article_hit == 0.5 and card.grounding is None
    # A question whose answer step failed counts in no retrieval figure either.
    assert evaluation.scorecard(scored.withColumn("error", F.when(F.col("query_id") == "c", "ask: x"))).first().n == 2
    answers = spark.createDataFrame([("a", "확인 필요"), ("b", "그냥"), ("c", "근거")], "query_id string, answer string")
    cites = spark.createDataFrame([("b", "s1"), ("b", "zz")], "query_id string, source_id string")
    shown = spark.createDataFrame([("b", "s1")], "query_id string, source_id string")
    audit = {r.query_id: (r.n_citations, r.citation_ok, r.grounded) for r in evaluation.score_answers(answers, cites, shown).collect()}
    assert audit == {"a": (0, True, True), "b": (2, False, True), "c": (0, True, False)}


def test_review_rules(spark):
    issues = spark.createDataFrame([("r", 0, " 최초 ", "위반", "high"), ("r", 1, "최초", "주의", "x"), ("r", 2, "가", "위반", "low"), ("r", 3, "없는 말", "위반소지", "none"), ("r", 4, "효능 100%", "??", "high")],
                                   "review_id string, issue_no int, claim string, verdict string, severity string")
    clean = review.coerce_issues(issues)
    assert {(r.issue_no, r.verdict, r.severity) for r in clean.where("issue_no in (1, 4)").collect()} == {(1, "주의", "none"), (4, "확인필요", "high")}
    text = spark.createDataFrame([("r", "국내 최초라는 말 100%")], "review_id string, corrected_copy string")
    assert [r.issue_no for r in review.unresolved(clean, text).collect()] == [0]  # short wordings are tested too
    longer = clean.withColumn("claim", F.when(F.col("issue_no") == 0, "국내 최초").otherwise(F.col("claim")))
    assert [r.issue_no for r in review.unresolved(longer, text).collect()] == [0]
    cites = spark.createDataFrame([("i", n, n, "법", "law" if n < 15 else "precedent", "제1조", "https://e", "A") for n in range(16)],
                                  "issue_id string, ordinal int, citation_id int, title string, doc_type string, location string, source_url string, trust_grade string")
    audits = spark.createDataFrame([(n, n != 0, True, "https://r" if n == 1 else None) for n in range(16)], "citation_id int, api_match boolean, current boolean, source_url string")
    got = {r.ordinal: r for r in review.annotate(cites, audits).collect()}
    assert got[0].trust_grade == "B" and got[1].source_url == "https://r" and got[11].api_verified is True
    assert all(got[n].api_verified is True for n in range(1, 15)) and got[15].api_verified is None  # all statutes, no cases


def test_corpus_build_from_files_to_search(spark):
    corpora = {
        "law": files(spark, ("/l/가로수법/법률.md", STATUTE_HEAD + "##### 제1조 (목적)\n나무를 심는다.\n"), ("/l/가로수법/사본.md", STATUTE_HEAD + "##### 제9조\n사본\n"), ("/l/x.md", "머리 없음")),
        "admrule": files(spark, rule(spark, "제1조(목적) 점검한다"), rule(spark, "", "/r/b/본문.md", 행정규칙ID=6)),
        "precedent": files(spark, case(spark, "## 참조조문\n가로수법 제1조\n## 판결요지\n나무")),
    }
    docs, rejects = parse_corpora(corpora)
    assert [r.path for r in rejects.collect()] == ["/l/x.md"]
    limits = Settings(embed_dim=16)
    chunks, parents = build_chunks(docs, limits)
    assert {r.chunk_id for r in chunks.collect()} == {"LAW:011463:법률#제1조#0", "ADMRULE:5#제1조#0", "ADMRULE:6#메타#0", "PREC:42#참조조문#0", "PREC:42#판결요지#0"}
    assert parents.count() == 4
    cache = spark.createDataFrame([], "seq long, content_hash string, vector array<float>")
    vectors, fresh = embed_chunks(chunks, cache, hashing_embedder(16), limits)
    assert vectors.count() == 5 and fresh.count() == 5
    table = search_table(chunks, vectors, limits)
    assert table.rows.count() == 4  # the metadata-only rule is not indexed
    query = spark.createDataFrame([("q", "나무를", [float(x) for x in hashing_embedder(16)(["나무를"])[0]])], "query_id string, text string, vector array<double>")
    assert search(table, query, 1).first().doc_type in ("law", "admrule", "precedent")
    law = article_lookup(docs, "011463", "1").where("article_title = '목적'").first()
    assert law.text == "나무를 심는다."
    assert case_lookup(docs, "42").first().case_no == "2019다1"


def test_sub_corpus(spark):
    laws = files(spark, ("/l/의료법/법률.md", STATUTE_HEAD + "##### 제1조\n본문\n"), ("/l/의료법/시행령.md", "머리 없음"), ("/l/도로법/법률.md", STATUTE_HEAD))
    kept, audit = pick_statutes(laws, ["의료법"], ["법률"])
    assert kept.count() == 1 and [(r.scope, r.item, r.rule_or_kind) for r in audit.collect()] == [("의료법", "법률.md", "법률")]
    with pytest.raises(FileNotFoundError, match="약사법"):
        require_folders(laws, ["의료법", "약사법"])
    rules = files(spark, rule(spark, "제1조(목적) 가나다", "/r/의료 고시/본문.md"), rule(spark, "제1조(목적) 더 긴 본문이다", "/r/의료 고시 2/본문.md"), rule(spark, "제1조(목적) 가나다", "/r/수의 의료/본문.md", 행정규칙ID=8))
    best, audit, dropped = pick_rules(rules, ["의료"], ["수의"])
    assert [r.path for r in best.collect()] == ["/r/의료 고시 2/본문.md"] and dropped.count() == 1
    assert ("수의 의료", "deny", "수의") in {(r.scope, r.rule_or_kind, r.matched_term) for r in audit.collect()}
    docs, _ = parse_corpora({"precedent": files(spark, case(spark, "## 참조조문\n구 의료법 제1조"), case(spark, "## 참조조문\n국민의료법", 판례일련번호=43), case(spark, "## 판결요지\n의료법", 판례일련번호=44))})
    assert [(r.doc_id, r.matched_term) for r in pick_cases(docs, "참조조문", ["의료법"]).collect()] == [("PREC:42", ["의료법"])]


def test_json_modes(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n', encoding="utf-8")
    assert sorted(r.a for r in records.read_lenient(spark, str(path), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):
        records.read_strict(spark, str(path), "a int").collect()
    counted = records.read_counting(spark, str(path), "a int").cache()
    assert counted.where("_corrupt_record is not null").count() == 1
    records.write_json(spark.createDataFrame([("가", None)], "k string, v string"), str(tmp_path / "out"))
    lines = [x for part in (tmp_path / "out").glob("part-*") for x in part.read_text(encoding="utf-8").splitlines()]
    assert [json.loads(x) for x in lines] == [{"k": "가", "v": None}]


def test_streams_keep_late_rows_out_and_retries_single(spark, tmp_path):
    root = str(tmp_path / "log")
    stamp = lambda t: f"2024-01-01 {t}"
    rows = lambda items: spark.createDataFrame([(u, t, n) for u, t, n in items], "user_id long, s string, tokens long").select("user_id", F.to_timestamp("s").alias("ts"), "tokens")
    batches = (
        [(1, stamp("00:00:01"), 5), (1, stamp("00:00:59"), 5)], [(1, stamp("00:00:30"), 1), (2, stamp("00:09:10"), 1)],
        [(2, stamp("00:09:50"), 1)], [(1, stamp("00:00:40"), 1), (2, stamp("00:09:55"), 1)],
    )
    for items in batches:  # one file each; the last batch holds a row that is nine minutes late
        rows(items).coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)  # files are taken in order of their time
    stream = spark.readStream.schema("user_id long, ts timestamp, tokens long").option("maxFilesPerTrigger", 1).parquet(root)
    log = jobs.timed(stream, "ts", "1 minute")
    table = jobs.run_to_table(jobs.rate_windows(log, "user_id", "ts", F.lit(1)), "t", ["user_id", "minute"])
    got = {(r.user_id, str(r.minute)): (r.requests, r.rejected) for r in table.collect()}
    assert got == {(1, "2024-01-01 00:00:00"): (3, 2), (2, "2024-01-01 00:09:00"): (3, 2)}
    out, state = str(tmp_path / "vec"), str(tmp_path / "state")
    spark.createDataFrame([("a", "x", "h1"), ("b", "x", "h1")], "chunk_id string, text string, content_hash string").write.parquet(str(tmp_path / "c1"))
    source = lambda: jobs.file_stream(spark, str(tmp_path / "c1"), "*.parquet")
    jobs.embed_incrementally(source(), out, hashing_embedder(4), state, 4).awaitTermination()
    spark.createDataFrame([("c", "x", "h1"), ("d", "y", "h2")], "chunk_id string, text string, content_hash string").write.mode("append").parquet(str(tmp_path / "c1"))
    jobs.embed_incrementally(source(), out, hashing_embedder(4), state, 4).awaitTermination()
    assert sorted(r.content_hash for r in jobs.existing_vectors(spark, out).collect()) == ["h1", "h2"]


def test_wanted_documents_are_the_documents_wanted(spark, tmp_path):
    """Choosing documents before any row is moved gives the rows that choosing them afterwards does."""
    from docketry.catalog.data import documents

    docs = [(k, f"line {k}\n\nmore", "de", f"src{k % 3}", 12) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    wanted = spark.createDataFrame([(3,), (4,), (77,)], "doc_id long")
    some = documents(spark, str(tmp_path), wanted)
    every = documents(spark, str(tmp_path)).where("position in (3, 4)")
    assert sorted(map(repr, some.collect())) == sorted(map(repr, every.collect()))
    assert some.count() == 2
