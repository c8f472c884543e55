import math
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.operators import chunking, embedding, governance, joins, metering
from docketry.operators.dedup import keep_best_revision, keep_first, require_unique
from docketry.operators.fusion import law_first, rrf
from docketry.operators.lexical import build_index, bm25, bm25_top
from docketry.operators.ranking import nearest
from docketry.operators.sequences import _first_break, _next_start, changes, greedy_batches, running_total
from docketry.settings import Settings
from docketry.sources.markdown import ATTACHMENT_TYPE, ARTICLE_TYPE


# --- ranking ------------------------------------------------------------------

def test_nearest_matches_brute_force_with_ties_and_query_blocks(spark):
    rng = np.random.default_rng(3)
    vecs = np.round(rng.normal(size=(300, 4)), 1)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vector array<float>").repartition(5)
    queries = np.round(rng.normal(size=(7, 4)), 1)
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(queries)], "query_id string, vector array<double>")
    want = {}
    for i, v in enumerate(queries):
        scored = sorted(((-round(float(np.dot(v, np.float32(w).astype(float))), 6), j) for j, w in enumerate(vecs)))[:5]
        want[f"q{i}"] = [j for _, j in scored]
    for limit in (10**6, 100):  # one pass, and several bounded passes
        got = nearest(rows, q, 5, "id", block_bytes=limit).collect()
        for name, ids in want.items():
            assert [r.id for r in sorted((r for r in got if r.query_id == name), key=lambda r: r["rank"])] == ids


def test_fusion_keeps_dense_order_on_ties_and_puts_laws_first(spark):
    dense = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, id long, rank int")
    lexical = spark.createDataFrame([("q", 3, 1, "precedent"), ("q", 2, 2, "law"), ("q", 9, 3, "law")], "query_id string, id long, rank int, doc_type string")
    ordered = law_first(lexical, "query_id").orderBy("rank").collect()
    assert [r.id for r in ordered] == [2, 9, 3]
    fused = rrf(dense, law_first(lexical, "query_id"), "query_id", "id").orderBy("rank").collect()
    assert [r.id for r in fused] == [2, 9, 3, 1]
    assert fused[0].rrf == pytest.approx(1 / 62 + 2 / 61)


# --- lexical ------------------------------------------------------------------

def _bm25_by_hand(docs, query):
    toks = {k: ([w for w in re.split(r"\W+", t.lower()) if w], [w for w in re.split(r"\W+", b.lower()) if w]) for k, (t, b) in docs.items()}
    n = len(docs)
    avg = sum(len(t) + len(b) for t, b in toks.values()) / n
    scores = {}
    for prefix in query.lower().split():
        freq = {k: 5 * sum(w.startswith(prefix) for w in t) + sum(w.startswith(prefix) for w in b) for k, (t, b) in toks.items()}
        held = sum(f > 0 for f in freq.values())
        idf = math.log((n - held + 0.5) / (held + 0.5))
        idf = idf if idf > 0 else 1e-6
        for k, f in freq.items():
            if f:
                size = len(toks[k][0]) + len(toks[k][1])
                scores[k] = scores.get(k, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / avg))
    return scores


def test_bm25_matches_formula(spark):
    docs = {
        1: ("민법 제4조 성년", "사람은 19세로 성년에 이르게 된다"), 2: ("형법 제347조 사기", "사람을 기망하여 재물을 교부받은 자"),
        3: ("판례", "사기죄로 처벌한다 민법상 사기"), 4: ("도로교통법", "속도 제한"), 5: ("상법", "회사"),
    }
    rows = spark.createDataFrame([(k, t, b) for k, (t, b) in docs.items()], "id long, title string, body string")
    for text in ("사기 민법", "처벌 사람 사람", "없는말"):
        q = spark.createDataFrame([("q", text)], "query_id string, text string")
        got = {r.id: r.score for r in bm25(build_index(rows, "id", "title", "body"), q, "query_id", "text").collect()}
        want = _bm25_by_hand(docs, text)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_best_rows_by_words_move_no_pairs(spark):
    """Tasks rank their own rows for many queries at once, as the join of all pairs does; only their best rows are shuffled."""
    words = ["law", "lawful", "contract", "tenant", "rent", "court", "courtyard", "été", "법률", "법"]
    text = lambda i: " ".join(words[(i * k + k * k) % 10] for k in range(1, 3 + i % 9))
    rows = spark.createDataFrame([(i, words[i % 7] if i % 5 else None, text(i) if i % 11 else None) for i in range(700)], "id long, title string, body string")
    asked = [(q, f"{words[q % 10]} {words[q % 4][:3]} {words[q * 3 % 10]} zz{q % 2}") for q in range(150)] + [(150, ""), (151, "xyz")]
    queries = spark.createDataFrame(asked, "q int, ask string")
    index = build_index(rows, "id", "title", "body")
    best = bm25_top(index, queries, "q", "ask", 6)
    assert "hashpartitioning(id" not in best._jdf.queryExecution().toString()
    pairs = {}
    for r in bm25(index, queries, "q", "ask").collect():
        pairs.setdefault(r.q, []).append((-round(r.score, 6), r.id))
    want = [(q, n, i, -s) for q, found in pairs.items() for n, (s, i) in enumerate(sorted(found)[:6], 1)]
    assert sorted(map(tuple, best.collect())) == sorted(want)
    assert bm25_top(index, queries.where("q = 150"), "q", "ask", 6).collect() == []
    assert bm25_top(build_index(rows.limit(0), "id", "title", "body"), queries, "q", "ask", 6).collect() == []

# --- sequences ----------------------------------------------------------------

def _greedy(sizes, items, limit):
    out, batch, count, held = [], -1, 0, 0
    for s in sizes:
        if batch < 0 or count >= items or held + s > limit:
            batch, count, held = batch + 1, 0, 0
        out.append(batch)
        count, held = count + 1, held + s
    return out


@pytest.mark.parametrize("seed, items, limit, span", [(1, 5, 40, 16), (2, 3, 1000, 8), (3, 100, 25, 32), (4, 7, 9, 4), (5, 50, 500, 8)])
def test_greedy_batches_equal_a_sequential_run(spark, seed, items, limit, span):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 9, 60]) for _ in range(97)]
    order = sorted(rng.sample(range(400), 97))
    df = spark.createDataFrame(list(zip(order, sizes)), "pos long, size long").repartition(4)
    got = [r.batch_no for r in greedy_batches(df, "pos", "size", items, limit, span).orderBy("pos").collect()]
    assert got == _greedy(sizes, items, limit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 6), st.integers(1, 40))
def test_next_start_is_the_greedy_end(sizes, items, limit):
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    nxt = _next_start(prefix, items, limit)
    for i in range(len(sizes)):
        end, held = i + 1, sizes[i]
        while end < len(sizes) and end - i < items and held + sizes[end] <= limit:
            held += sizes[end]
            end += 1
        assert nxt[i] == end
    assert _first_break(prefix, items, 0, items, limit) == 0


def test_running_total_and_changes(spark):
    rng = random.Random(7)
    rows = [(i, "k" if i % 3 else "j", rng.randint(0, 9), rng.choice("ab")) for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, k string, v long, tag string")
    got = {r.pos: r.before for r in running_total(df, ["k"], F.floor(F.col("pos") / 7), ["pos"], "v").collect()}
    for pos, key, _, _ in rows:
        assert got[pos] == sum(v for p, k, v, _ in rows if k == key and p < pos)
    want = [p for n, (p, _, _, t) in enumerate(rows) if n == 0 or rows[n - 1][3] != t]
    assert [r.pos for r in changes(df, "pos", "tag", 8).orderBy("pos").collect()] == want


# --- dedup and joins ----------------------------------------------------------

def test_first_best_and_unique(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert {r.v for r in keep_first(df, "k", ["o"]).collect()} == {"y", "z"}
    with pytest.raises(ValueError):
        require_unique(df, "k")
    revisions = spark.createDataFrame(
        [("a", "제10호", "B", 5, 0), ("a", "9", "A", 99, 1), ("a", "10", "A", 1, 2), ("a", "10", "A", 1, 3), ("b", None, "A", 1, 4)],
        "k string, serial string, grade string, size int, o int",
    )
    best = {r.k: (r.o, r.first_seen) for r in keep_best_revision(revisions, "k", "serial", "grade", "size", "o").collect()}
    assert best == {"a": (2, 0), "b": (4, 4)}


def test_salted_join_with_one_dominant_key(spark):
    many = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    one_side = many.select("key").distinct().withColumn("v", F.length("key")).where("key <> 'k7'")
    plain = many.join(one_side, "key", "left").select("id", "v")
    salted = joins.salted_join(many, one_side, "key", "left", salts=4, spread_on=["id"]).select("id", "v")
    assert salted.exceptAll(plain).count() == 0 and salted.count() == 6000
    assert [r.key for r in joins.heavy_keys(many, "key", 0.2).collect()] == ["hot"]


def test_substring_matches_equal_nested_loop(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("가나다라") for _ in range(n))
    needles = sorted({word(rng.randint(1, 4)) for _ in range(25)})
    texts = [word(rng.randint(0, 12)) for _ in range(40)]
    a = spark.createDataFrame([(n,) for n in needles], "n string")
    b = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {(r.n, r.i) for r in joins.substring_matches(a, b, "n", "t", ["i"]).collect()}
    assert got == {(n, i) for n in needles for i, t in enumerate(texts) if n in t}


# --- chunking -----------------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 14), min_size=1, max_size=25), st.integers(2, 12), st.integers(0, 5))
def test_windows_cover_overlap_and_fit(sizes, target, overlap):
    limits = Settings(embed_max_tokens=20, window_tokens=target, overlap_tokens=overlap)
    texts = [" ".join([f"s{i}w{j}" for j in range(n - 1)] + [f"s{i}end."]) for i, n in enumerate(sizes)]
    every = " ".join(texts).split()
    place = {w: i for i, w in enumerate(every)}
    got = [w.split() for w in chunking.windows(" ".join(texts), 10, limits)]
    spans = [(place[w[0]], place[w[-1]]) for w in got]
    # Runs of the text in order, none beyond the room left by the header.
    assert all(w == every[a:b + 1] and len(w) <= 10 for w, (a, b) in zip(got, spans))
    assert {w for window in got for w in window} == set(every)
    assert spans == sorted(spans)
    firsts = {place[t.split()[0]] for t in texts}
    lasts = {place[t.split()[-1]] for t in texts}
    whole = [(a, b) for a, b in spans if a in firsts and b in lasts]
    # Windows of several sentences stay at the target, and no further sentence fits.
    for a, b in whole:
        inside = [len(t.split()) for t in texts if a <= place[t.split()[0]] <= b]
        assert len(inside) == 1 or sum(inside) <= min(target, 10)
        after = next((len(t.split()) for t in texts if place[t.split()[0]] == b + 1), None)
        assert after is None or sum(inside) + after > min(target, 10)
    # A window begins at most one sentence more than the overlap before the end of the last.
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b + 1


def _docs(spark, *rows):
    schema = (
        "doc_id string, doc_type string, title string, jurisdiction string, law_kind string, effective_from string, source_url string, "
        f"trust_grade string, articles array<{ARTICLE_TYPE}>, attachments {ATTACHMENT_TYPE}, authority string, case_no string, "
        "gov_level string, locality string, serial string, meta string, source_order int, position long"
    )
    base = dict(doc_id="LAW:1:법률", doc_type="law", title="가로수법", jurisdiction="국가", law_kind="법률", effective_from="2024-07-03",
                source_url=None, trust_grade="A", articles=[], attachments=[], authority="산림청", case_no=None, gov_level=None,
                locality=None, serial=None, meta=None, source_order=0, position=0)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schema)


def _article(no, text, title=None, chapter=None):
    return (no, title, text, chapter, None, None)


def test_chunk_headers_kinds_and_repeats(spark):
    docs = _docs(
        spark,
        dict(articles=[_article("제1조", "① 목적 <개정 2020.1.1>", "목적", "제1장 총칙"), _article("제2조", "  "), _article("제1조", "되풀이"), _article("제3조", "셋")],
             attachments=[("1", "02", "별표", "과태료", "link", None), (None, None, None, None, None, None)]),
        dict(doc_id="PREC:7", doc_type="precedent", title="손해배상", jurisdiction="대법원", law_kind="민사", effective_from=None, authority=None,
             case_no="2019다1", articles=[_article("판결요지", "요지")]),
        dict(doc_id="ORD:서울:3", doc_type="ordinance", title="공원 조례", law_kind="조례", trust_grade="B", jurisdiction="서울", authority=None, gov_level="기초", locality="강남구"),
    )
    got = {r.chunk_id: r for r in chunking.chunk(docs).collect()}
    assert set(got) == {"LAW:1:법률#제1조#0", "LAW:1:법률#제3조#0", "LAW:1:법률#별표1-02#0", "LAW:1:법률#별표1#0", "PREC:7#판결요지#0", "ORD:서울:3#메타#0"}
    first = got["LAW:1:법률#제1조#0"]
    assert first.text == ("[법령] 가로수법 > 제1장 총칙 > 제1조(목적) · 시행 2024-07-03 · 소관 산림청\n"
                          "이 조문은 '가로수법'(법률, 소관 산림청) 법령의 일부로, '목적'에 관한 사항을 규정한다.\n(1) 목적")
    assert first.payload.amendments == ["<개정 2020.1.1>"] and first.payload.kind == "본문" and first.payload.part_idx == 0
    table = got["LAW:1:법률#별표1-02#0"].payload
    assert (table.kind, table.trust_grade, table.article_title, table.attachment_link) == ("별표", "B", "과태료", "link")
    assert got["PREC:7#판결요지#0"].text.startswith("[판례] 대법원 2019다1 · 민사 · 판결요지\n이 판례 섹션은 대법원 '2019다1'(민사) 판결의 '판결요지'이다.\n")
    meta = got["ORD:서울:3#메타#0"]
    assert meta.payload.kind == "메타" and meta.payload.gov_level == "기초" and meta.payload.locality == "강남구"
    assert "지자체 서울 (기초)" in meta.text.split("\n")[0]
    parent = {r.parent_id: r.full_text for r in chunking.parents(docs).collect()}
    assert parent["LAW:1:법률"] == "제1조(목적)\n① 목적 <개정 2020.1.1>\n\n제1조\n되풀이\n\n제3조\n셋" and parent["ORD:서울:3"] == ""
    sound = governance.validate(chunking.chunk(docs)).where("size(errors) > 0").select("chunk_id", "errors").collect()
    assert [(r.chunk_id, r.errors) for r in sound] == []


def test_long_articles_become_numbered_windows_within_the_limit(spark):
    limits = Settings(embed_max_tokens=60, window_tokens=20, overlap_tokens=5)
    body = " ".join(f"낱말{i}{'.' if i % 7 == 6 else ''}" for i in range(200))
    rows = chunking.chunk(_docs(spark, dict(articles=[_article("제1조", body), _article("제2조", "짧다")])), limits).collect()
    parts = sorted(r.payload.part_idx for r in rows if "#제1조#" in r.chunk_id)
    assert len(parts) > 5 and parts == list(range(len(parts)))
    assert all(r.n_tokens <= 60 and r.n_tokens == len(r.text.split()) for r in rows)


# --- embedding and metering ---------------------------------------------------

def test_embedding_once_per_text_and_fan_out(spark):
    chunks = spark.createDataFrame([("a", "x y", "h1", 0), ("b", "x y", "h1", 1), ("c", "z", "h2", 2)], "chunk_id string, text string, content_hash string, position long")
    cache = spark.createDataFrame([(0, "h2", [0.0] * 8), (1, "h2", [1.0] * 8), (2, "h2", [5.0] * 7)], "seq long, content_hash string, vector array<float>")
    known = embedding.valid_cache(cache, 8)
    assert known.first().vector == [1.0] * 8
    todo = embedding.missing(chunks, known)
    assert [(r.content_hash, r.n_members) for r in todo.collect()] == [("h1", 2)]
    vectors = embedding.fan_out(chunks, embedding.embed(todo, embedding.hashing_embedder(8), 8).unionByName(known))
    got = {r.chunk_id: r.vector for r in vectors.collect()}
    assert got["a"] == got["b"] and got["c"] == [1.0] * 8 and len(got) == 3
    with pytest.raises(Exception):
        embedding.embed(spark.createDataFrame([("h", " ")], "content_hash string, text string"), embedding.hashing_embedder(8), 8).collect()


def test_cost_gate(spark):
    with pytest.raises(PermissionError):
        embedding.check_cost({"n_unique_misses": 3}, confirm=False)
    embedding.check_cost({"n_unique_misses": 3}, confirm=True)
    embedding.check_cost({"n_unique_misses": 0}, confirm=False)


def test_keys(spark):
    raw = metering.KEY_PREFIX + "abc"
    digest = hashlib.sha256(raw.encode()).hexdigest()
    rows = [(digest, digest[:12], "사무소", "pro", 60, 0, 0, 0, "2024-01-01"), ("0" * 64, "z" * 12, "b", "free", 10, 0, 0, 0, "2024-01-02")]
    keys = spark.createDataFrame(rows, metering.KEY_SCHEMA)
    seen = metering.authenticate(spark.createDataFrame([(raw,), ("lk_x",), ("sk_" + raw,)], "raw_key string"), keys).collect()
    assert [r.tenant for r in seen if r.raw_key == raw] == ["사무소"] and sum(r.tenant is None for r in seen) == 2
    assert metering.revoke(keys, digest[:9]).where("revoked = 1").select("key_id").collect()[0][0] == digest[:12]
    assert metering.revoke(keys, "").where("revoked = 1").count() == 0
