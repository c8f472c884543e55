"""What becomes of every file of a sub-corpus."""

from pyspark.sql import functions as F

from docketry.plans.corpus import pick_cases
from docketry.plans.sub_corpus import listed, rules_sub_corpus


def rule(ident, serial, text="제1조(목적) 본문"):
    return f"---\n행정규칙ID: {ident}\n행정규칙명: 고시\n행정규칙일련번호: {serial}\n---\n{text}"


def test_every_file_has_one_outcome(spark):
    files = [
        ("/r/의료 고시/본문.md", rule("a", 1)), ("/x/의료 고시/본문.md", rule("a", 2)), ("/r/수의 의료/본문.md", rule("b", 1)), ("/r/도로/본문.md", rule("c", 1)),
        ("/r/의료 규정/본문.md", "머리 없음"), ("/r/약사/본문.md", rule("d", 1)),
    ]
    out = rules_sub_corpus(spark.createDataFrame(files, "path string, content string"), ["의료", "약사"], ["수의"])
    got = {r.path: (r.outcome, r.term) for r in out.files.collect()}
    assert got == {
        "/r/의료 고시/본문.md": ("dropped", "의료"), "/x/의료 고시/본문.md": ("kept", "의료"), "/r/수의 의료/본문.md": ("denied", "수의"),
        "/r/도로/본문.md": ("skipped", None), "/r/의료 규정/본문.md": ("rejected", "no readable head"), "/r/약사/본문.md": ("kept", "약사"),
    }
    assert out.counts == {"kept": 2, "dropped": 1, "denied": 1, "rejected": 1, "skipped": 1}
    assert sorted((r.doc_id, r.serial) for r in out.docs.collect()) == [("ADMRULE:a", "2"), ("ADMRULE:d", "1")]


def test_lists_and_no_files(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("# head\n의료 \n\n약사 # note\n 수의\n")
    assert listed(spark.read.text(str(tmp_path / "terms.txt"))) == ["의료", "약사", "수의"]
    none = rules_sub_corpus(spark.createDataFrame([], "path string, content string"), ["의료"], [])
    assert none.docs.count() == none.files.count() == 0 and set(none.counts.values()) == {0}


def test_cases_by_a_table_of_names(spark):
    docs = spark.createDataFrame(
        [("P:1", "의료법 제1조"), ("P:2", "국민의료법 제2조"), ("P:3", "구 의료법, 약사법")], "doc_id string, ref string",
    ).select("doc_id", F.array(F.struct(F.lit("참조조문").alias("article_no"), F.col("ref").alias("text"))).alias("articles"))
    names = spark.createDataFrame([("의료법", "의료법"), ("약사법", "약사법")], "name string, canonical string")
    got = {r.doc_id: r.matched_term for r in pick_cases(docs, "참조조문", names).collect()}
    assert got == {r.doc_id: r.matched_term for r in pick_cases(docs, "참조조문", ["의료법", "약사법"]).collect()} == {"P:1": ["의료법"], "P:3": ["약사법", "의료법"]}
