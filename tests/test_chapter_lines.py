"""Parser queries give articles without the chapter headings that follow them."""

import hashlib

from docketry.catalog import load_all


def hashes(spark, tmp_path, query, lines):
    rows = [(3, "\n".join(lines), "en", "src1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return {r.article_no: r.text_hash for r in load_all()[query].run(spark, str(tmp_path)).collect()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_statute_articles_end_before_the_next_heading(spark, tmp_path):
    lines = [f"line {i}" for i in range(14)]
    lines[5] = ""  # only a chapter heading follows: no article
    got = hashes(spark, tmp_path, "parse_statutes", lines)
    assert got == {f"제{i + 1}조" + ("의2" if i % 4 == 3 else ""): digest(f"line {i}") for i in range(14) if i != 5}


def test_rule_articles_end_before_the_next_chapter_line(spark, tmp_path):
    lines = [f"line {i}" for i in range(9)]
    lines[3] = ""  # only a chapter line follows: the title stands in for the text
    got = hashes(spark, tmp_path, "parse_rules", lines)
    assert sorted(got.values()) == sorted(digest(f"line {i}" if i != 3 else "조4") for i in range(9))
