"""Names found by the automaton against a pattern for every name."""

import random
import re

from pyspark.sql import functions as F

from docketry.operators import names
from docketry.operators.filters import laws_cited

ROWS = "id long, body string, extra string"


def by_pattern(text, known):
    text = re.sub(r"\s+", "", text or "")
    return sorted({title for name, title in known.items() if re.search(r"(?:(?<=구)|(?<![가-힣]))" + re.escape(name), text)})


def table(spark, known):
    return spark.createDataFrame(list(known.items()), "name string, canonical string")


def test_names_overlap_follow_and_nest(spark):
    known = {"의료법": "의료법", "국민의료법": "국민의료법", "료법": "료법", "약사법": "약사법", "舊약사법": "약사법", "a": "A", "ab": "AB", "bab": "BAB", "abab": "ABAB"}
    texts = [
        "의료법", "국민의료법 제1조", "구 의료법", "구의료법", "신의료법", "「의료법」과 약사법", "舊약사법", "료법의료법", "xababab", "a", "", None, " 의 료\n법 ",
        "가" * 1022 + "(의료법)", "x" * 1023 + "의료법", "x" * 1021 + "의료법" + "y" * 3000 + "약사법", "bab" * 900, "구" * 40 + "약사법",
    ]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], ROWS)
    got = {r.id: r.cited for r in names.names_cited(rows, "body", table(spark, known)).collect()}
    assert got == {i: by_pattern(t, known) for i, t in enumerate(texts)}
    old = {r.id: r.c for r in rows.select("id", laws_cited(F.col("body"), [], known).alias("c")).collect()}
    assert got == old


def test_random_names_and_texts_in_pieces(spark):
    draw = random.Random(5)
    letters = "ab가나구 "
    known = {n: n.upper() for n in {"".join(draw.choice("ab가나구") for _ in range(draw.randint(1, 6))) for _ in range(60)}}
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 2500 if i % 10 == 0 else 60))) for i in range(120)]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], ROWS)
    want = {i: by_pattern(t, known) for i, t in enumerate(texts)}
    for limit in (1 << 20, 1500):
        got = names.names_cited(rows, "body", table(spark, known), "laws", limit)
        assert got.columns == ["id", "body", "extra", "laws"] and {r.id: r.laws for r in got.collect()} == want


def test_null_and_repeated_names_and_no_names(spark):
    rows = spark.createDataFrame([(1, "xx yy", None)], ROWS)
    some = spark.createDataFrame([(None, "n"), (" ", "n"), ("xx", None), ("yy", "two"), ("yy", "one")], "name string, canonical string")
    assert names.names_cited(rows, "body", some).first().cited == ["one"]
    assert names.names_cited(rows, "body", some.limit(0)).first().cited == []
    assert names.names_cited(rows.limit(0), "body", some).count() == 0
