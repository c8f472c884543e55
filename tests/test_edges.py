"""Rows that used to be lost or misread: null keys, odd vectors, repeated keys."""

import time

import pytest
from pyspark.sql import functions as F

from docketry.operators import joins, ranking
from docketry.operators.dedup import keep_best_revision, one_per_hash
from docketry.operators.sequences import running_total

VECTORS = "id int, vector array<double>"
QUERY = "query_id int, vector array<double>"


@pytest.mark.parametrize("bad,what", [([1.0], "1 elements"), ([1.0, 2.0, 3.0], "3 elements"), ([1.0, float("nan")], "not finite"), ([1.0, None], "not finite")])
def test_odd_vectors_fail_and_name_the_row(spark, bad, what):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (77, bad), (3, [0.0, 1.0]), (4, None)], VECTORS)
    query = spark.createDataFrame([(0, [1.0, 1.0])], QUERY)
    with pytest.raises(Exception, match=f"77.*{what}"):
        ranking.nearest(rows, query, 2, "id").collect()
    with pytest.raises(Exception, match="query 0"):
        ranking.nearest(rows.where("id = 1"), spark.createDataFrame([(0, [float("inf"), 1.0])], QUERY), 2, "id").collect()


def test_ranking_over_many_batches_equals_sorting(spark):
    rows = spark.range(5000).select(F.col("id").cast("int"), F.array(F.pmod("id", F.lit(7)).cast("double"), F.pmod("id", F.lit(5)).cast("double")).alias("vector"))
    query = spark.createDataFrame([(0, [1.0, 0.5]), (1, [-1.0, 1.0])], QUERY)
    got = [(r.query_id, r.rank, r.id) for r in ranking.nearest(rows, query, 9, "id").orderBy("query_id", "rank").collect()]
    want = []
    for q, (x, y) in ((0, (1.0, 0.5)), (1, (-1.0, 1.0))):
        best = sorted(range(5000), key=lambda i: (-(i % 7 * x + i % 5 * y), i))[:9]
        want += [(q, n + 1, i) for n, i in enumerate(best)]
    assert got == want


def test_pages_honour_their_size(spark):
    rows = spark.range(300).select(F.lit("q").alias("query_id"), F.col("id").alias("doc_id"), F.col("id").alias("score"))
    assert ranking.page(rows, 250, 10, by=["query_id"]).count() == 250
    with pytest.raises(ValueError):
        ranking.page(rows, 0)


def test_running_total_keeps_null_groups(spark):
    rows = spark.createDataFrame([(1, 10, 1), (1, 70, 2), (None, 10, 4), (None, 80, 8), (2, None, 16)], "user int, ts int, n int")
    got = {(r.user, r.ts): r.before for r in running_total(rows, ["user"], F.floor(F.col("ts") / 60), ["ts"], "n").collect()}
    assert got == {(1, 10): 0, (1, 70): 1, (None, 10): 0, (None, 80): 4, (2, None): 0}


def test_revisions_keep_null_keys(spark):
    rows = spark.createDataFrame(
        [("a", "1", "B", 5, 0), ("a", "2,0", "A", 1, 1), (None, "7", "A", 3, 2), (None, "7", "A", 3, 3), ("a", "20", "B", 9, 4)],
        "k string, serial string, grade string, size int, pos int",
    )
    got = {r.k: (r.pos, r.first_seen) for r in keep_best_revision(rows, "k", "serial", "grade", "size", "pos").collect()}
    assert got == {"a": (1, 0), None: (2, 2)}
    hashes = {r.k: (r.pos, r.n_members) for r in one_per_hash(rows, "k", "pos", ["serial"]).collect()}
    assert hashes == {"a": (0, 3), None: (2, 2)}


def test_contained_texts_with_repeated_keys(spark):
    texts = spark.createDataFrame([(1, "abcd"), (1, "abcd"), (2, "xbc"), (3, None)], "i int, t string")
    needles = spark.createDataFrame([("bc",), ("a",), ("",)], "n string")
    got = sorted((r.n, r.i) for r in joins.substring_matches(needles, texts, "n", "t", ["i"]).collect())
    assert got == [("a", 1), ("a", 1), ("bc", 1), ("bc", 1), ("bc", 2)]


def test_grams_of_long_texts_take_linear_work(spark):
    """A text is cut into characters once; null, short and wide characters keep their grams."""
    rows = spark.createDataFrame([(1, "abcab"), (2, "a"), (3, ""), (4, None), (5, "x😀법y"), (6, "가😀")], "i int, t string")
    got = {r.i: (r.one, r.two) for r in rows.select("i", joins._grams(F.col("t"), 1).alias("one"), joins._grams(F.col("t"), 2).alias("two")).collect()}
    assert got == {
        1: (["a", "b", "c"], ["ab", "bc", "ca"]), 2: (["a"], []), 3: ([], []), 4: ([], []),
        5: (["x", "😀", "법", "y"], ["x😀", "😀법", "법y"]), 6: (["가", "😀"], ["가😀"]),
    }
    began = time.monotonic()
    long = spark.range(4).select(F.repeat(F.lit("lorem ipsum "), 60_000).alias("t"))
    assert [r.n for r in long.select(F.size(joins._grams(F.col("t"), 2)).alias("n")).collect()] == [11] * 4
    assert time.monotonic() - began < 30
