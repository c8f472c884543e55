"""Exact top-k against scoring every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import impact
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) or abs(x) > impact.LARGEST for x in vector):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in vector]


def by_hand(rows, every=50, k=5):
    known = [(i, n, w) for n, (i, v, _) in enumerate(rows) if (w := whole(v)) is not None]
    out = []
    for i, n, q in known:
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, w)), j is None, j or 0, j) for j, m, w in known if m != n)
            out += [(i, rank + 1, j, -s) for rank, (s, _, _, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def run(spark, tmp_path, rows, search=impact.Search(), every=50):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("at", "q", "id", "block", "batch", "score")})
    return sorted(map(tuple, impact.exact_top_k(cases.settled(spark, df, tmp_path), every, search).collect()), key=repr)


def test_awkward_vectors(spark, tmp_path):
    """Nulls, NaN, infinities, ties, repeated ids and rows, unlike and empty vectors, outliers."""
    rng = np.random.default_rng(3)
    base = [float(x) for x in rng.normal(0, 0.1, 6)]
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 6)], 0) for i in range(120)]
    rows += [
        (200, None, 0), (201, [None, 1.0], 0), (202, [float("nan")] * 6, 0), (203, [float("inf")] * 6, 0), (250, [], 0), (300, base, 1), (300, base, 1),
        (350, base[:3], 0), (400, base + [0.5, 0.5], 0), (None, base, 0), (450, [1000.0, -1000.0, 0.0, 0.0, 0.0, 0.0], 0), (451, [2.0**18] + base[1:], 0),
    ] + [(500 + i, base, 0) for i in range(60)]
    got = run(spark, tmp_path, rows)
    assert got == by_hand(rows) and any(r[0] == 250 and r[3] == 0 for r in got)


@pytest.mark.parametrize("search", [impact.Search(block=16, batch=2), impact.Search(k=1, block=300, levels=3), impact.Search(k=40, block=30, few=0)])
def test_sizes_of_work_do_not_change_rows(spark, tmp_path, search):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.12, 24)], 0) for i in range(260)]
    assert run(spark, tmp_path, rows, search, every=20) == by_hand(rows, 20, search.k)


def test_every_batch_meets_every_block_on_many_partitions(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 0.12, 8)], 0) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, tmp_path, rows, impact.Search(block=20, batch=3), every=10) == by_hand(rows, 10)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_fewer_rows_than_asked_for(spark, tmp_path):
    rows = [(0, [0.5, 0.25], 0), (1, [0.5, -0.25], 0), (50, [1.0, 1.0], 0)]
    assert run(spark, tmp_path, rows) == by_hand(rows)
    assert run(spark, tmp_path, rows[:1]) == [] and run(spark, tmp_path, []) == []


def test_a_hot_vector_takes_a_third(spark, tmp_path):
    rng = np.random.default_rng(7)
    same = [float(x) for x in rng.normal(0, 0.12, 16)]
    rows = [(i, same if i % 3 == 0 else [float(x) for x in rng.normal(0, 0.12, 16)], 0) for i in range(300)]
    assert run(spark, tmp_path, rows, impact.Search(block=64)) == by_hand(rows)


def test_segments_are_left_out_on_proof():
    rng = np.random.default_rng(11)
    matrix = np.floor(256 * rng.normal(0, 0.125, (4096, 64))).astype(np.int32)
    ids = np.arange(4096)
    block = {"ids": ids, "known": np.ones(4096, bool), "ats": ids, "matrix": matrix, "dims": 64} | impact.postings(matrix, 16)
    asked = {k: v if k == "dims" else v[:64] for k, v in block.items() if k in ("ids", "known", "ats", "matrix", "dims")}
    query, doc, score, skipped = impact.score_block(block, asked, impact.Search())
    every = matrix.astype(np.int64) @ matrix[:64].T.astype(np.int64)
    every[np.arange(64), np.arange(64)] = -(1 << 60)
    for j in range(64):
        best = np.lexsort((ids, -every[:, j]))[:5]
        assert list(doc[query == j]) == list(best) and list(score[query == j]) == list(every[best, j])
    assert skipped > 0.1 * matrix.size * 64
