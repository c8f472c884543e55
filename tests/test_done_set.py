"""A stream that gives texts their vectors once."""

import os

from pyspark.sql import functions as F

from docketry.streaming import done_set, jobs

ROWS = "chunk_id string, content_hash string, vec_id long, slice int"


def run(spark, rows, vectors, path, state):
    stream = jobs.arriving(spark.createDataFrame(rows, ROWS), "slice")
    done_set.vectors_incrementally(stream, vectors, "vec_id", f"{path}/done", f"{path}/{state}").awaitTermination()
    return sorted((r.content_hash, r.vector) for r in done_set.vectors_of(spark, f"{path}/done").collect())


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(f"{path}/done") for f in names if f.endswith(".parquet"))


def test_a_hash_gets_one_vector_and_later_runs_add_only_what_is_new(spark, tmp_path):
    path = str(tmp_path)
    vectors = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(40)], "vec_id long, vector array<double>")
    rows = [(f"c{i:03}", f"hash{i % 30}", i % 50, i // 25) for i in range(75)]
    want = {}
    for chunk, name, vec, _ in rows:  # in order of arrival, then of chunk ids
        if name not in want and vec < 40:
            want[name] = [float(vec), 0.5]
    first = run(spark, rows, vectors, path, "one")
    assert first == sorted(want.items())
    before = files(path)
    assert run(spark, rows, vectors, path, "two") == first and files(path) == before
    more = run(spark, rows + [("d", "other", 7, 9)], vectors, path, "three")
    assert more == sorted([*want.items(), ("other", [7.0, 0.5])])


def test_known_hashes_are_found_among_full_bit_sets(spark, tmp_path, monkeypatch):
    """With very few bits every set is full: keys decide alone."""
    monkeypatch.setattr(done_set, "BITS", 8)
    vectors = spark.createDataFrame([(1, [1.0])], "vec_id long, vector array<double>")
    got = run(spark, [(f"c{i}", f"h{i % 9}", 1, i // 10) for i in range(20)], vectors, str(tmp_path), "s")
    assert got == sorted((f"h{i}", [1.0]) for i in range(9))
