"""Citations as a stream against registry answers that expire."""

import datetime as dt
import time

from pyspark.sql import functions as F

from docketry.streaming import jobs, registry

ROWS = "key string, event_id long, ts timestamp, answer string, slice int"


def at(minutes, seconds=0):
    return dt.datetime(2024, 5, 1, 8) + dt.timedelta(minutes=minutes, seconds=seconds)


def run(spark, data, **settings):
    rows = spark.createDataFrame(data, ROWS)
    out = jobs.collected(jobs.arriving(rows, "slice"), lambda s: registry.answered(s, **settings), "registry-test")
    return {r.event_id: r.answer for r in out.select("event_id", "answer").collect()}


def test_newest_answer_within_its_lifetime(spark):
    data = [
        ("a", 1, at(0), "old", 0), ("a", 2, at(10), None, 0), ("a", 3, at(20), "new", 0), ("a", 4, at(20), "newer", 0), ("a", 5, at(20), None, 0),
        ("b", 6, at(21), None, 0), (None, 7, at(22), "none", 0), (None, 8, at(23), None, 0),
        ("a", 9, at(79, 59), None, 1), ("a", 10, at(80), None, 1),  # one second before the lifetime ends, and at its end
        ("a", 11, at(75), None, 2), ("a", 12, at(74), "late answer", 2), ("a", 13, at(73), None, 2),  # late, within the delay
        ("z", 14, at(300), None, 3), ("z", 15, at(500), None, 4),  # time goes on; the last one still waits
    ]
    got = run(spark, data)
    assert got == {2: "old", 5: "newer", 6: None, 8: "none", 9: "late answer", 10: "late answer", 11: "late answer", 13: "newer", 14: None}


def test_lifetime_ends_and_dealing_does_not_matter(spark):
    data = [("a", 0, at(0), "v", 0)] + [("a", i, at(i), None, i // 30) for i in range(1, 90)] + [("a", 999, at(400), "end", 4)]
    for deals in (1, 7):
        got = run(spark, data, deals=deals)
        assert got == {i: "v" if i < 60 else None for i in range(1, 90)}


def test_a_lifetime_reaches_over_spans_and_many_answers_take_no_square_of_time(spark):
    first = [("a", 0, at(55), "v", 0)] + [("a", 10, at(65), None, 0), ("a", 11, at(115), None, 0), ("a", 12, at(125), None, 1), ("a", 99, at(400), "end", 2)]
    assert run(spark, first, deals=1) == {10: "v", 11: None, 12: None}
    n = 40_000
    data = spark.range(2 * n).selectExpr(
        "'a' key", "id event_id", "timestamp_micros(1714550400000000 + id * 40000) ts", f"if(id >= {n}, 'v', null) answer", "0 slice",
    ).unionByName(spark.createDataFrame([("a", -1, at(400), "end", 1)], ROWS))
    began = time.monotonic()
    out = jobs.collected(jobs.arriving(data, "slice"), lambda s: registry.answered(s, deals=1), "registry-test")
    assert out.where("answer is null").count() == n
    assert time.monotonic() - began < 30
