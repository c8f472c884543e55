"""Order-dependent operators that do not funnel the table through one task.

Each works in two levels: rows are cut into ranges of the order column, ranges
are processed in parallel, and only a short digest per range is combined in
order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docketry.session import stage

RANGE_ROWS = 1_000_000


def running_total(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], value: str,
                  name: str = "before") -> DataFrame:
    """Sum of ``value`` over earlier rows of the group (the row itself excluded).

    ``bucket`` must grow with ``order``; it splits large groups. Rows are only
    sorted inside a bucket, and bucket sums are accumulated per group.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum").withColumnsRenamed({c: f"_sum_{c}" for c in (*by, "_bucket")})
    )
    # Null-safe: rows of a null group or bucket have sums of their own.
    same = [F.col(c).eqNullSafe(F.col(f"_sum_{c}")) for c in (*by, "_bucket")]
    return (
        rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums, reduce(and_, same))
        .withColumn(name, F.col("_base") + F.col("_local"))
        .drop("_bucket", "_base", "_local", *[f"_sum_{c}" for c in (*by, "_bucket")])
    )


def ranged(df: DataFrame, order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with ``rng``: numbers of consecutive ranges of about ``range_rows`` rows, whatever the values of ``order``."""
    ranges = max(1, math.ceil(df.count() / range_rows))
    return stage(df.repartitionByRange(ranges, order).withColumn("rng", F.spark_partition_id().cast("long")), "ranges")


def changes(df: DataFrame, order: str, value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows whose ``value`` differs from the previous row's, the first row included."""
    rows = ranged(df.select(order, value), order, range_rows)
    inside = Window.partitionBy("rng").orderBy(order)
    marked = rows.withColumn("_prev", F.lag(value).over(inside)).withColumn("_at", F.row_number().over(inside))
    ends = rows.groupBy("rng").agg(F.max_by(F.struct(value), order).alias("_last"))
    # One row per million rows: the only place where ranges are put in sequence.
    carried = ends.select(
        "rng", F.lag(F.col(f"_last.`{value}`")).over(Window.orderBy("rng")).alias("_before"),
        (F.row_number().over(Window.orderBy("rng")) == 1).alias("_is_first"),
    )
    joined = marked.join(carried, "rng")
    previous = F.when(F.col("_at") > 1, F.col("_prev")).otherwise(F.col("_before"))
    changed = (F.col("_is_first") & (F.col("_at") == 1)) | ~previous.eqNullSafe(F.col(value))
    return joined.where(changed).select(order, value)


def _next_start(prefix: np.ndarray, max_items: int, max_size: int) -> np.ndarray:
    """For each row: where the batch that starts there ends (exclusive), in this range."""
    rows = len(prefix) - 1
    start = np.arange(rows)
    by_size = np.searchsorted(prefix, prefix[:-1] + max_size, side="right") - 1
    return np.minimum(np.maximum(np.minimum(by_size, start + max_items), start + 1), rows)


def _first_break(prefix: np.ndarray, items: int, size: int, max_items: int, max_size: int) -> int:
    """First row that does not fit a batch already holding ``items`` and ``size``."""
    by_size = int(np.searchsorted(prefix, max_size - size, side="right")) - 1
    return max(0, min(max_items - items, by_size))


def greedy_batches(df: DataFrame, order: str, size: str, max_items: int, max_size: int,
                   range_rows: int = RANGE_ROWS) -> DataFrame:
    """Consecutive batches: a new one starts when the next row would break a limit.

    A row larger than ``max_size`` forms a batch alone. The rule carries state from
    row to row, yet it is evaluated in parallel: every range works out, for each
    row at which its first new batch could begin, how that choice ends. Such digests
    compose like functions, so neighbours are merged in a tree, and the state at each
    range start follows from the root down; no task sees more than two digests of
    ``max_items`` rows. Ranges then number their rows. Returns ``order, batch_no``
    (0-based).
    """
    rows = ranged(df.select(F.col(order).cast("long").alias("ord"), F.col(size).cast("long").alias("size")), "ord", range_rows)

    def digest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        prefix = np.concatenate([[0], np.cumsum(pdf["size"].to_numpy())])
        n = len(pdf)
        nxt = _next_start(prefix, max_items, max_size)
        last = np.arange(n)
        batches = np.zeros(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            if nxt[i] < n:
                last[i] = last[nxt[i]]
                batches[i] = 1 + batches[nxt[i]]
        width = min(max_items, n)
        return pd.DataFrame({
            "node": pdf["rng"].iloc[0], "at": np.arange(width), "n": n, "total": int(prefix[-1]), "upto": prefix[1:width + 1],
            "tail_items": n - last[:width], "tail_size": prefix[-1] - prefix[last[:width]], "batches": batches[:width],
        })

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].iloc[0] // 2
        halves = [h.sort_values("at") for _, h in pdf.groupby("node", sort=True)]
        if len(halves) == 1:
            return halves[0].assign(node=node)
        left, right = ({c: h[c].to_numpy() for c in h} for h in halves)
        n, total = int(left["n"][0]), int(left["total"][0])
        m, more = int(right["n"][0]), int(right["total"][0])
        # Where the open batch of each choice breaks in the right half, if it does.
        at = np.minimum(max_items - left["tail_items"], np.searchsorted(right["upto"], max_size - left["tail_size"], "right"))
        inside, at = at < m, np.minimum(at, len(right["at"]) - 1)
        out = {
            "upto": left["upto"], "tail_items": np.where(inside, right["tail_items"][at], left["tail_items"] + m),
            "tail_size": np.where(inside, right["tail_size"][at], left["tail_size"] + more),
            "batches": left["batches"] + np.where(inside, 1 + right["batches"][at], 0),
        }
        # Choices whose first break lies in the right half already.
        extra = max(0, min(max_items, n + m) - n) if len(left["at"]) == n else 0
        tail = {"upto": total + right["upto"], **{c: right[c] for c in ("tail_items", "tail_size", "batches")}}
        merged = {c: np.concatenate([out[c], tail[c][:extra]]) for c in out}
        return pd.DataFrame({"node": node, "at": np.arange(len(merged["upto"])), "n": n + m, "total": total + more, **merged})

    def descend(digests: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        items, held, batch = (int(state[c].iloc[0]) for c in ("items", "held", "batch"))
        out = []
        for node, half in digests.groupby("node", sort=True):
            out.append((node, items, held, batch))
            half = half.sort_values("at")
            n = int(half["n"].iloc[0])
            at = 0 if batch < 0 else min(max_items - items, int(np.searchsorted(half["upto"].to_numpy(), max_size - held, "right")))
            if at >= n:  # the open batch swallows this part
                items, held = items + n, held + int(half["total"].iloc[0])
            else:
                row = half.iloc[at]
                items, held, batch = int(row["tail_items"]), int(row["tail_size"]), batch + 1 + int(row["batches"])
        return pd.DataFrame(out, columns=["node", "items", "held", "batch"])

    shape = "node long, at long, n long, total long, upto long, tail_items long, tail_size long, batches long"
    levels = [stage(rows.groupBy("rng").applyInPandas(digest, shape), "digests")]
    parent = F.floor(F.col("node") / 2)
    ranges = rows.agg(F.coalesce(F.max("rng"), F.lit(0)) + 1).first()[0]
    for _ in range(max(0, math.ceil(math.log2(ranges)))):
        levels.append(stage(levels[-1].groupBy(parent.alias("up")).applyInPandas(compose, shape), "digests"))
    states = rows.sparkSession.createDataFrame([(0, 0, 0, -1)], "node long, items long, held long, batch long")
    for level in levels[-2::-1]:
        states = stage(
            level.groupBy(parent.alias("up")).cogroup(states.groupBy("node")).applyInPandas(descend, "node long, items long, held long, batch long"),
            "states",
        )
    states = states.withColumnRenamed("node", "rng")

    def number(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"ord": [], "batch_no": []})
        pdf = pdf.sort_values("ord")
        prefix = np.concatenate([[0], np.cumsum(pdf["size"].to_numpy())])
        n = len(pdf)
        items, held, batch = (int(state[c].iloc[0]) for c in ("items", "held", "batch"))
        numbers = np.empty(n, dtype=np.int64)
        at = 0
        if batch >= 0:
            at = min(_first_break(prefix, items, held, max_items, max_size), n)
            numbers[:at] = batch
        nxt = _next_start(prefix, max_items, max_size)
        while at < n:
            batch += 1
            numbers[at:nxt[at]] = batch
            at = nxt[at]
        return pd.DataFrame({"ord": pdf["ord"].to_numpy(), "batch_no": numbers})

    numbered = rows.groupBy("rng").cogroup(states.groupBy("rng")).applyInPandas(number, "ord long, batch_no long")
    return numbered.select(F.col("ord").alias(order), "batch_no")
