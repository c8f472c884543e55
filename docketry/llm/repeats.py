"""Removal of long repeated byte strings by suffix arrays over shards of candidate text.

Every string of ``length`` bytes is represented by the smallest hash of the grams in it,
so equal strings have equal representatives, wherever they start. Starts in a row with one
representative make a context: the bytes their strings cover. Contexts whose
representative occurs once repeat nothing; equal contexts repeat each other as a whole.
What is left shares a representative without being equal: those contexts are sent to
shards by representative, one of each kind, and a suffix array with its permuted common
prefixes finds the starts that share ``length`` bytes with another one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.induced import common_prefixes, suffix_array
from docketry.llm.textbytes import blocks, prefix_sums, range_hashes, raw
from docketry.session import stage

#: A byte that UTF-8 never has; it ends each context in a shard.
END = np.uint8(255)


@dataclass(frozen=True)
class Repeats:
    """``length``: bytes of a string; ``gram``: bytes hashed; the rest bounds the work of one step.

    Representatives with more than ``hot`` different contexts do not go to one shard:
    their strings are counted by 128-bit hashes instead, which combine before a shuffle.
    """

    length: int = 400
    gram: int = 128
    shard_bytes: int = 4 << 20
    hot: int = 4096


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of ``width`` values, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - width + 1
    return np.minimum(behind[:k], ahead[width - 1:width - 1 + k])


def contexts(data: np.ndarray, plan: Repeats) -> tuple[np.ndarray, ...] | None:
    """Representative, context digest, first and last start of every context of a text.

    The last array tells where the representative occurs more than once, so that the
    context may repeat a string of its own.
    """
    if len(data) < plan.length:
        return None
    sums = prefix_sums(data)
    starts = np.arange(len(data) - plan.gram + 1)
    width = plan.length - plan.gram + 1
    grams = range_hashes(sums, starts, starts + plan.gram)
    least = window_minima(grams, width)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.concatenate((first[1:] - 1, [len(least) - 1]))
    periodic = np.array([
        np.count_nonzero(grams[a:b + width] == v) > 1 for a, b, v in zip(first.tolist(), last.tolist(), least[first])
    ])
    return least[first], range_hashes(sums, first, last + plan.length), first, last, periodic


def _contexts_of(rows: DataFrame, plan: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, ends in blocks(batch.column(1), 1 << 23):
                found = [(i, contexts(data[ends[i]:ends[i + 1]], plan)) for i in range(b - a)]
                found = [(i, c) for i, c in found if c is not None]
                if found:
                    columns = [np.concatenate([c[k] for _, c in found]) for k in range(5)]
                    owner = np.repeat([at[a + i] for i, _ in found], [len(c[0]) for _, c in found])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), pa.array(owner, pa.int64()),
                        pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32)), pa.array(columns[4]),
                    ], names=["gram", "context", "at", "low", "high", "periodic"])

    return rows.mapInArrow(run, "gram long, context long, at long, low int, high int, periodic boolean")


def _context_bytes(rows: DataFrame, plan: Repeats) -> DataFrame:
    """The bytes of each listed context: (gram, hot, at, low, high, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = raw(batch.column(1))
            listed = batch.column(2)
            bounds = np.asarray(listed.offsets)
            fields = {f.name: listed.values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(listed.type.value_type)}
            counts = np.diff(bounds)
            row = np.repeat(np.arange(len(counts)), counts)
            part = slice(int(bounds[0]), int(bounds[-1]))
            low, high = fields["low"][part].astype(np.int64), fields["high"][part].astype(np.int64)
            begin = ends[row] + low
            stop = ends[row] + high + plan.length
            # A few thousand at a time keep batches small.
            for k in range(0, len(row), 4096):
                own = slice(k, k + 4096)
                texts = [data[x:y].tobytes() for x, y in zip(begin[own].tolist(), stop[own].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(fields["gram"][part][own]), pa.array(fields["hot"][part][own]),
                    pa.array(batch.column(0).to_numpy(zero_copy_only=False)[row[own]]),
                    pa.array(low[own].astype(np.int32)), pa.array(high[own].astype(np.int32)), pa.array(texts, pa.binary()),
                ], names=["gram", "hot", "at", "low", "high", "bytes"])

    return rows.mapInArrow(run, "gram long, hot boolean, at long, low int, high int, bytes binary")


def repeated_starts(texts: list[bytes], counts: list[int], length: int) -> np.ndarray:
    """Whether each start of each text (``counts[i]`` starts) shares ``length`` bytes with another start."""
    shard = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    previous, lengths = common_prefixes(shard, suffix_array(shard))
    long = np.flatnonzero(lengths >= length)
    repeated = np.zeros(len(shard), bool)
    repeated[long] = True
    repeated[previous[long]] = True
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    n = np.array(counts)
    begin = np.cumsum(n) - n
    return repeated[np.repeat(starts - begin, n) + np.arange(n.sum())]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _sharded(found: DataFrame, plan: Repeats) -> DataFrame:
    """Repeated ranges of starts among contexts with a common representative."""

    def solve(group: list[tuple]) -> pa.RecordBatch:
        counts = [high - low + 1 for _, low, high, _ in group]
        flags = repeated_starts([t for *_, t in group], counts, plan.length)
        ends = np.cumsum(counts)
        begin = ends - counts
        # A context that follows another one starts a new run.
        flat = np.zeros(len(flags) + len(counts), bool)
        shift = np.repeat(np.arange(len(counts)), counts)
        flat[np.arange(len(flags)) + shift] = flags
        first, last = _runs(flat)
        owner = np.searchsorted(ends + np.arange(len(counts)), first, "right")
        base = np.array([low for _, low, _, _ in group]) - begin - np.arange(len(counts))
        return pa.RecordBatch.from_arrays([
            pa.array(np.array([a for a, *_ in group])[owner], pa.int64()), pa.array((first + base[owner]).astype(np.int32)),
            pa.array((last - 1 + base[owner]).astype(np.int32)),
        ], names=["at", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for gram, at, low, high, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= plan.shard_bytes and gram != last:
                    yield solve(group)
                    group, size = [], 0
                group.append((at, low, high, text))
                size, last = size + len(text), gram
        if group:
            yield solve(group)

    return found.select("gram", "at", "low", "high", "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(
        run, "at long, low int, high int",
    )


def _by_string(found: DataFrame, plan: Repeats) -> DataFrame:
    """Repeated starts of very frequent representatives, from counts of their strings' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, low, high, text in zip(*(c.to_pylist() for c in batch.columns)):
                # A long context gives several batches.
                for first in range(0, high - low + 1, 1 << 16):
                    starts = range(first, min(first + (1 << 16), high - low + 1))
                    digests = [hashlib.blake2b(text[k:k + plan.length], digest_size=16).digest() for k in starts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(digests, pa.binary()), pa.array([at] * len(digests), pa.int64()),
                        pa.array(np.arange(low + starts.start, low + starts.stop, dtype=np.int32)),
                    ], names=["string", "at", "low"])

    strings = found.select("at", "low", "high", "bytes").mapInArrow(run, "string binary, at long, low int")
    often = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return strings.join(often, "string").select("at", "low", F.col("low").alias("high"))


def repeated_ranges(rows: DataFrame, plan: Repeats = Repeats()) -> DataFrame:
    """Ranges of starts (at, low, high) of strings that also start anywhere else.

    ``rows`` has a unique ``at`` and a non-null ``text`` and has to be re-readable.
    """
    every = stage(_contexts_of(rows, plan), "contexts")
    grams = every.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("least"), F.max("context").alias("most"),
        F.max("periodic").alias("periodic"),
    ).where("n > 1 or periodic").select("gram", ((F.col("least") != F.col("most")) | (F.col("n") == 1)).alias("mixed"))
    shared = stage(every.join(grams, "gram"), "shared-contexts")
    equal = shared.where("not mixed").select("at", "low", "high")
    kinds = stage(
        shared.where("mixed").groupBy("gram", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "low", "high")).alias("one"),
        ), "kinds",
    )
    many = kinds.where("n > 1").select("gram", "context")
    copies = shared.where("mixed").join(many, ["gram", "context"], "left_semi").select("at", "low", "high")
    # Contexts in a periodic passage are as long as the passage, so bytes count too.
    size = (F.col("one.high") - F.col("one.low")).cast("long") + plan.length
    width = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("width"), F.sum(size).alias("size"))
    wanted = kinds.join(width, "gram").select(
        "one.at", F.struct("gram", ((F.col("width") > plan.hot) | (F.col("size") > plan.shard_bytes)).alias("hot"), "one.low", "one.high").alias("piece"),
    )
    listed = wanted.groupBy("at").agg(F.collect_list("piece").alias("pieces"))
    found = stage(_context_bytes(rows.join(listed, "at").select("at", "text", "pieces"), plan), "context-bytes")
    sharded = _sharded(found.where("not hot"), plan)
    return equal.unionByName(copies).unionByName(sharded).unionByName(_by_string(found.where("hot"), plan))


def _cut(rows: DataFrame, plan: Repeats, keep_text: bool, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = raw(batch.column(1))
            ranges = batch.column(2).to_pylist()
            out: list[tuple] = []
            for i, spans in enumerate(ranges):
                own = data[ends[i]:ends[i + 1]]
                change = np.zeros(len(own) + 1, np.int32)
                for span in spans or ():
                    change[span["low"]] += 1
                    change[span["high"] + plan.length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                first, last = _runs(gone)
                left = own[~gone].tobytes()
                out.append((
                    len(own), int(gone.sum()), len(first), hashlib.sha256(left).hexdigest(),
                    [{"start": int(x), "stop": int(y)} for x, y in zip(first, last)], left if keep_text else None,
                ))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.string()),
                pa.array(columns[4], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(columns[5], pa.binary()),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:int,stop:int>>, kept binary",
    )


def remove_repeats(
    docs: DataFrame, plan: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and the bytes kept.

    A byte goes when any string of ``length`` bytes that covers it also starts anywhere
    else in the table, the same text included, judged on the input. Null and empty texts
    have no bytes; texts shorter than ``length`` lose none; repeated rows lose all of
    theirs; ids may repeat or be null. An empty table gives no rows. What is kept may end
    inside a character, so it is binary.
    """
    # Numbered once: another scan packs files by the cores there are by then, and numbers rows otherwise.
    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ), "numbered-texts")
    ranges = repeated_ranges(rows.select("at", "text"), plan).groupBy("at").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return _cut(rows.join(ranges, "at", "left").select("doc_id", "text", "ranges"), plan, keep_text, dict(rows.dtypes)["doc_id"])
