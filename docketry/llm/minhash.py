"""Near-duplicate groups: universal hash minima, banding, verification and components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.components import components
from docketry.llm.textbytes import LOWER, blocks, mix, prefix_sums, range_hashes, shingles, word_bounds
from docketry.session import stage


#: Shingles per 0/1 matrix of a block comparison.
WIDTH = 2048


@dataclass(frozen=True)
class Near:
    """Texts are linked from ``percent`` of common shingles of ``words`` words.

    ``hubs``: hubs each bucket is compared with; ``block``: classes compared at once.

    ``bands`` of ``rows`` minima each: two texts at 85 % share a band but for one case in
    10**8, at 80 % but for three in 10**6. Pairs of a class and a hub whose minima agree in
    less than ``percent`` less ``slack`` standard errors are not compared in full (seven
    links in 10**6 at the threshold); the last step compares without that filter.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    slack: float = 4.5
    hubs: int = 3
    block: int = 1024

    @property
    def least_agreement(self) -> int:
        n, p = self.bands * self.rows, self.percent / 100
        return int(n * p - self.slack * (n * p * (1 - p)) ** 0.5)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each row in increasing order, A-Z lower-cased."""
    for _, _, data, ends in blocks(column):
        data = LOWER[data]
        starts, stops, first = word_bounds(data, ends)
        made, bounds = shingles(range_hashes(prefix_sums(data), starts, stops), first, size)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield np.unique(made[a:b])


def _minima(values: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Smallest value of every hash ``factor * x + term`` modulo 2**32 over a set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(low, (factors[:, None] * x[None, k:k + 1024] + terms[:, None]).min(axis=1), out=low)
    return low


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """Adds to (at, doc_id) the set's size, its 128-bit digest, the band keys and a byte of every minimum."""
    count = near.bands * near.rows
    random = np.random.default_rng(977)
    factors = random.integers(0, 1 << 32, count, np.uint32) | np.uint32(1)
    terms = random.integers(0, 1 << 32, count, np.uint32)
    seeds = random.integers(0, 1 << 64, (near.bands, near.rows), np.uint64) | np.uint64(1)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, marks = [], [], [], []
            for values in shingle_sets(batch.column(2), near.words):
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                low = _minima(values, factors, terms)
                keys.append(mix((low.reshape(near.bands, near.rows) * seeds).sum(axis=1, dtype=np.uint64)).view(np.int64))
                marks.append((low >> np.uint32(24) ^ low & np.uint32(255)).astype(np.uint8).tobytes())
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * near.bands), pa.array(flat)),
                pa.array(marks, pa.binary()),
            ], names=["at", "doc_id", "n_shingles", "digest", "bands", "marks"])

    return docs.mapInArrow(run, f"at long, doc_id {kind}, n_shingles long, digest binary, bands array<long>, marks binary")


def _sets(docs: DataFrame, near: Near) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [v.view(np.int64) for v in shingle_sets(batch.column(1), near.words)]
            ends = np.concatenate(([0], np.cumsum([len(v) for v in made]))).astype(np.int32)
            flat = np.concatenate(made) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "members"],
            )

    return docs.mapInArrow(run, "node long, members array<long>")


def _agreeing(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Pairs whose minima agree often enough."""
    least = near.least_agreement
    marks = nodes.select("node", "marks")
    joined = pairs.join(marks.withColumnsRenamed({"node": "a", "marks": "left"}), "a").join(
        marks.withColumnsRenamed({"node": "b", "marks": "right"}), "b",
    ).select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = near.bands * near.rows
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, width) for k in (2, 3)
            )
            yield batch.select([0, 1]).filter(pa.array((left == right).sum(axis=1) >= least))

    return joined.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Pairs whose full sets overlap enough."""
    left, right = (sets.select(F.col("node").alias(n), F.col("members").alias(f"{n}_set")) for n in "ab")
    joined = pairs.join(left, "a").join(right, "b")
    common, both = F.size(F.array_intersect("a_set", "b_set")).cast("long"), F.size("a_set") + F.size("b_set")
    return joined.where(100 * common >= near.percent * (both - common)).select("a", "b")


def block_links(nodes: list[int], roots: list[int], left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of ``left`` and of ``right`` with different roots: as many as join all roots that links join.

    Overlaps come from products of 0/1 matrices over the shingles that occur twice,
    some thousand columns at a time.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    ranked, owner = flat[order], owner[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    shared = often[column]
    column, owner = (np.cumsum(often) - 1)[column[shared]], owner[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, int(often.sum()) + WIDTH, WIDTH))
    for a, b in zip(edges[:-1], edges[1:]):
        block = np.zeros((len(sets), WIDTH), np.float32)
        block[owner[a:b], column[a:b] % WIDTH] = 1
        common += block[left] @ block[right].T
    both = sizes[left][:, None] + sizes[right][None, :]
    tags = np.array(roots)
    linked = (100 * common >= percent * (both - common)) & (tags[left][:, None] != tags[right][None, :])
    top = {r: r for r in roots}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = int(left[i]), int(right[j])
        x, y = find(roots[a]), find(roots[b])
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((nodes[a], nodes[b]))
    return out


def _open_links(open_: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links across components inside buckets (bucket, node, root).

    A bucket is dealt into blocks by hash; every two blocks meet in one group of rows, so
    a row is sent once per block of its bucket and no pair is ever a row.
    """
    sized = open_.groupBy("bucket").agg(
        F.ceil(F.count(F.lit(1)) / near.block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"),
    )
    # Buckets of several bands with the same members are compared once.
    once = sized.groupBy("m", "mark").agg(F.min("bucket").alias("bucket"), F.first("blocks").alias("blocks"))
    dealt = open_.join(once.select("bucket", "blocks"), "bucket").withColumn("own", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    sent = dealt.join(sets, "node").select(
        "bucket", "node", "root", "own", "members", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root", "members")

    def solve(group: list[tuple], low: int, high: int) -> list[tuple[int, int]]:
        own = np.array([g[0] for g in group])
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        return block_links([g[1] for g in group], [g[2] for g in group], left, right, [g[3] for g in group], near.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        last = None

        def finish() -> pa.RecordBatch:
            links = solve(group, last[1], last[2]) if len({g[2] for g in group}) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"],
            )

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))))
            listed = batch.column(6)
            ends = np.asarray(listed.offsets)
            flat = np.asarray(listed.values)
            rest = list(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))))
            for i, key in enumerate(keys):
                if key != last and group:
                    yield finish()
                    group = []
                last = key
                group.append((*rest[i], flat[ends[i]:ends[i + 1]]))
        if group:
            yield finish()

    return sent.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: at, doc_id, n_shingles, component_id, kept, first.

    Rows with equal sets form one class and are never paired. Classes that share a band
    key are candidates: in each bucket every class is compared with a few hubs, linked ones
    are joined into components, and in the end the classes of a bucket that are still in
    different components are compared block by block inside tasks, so no link inside a
    bucket of more than two classes is missed, no pair is a row, and a group of similar texts that a few hubs
    link costs a few comparisons per text.

    ``component_id`` is the smallest id reachable, ``kept`` whether it is the row's own;
    ``first`` is true for exactly one row of each component, also if ids repeat or are
    null. Null, empty and wordless texts have no shingles and are linked with nothing.
    """
    # Numbered once: another scan packs files by the cores there are by then, and numbers rows otherwise.
    return _groups(stage(docs.select(
        F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
    ), "numbered-texts"), near)


def _groups(rows: DataFrame, near: Near) -> DataFrame:
    """The result of ``near_groups`` for staged rows (at, doc_id, text)."""
    signed = stage(signatures(rows, near), "signatures")
    filled = signed.where("n_shingles > 0")
    classes = filled.groupBy("digest").agg(F.min("at").alias("node"))
    placed = stage(
        filled.select("at", "doc_id", "n_shingles", "digest").join(classes, "digest").drop("digest"), "classes",
    )
    nodes = signed.join(placed.where("at = node").select("at"), "at", "left_semi").withColumnRenamed("at", "node")
    spread = nodes.select("node", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    full = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(spread.join(full, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "node", "n", "size"), "buckets")
    wanted = members.select("node").distinct()
    sets = stage(
        _sets(rows.select("at", "text").join(wanted, F.col("at") == F.col("node"), "left_semi"), near), "sets",
    )
    marks = stage(nodes.join(wanted, "node", "left_semi").select("node", "marks"), "marks")

    def fits(x: str, y: str):
        return 100 * F.least(x, y) >= near.percent * F.greatest(x, y)

    # Several hubs of each bucket at once: one verification and one run of components.
    hubs = members.groupBy("bucket").agg(F.array_distinct(F.array(*[
        F.min_by(F.struct("node", "n"), F.xxhash64(F.lit(turn), "node")) for turn in range(near.hubs)
    ])).alias("hubs"))
    pairs = members.join(hubs, "bucket").select("node", "n", F.explode("hubs").alias("hub")).where(
        (F.col("node") != F.col("hub.node")) & fits("n", "hub.n"),
    ).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    agreeing = stage(_agreeing(pairs, marks, near), "agreeing")
    links = stage(_confirmed(agreeing, sets, near), "near-links")
    roots = components(links)
    placed_in = members.where("size > 2").join(roots, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root"),
    )
    mixed = placed_in.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    open_ = stage(placed_in.join(mixed, "bucket", "left_semi"), "open-buckets")
    more = stage(_open_links(open_, sets, near), "open-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    every = signed.select("at", "doc_id", "n_shingles").where("n_shingles = 0").withColumn("node", F.col("at")).unionByName(placed)
    grouped = every.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "at")
    keepers = grouped.groupBy("root").agg(F.min(order).alias("keep"))
    return grouped.join(keepers, "root").select(
        "at", "doc_id", "n_shingles", F.col("keep.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("keep.doc_id"), F.lit(False)).alias("kept"), (F.col("at") == F.col("keep.at")).alias("first"),
    )


def first_of_groups(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    marked = stage(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")),
        "numbered-rows",
    )
    rows = marked.select("at", "row.doc_id", F.col("row.text").cast("string").alias("text"))
    kept = _groups(rows, near).where("first").select(F.col("at").alias("_kept_at"))
    return marked.join(kept, F.col("at") == F.col("_kept_at"), "left_semi").select("row.*")
