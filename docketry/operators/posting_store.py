"""A lexical index that is written once, appended to, and opened by any later search.

Under the caller's path every segment has three tables: ``docs`` (a row per block of 256
rows: their keys and lengths), ``postings`` (a row per word and block, in folders by the
word's leading letters) and ``vocabulary`` (the words, in the same folders). A manifest of
its own version lists the segments; an append writes a segment and then the next version,
so readers see all of it or nothing, and a version number can be taken by one writer only.

A search reads the folders of its prefixes. Postings of matching words go to tasks by
shard, a run of 16 blocks; a task holds every block against the queries' bounds first: the
weights of the block's words at their highest frequency and the block's shortest row. A
block is opened only for queries that it could still give a row to, and scored there as one
matrix product.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketry.functions.binding import let
from docketry.functions.text import words
from docketry.operators.lexical import B, BODY_WEIGHT, K1, MIN_PREFIX, TITLE_WEIGHT, _matching_words, _runs, _terms
from docketry.operators.ranking import keep_best
from docketry.session import stage
from docketry.settings import DEFAULTS

LETTER_FOLDERS = 64
BLOCK_BITS, SHARD_BITS, SEGMENT_BITS = 8, 4, 50
MANIFEST = "key string, segments array<string>"
#: A table without rows has no folders that a reader could take the columns from.
SHAPES = {"postings": "word string, block long, offs array<int>, freqs array<float>, most float, letters int", "vocabulary": "word string, letters int"}


@dataclass(frozen=True)
class PostingStore:
    """One version of an index: its segments, and the name of the key column."""

    path: str
    version: int
    key: str
    segments: tuple[str, ...]


def letters(word: Column) -> Column:
    """Folder of a word or a prefix, by its first letters."""
    return F.pmod(F.xxhash64(F.substring(word, 1, MIN_PREFIX)), F.lit(LETTER_FOLDERS)).cast("int")


def _write_segment(rows: DataFrame, key: str, title: str | None, body: str, path: str) -> None:
    """Tokenise whole titles and bodies once; group postings by word and block."""
    title_words = words(F.coalesce(F.col(title), F.lit(""))) if title else F.array().cast("array<string>")

    def counted(t: Column, b: Column) -> Column:
        mark = lambda runs, field: F.transform(runs, lambda r: F.struct(r["word"].alias("word"), r["freq"].alias("freq"), F.lit(field).alias("field")))
        return F.struct((F.size(t) + F.size(b)).alias("n_words"), F.concat(mark(_runs(t, TITLE_WEIGHT), 0), mark(_runs(b, BODY_WEIGHT), 1)).alias("postings"))

    found = stage(rows.select(
        F.col(key).alias("key"), F.monotonically_increasing_id().alias("at"), let(counted, t=title_words, b=words(F.coalesce(F.col(body), F.lit("")))).alias("_row"),
    ), "segment-rows").select("key", F.shiftright("at", BLOCK_BITS).alias("block"), F.col("at").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("off"), "_row.*")
    found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("off", "key", "n_words"))).alias("own")).select(
        "block", F.transform("own", lambda d: d["off"]).alias("offs"), F.transform("own", lambda d: d["key"]).alias("keys"),
        F.transform("own", lambda d: d["n_words"]).alias("n_words"),
    ).write.parquet(f"{path}/docs")
    highest = lambda field: F.coalesce(F.max(F.when(F.col("field") == field, F.col("freq"))), F.lit(0.0))
    blocks = found.select("block", "off", F.inline("postings")).where(F.length("word") >= MIN_PREFIX).groupBy("word", "block").agg(
        F.collect_list(F.struct("off", "freq")).alias("own"), (highest(0) + highest(1)).alias("most"),
    ).select(
        letters(F.col("word")).alias("letters"), "word", "block", F.transform("own", lambda p: p["off"]).alias("offs"),
        F.transform("own", lambda p: p["freq"].cast("float")).alias("freqs"), F.col("most").cast("float").alias("most"),
    )
    order = ["letters", "word", "block"]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("letters").parquet(f"{path}/postings")
    rows.sparkSession.read.schema(SHAPES["postings"]).parquet(f"{path}/postings").select("letters", "word").distinct().repartition("letters").write.partitionBy("letters").parquet(f"{path}/vocabulary")


def _publish(spark: SparkSession, store: PostingStore) -> PostingStore:
    line = spark.createDataFrame([(store.key, list(store.segments))], MANIFEST)
    line.coalesce(1).write.mode("errorifexists").json(f"{store.path}/manifest/version={store.version}")
    return store


def create(rows: DataFrame, path: str, key: str, title: str | None, body: str) -> PostingStore:
    """Index ``rows`` under ``path``, which must not hold an index."""
    name = f"segment-{uuid.uuid4().hex}"
    _write_segment(rows, key, title, body, f"{path}/{name}")
    return _publish(rows.sparkSession, PostingStore(path, 0, key, (name,)))


def append(store: PostingStore, rows: DataFrame, title: str | None, body: str) -> PostingStore:
    """The next version: the store's segments and one of ``rows``. Fails if that version exists."""
    name = f"segment-{uuid.uuid4().hex}"
    _write_segment(rows, store.key, title, body, f"{store.path}/{name}")
    return _publish(rows.sparkSession, PostingStore(store.path, store.version + 1, store.key, (*store.segments, name)))


def open_store(spark: SparkSession, path: str, version: int | None = None) -> PostingStore:
    """The newest version under ``path``, or a given one."""
    found = spark.read.schema(MANIFEST + ", version int").json(f"{path}/manifest")
    if version is not None:
        found = found.where(F.col("version") == version)
    row = found.orderBy(F.desc("version")).first()
    if row is None:
        raise FileNotFoundError(f"no index version {version if version is not None else ''} under {path}")
    return PostingStore(path, row["version"], row["key"], tuple(row["segments"]))


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/version=0/_SUCCESS")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _tables(spark: SparkSession, store: PostingStore, name: str) -> DataFrame:
    """A table of all segments; block numbers carry the segment's place."""
    out = None
    for number, segment in enumerate(store.segments):
        reader = spark.read.schema(SHAPES[name]) if name in SHAPES else spark.read
        one = reader.parquet(f"{store.path}/{segment}/{name}")
        if "block" in one.columns:
            one = one.withColumn("block", F.col("block") + F.lit(number << SEGMENT_BITS))
        out = one if out is None else out.unionByName(one)
    return out


def _pieces(terms: DataFrame, query_id: str, limit: int) -> Iterator[pa.Table]:
    """Terms in pieces of at most about ``limit`` bytes, each with whole queries."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("prefix") + 48), F.lit(0))).first()[0]
    pieces = max(1, -(-size // limit))
    for piece in range(pieces):
        some = terms if pieces == 1 else terms.where(F.pmod(F.xxhash64(query_id), F.lit(pieces)) == piece)
        yield some.toArrow()


def _lists(table: pa.Table, column: str, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, row by row in ``order``, and how many each row has."""
    lists = table.column(column).combine_chunks().take(pa.array(order))
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


class _Shard:
    """Postings and rows of one shard, block by block, for the prefixes of a search."""

    def __init__(self, postings: pa.Table, docs: pa.Table, places: dict[str, int]) -> None:
        order = np.argsort(docs.column("block").to_numpy(), kind="stable")
        self.blocks = docs.column("block").to_numpy()[order]
        self.keys = docs.column("keys").combine_chunks().take(pa.array(order)).flatten()
        self.offs, counts = _lists(docs, "offs", order)
        self.lengths, _ = _lists(docs, "n_words", order)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        coded = postings.column("prefix").combine_chunks().dictionary_encode()
        known = np.array([places[p] for p in coded.dictionary.to_pylist()], np.int64)
        prefix = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        blocks = postings.column("block").to_numpy()
        rows = np.argsort(blocks, kind="stable")
        self.prefix, self.most = prefix[rows], postings.column("most").to_numpy()[rows].astype(np.float64)
        self.at, sizes = _lists(postings, "offs", rows)
        self.freq, _ = _lists(postings, "freqs", rows)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.rows = np.searchsorted(blocks[rows], self.blocks), np.searchsorted(blocks[rows], self.blocks, "right")

    def used(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefixes of block ``k``, which of them each posting row has, and their highest frequencies."""
        low, high = self.rows[0][k], self.rows[1][k]
        prefixes, own = np.unique(self.prefix[low:high], return_inverse=True)
        return prefixes, own, np.bincount(own, self.most[low:high], len(prefixes))

    def counts(self, k: int, own: np.ndarray, n: int) -> np.ndarray:
        """Frequencies of the block's prefixes in its rows that take part: rows x prefixes."""
        low, high = self.rows[0][k], self.rows[1][k]
        first, last = self.start[low], self.start[high]
        place = np.full(1 << BLOCK_BITS, -1)
        mine = self.offs[self.first[k]:self.first[k + 1]]
        place[mine] = np.arange(len(mine))
        row = place[self.at[first:last]]
        column = np.repeat(own, np.diff(self.start[low:high + 1]))
        there = row >= 0
        flat = np.bincount(row[there] * n + column[there], self.freq[first:last][there], len(mine) * n)
        return flat.reshape(len(mine), n)


def _scorer(shared, n_queries: int, n: int, digits: int, average: float, key: str, seen: tuple | None):
    """The function that scores one shard for the queries of a broadcast piece of terms."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        query, prefix, weight = shared.value
        asked = sorted(set(prefix))
        places = {p: i for i, p in enumerate(asked)}
        column = np.array([places[p] for p in prefix], np.int64)
        order = np.argsort(column, kind="stable")
        column, query, weight = column[order], query[order], weight[order]
        first = np.searchsorted(column, np.arange(len(asked) + 1))
        left = left.filter(pc.is_in(left.column("prefix"), value_set=pa.array(asked, pa.string())))
        shard = _Shard(left, right, places)
        best = _Best(n, n_queries, digits)
        bounds = []
        for k in range(len(shard.blocks)):
            used, own, most = shard.used(k)
            short = K1 * (1 - B + B * shard.lengths[shard.first[k]:shard.first[k + 1]].min(initial=1 << 30) / average)
            some = np.concatenate([np.arange(first[p], first[p + 1]) for p in used]) if len(used) else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(used)), first[used + 1] - first[used]) if len(used) else some
            bound = np.bincount(query[some], weight[some] * (most * (K1 + 1) / (most + short))[rows], n_queries)
            bounds.append((bound.max(initial=0), k, used, own, some, rows, bound))
        for _, k, used, own, some, rows, bound in sorted(bounds, key=lambda b: -b[0]):
            open_ = np.flatnonzero((bound > 0) & (bound + 10.0**-digits >= best.floor))
            if seen is not None:
                seen[0].add(int(np.count_nonzero(bound)))
                seen[1].add(int(np.count_nonzero(bound)) - len(open_))
            if not len(open_):
                continue
            counts = shard.counts(k, own, len(used))
            length = K1 * (1 - B + B * shard.lengths[shard.first[k]:shard.first[k + 1]] / average)
            parts = counts * (K1 + 1) / (counts + length[:, None])
            for at in range(0, len(open_), 512):  # so many queries at a time
                mine = open_[at:at + 512]
                place = np.full(n_queries, -1)
                place[mine] = np.arange(len(mine))
                keep = place[query[some]] >= 0
                matrix = np.zeros((len(used), len(mine)))
                matrix[rows[keep], place[query[some][keep]]] = weight[some][keep]
                best.add(mine, parts @ matrix, shard.first[k])
        return pa.table([best.query, shard.keys.take(pa.array(best.row)), best.score], names=["query", key, "score"])

    return score


def top(
    store: PostingStore, queries: DataFrame, query_id: str, text: str, n: int, digits: int = 6, among: DataFrame | None = None,
    seen: tuple | None = None, limit: int = DEFAULTS.broadcast_bytes,
) -> DataFrame:
    """Best ``n`` rows per query by BM25: ``query_id, rank, <key>, score``; ties by key.

    ``among`` (the key column) restricts the rows; counts and lengths are then those of
    the restricted rows, as if only they were indexed. ``seen``, two accumulators, counts
    pairs of block and query with a word in common: all, and those left out by their bound.
    Query terms beyond ``limit`` bytes are searched in several passes.
    """
    spark = queries.sparkSession
    docs = _tables(spark, store, "docs")
    if among is not None:
        rows = docs.select("block", F.inline(F.arrays_zip("offs", "keys", "n_words")))
        rows = rows.join(among.select(F.col(store.key).alias("keys")).distinct(), "keys", "left_semi")
        docs = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("offs", "keys", "n_words"))).alias("own")).select(
            "block", *[F.col(f"own.{c}").alias(c) for c in ("offs", "keys", "n_words")],
        )
    docs = docs.withColumn("shard", F.shiftright("block", SHARD_BITS))
    totals = docs.select(F.inline(F.transform("n_words", lambda w: F.struct(w.alias("w"))))).agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("avg")).first()
    terms, small, longest = _terms(queries, query_id, text)
    terms = stage(terms, "terms")
    prefixes = terms.select("prefix").distinct()
    folders = [r[0] for r in prefixes.select(letters(F.col("prefix"))).distinct().collect()]  # at most LETTER_FOLDERS
    vocabulary = _tables(spark, store, "vocabulary").where(F.col("letters").isin(folders)).select("word").distinct()
    matching = stage(_matching_words(vocabulary, prefixes, small, longest).select("word", "prefix"), "matching-words")
    size = matching.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("prefix") + 32), F.lit(0))).first()[0]
    chosen = F.broadcast(matching) if size <= limit else matching
    postings = _tables(spark, store, "postings").where(F.col("letters").isin(folders)).join(chosen, "word")
    postings = stage(postings.select(F.shiftright("block", SHARD_BITS).alias("shard"), "block", "prefix", "offs", "freqs", "most"), "matching-postings")

    def having(left: pa.Table, right: pa.Table) -> pa.Table:
        names = left.column("prefix").unique().to_pylist()
        shard = _Shard(left, right, {p: i for i, p in enumerate(names)})
        total = np.zeros(len(names), np.int64)
        for k in range(len(shard.blocks)):
            used, own, _ = shard.used(k)
            total[used] += np.count_nonzero(shard.counts(k, own, len(used)), axis=0)
        return pa.table({"prefix": pa.array(names, pa.string()), "n_with": total})

    spread = postings.groupBy("shard").cogroup(docs.groupBy("shard")).applyInArrow(having, "prefix string, n_with long").groupBy("prefix").agg(F.sum("n_with").alias("n_with"))
    raw_idf = F.log((F.lit(totals["n"]) - F.col("n_with") + 0.5) / (F.col("n_with") + 0.5))
    weights = stage(terms.join(spread.where("n_with > 0"), "prefix").select(
        query_id, "prefix", (F.when(raw_idf <= 0, F.lit(1e-6)).otherwise(raw_idf) * F.col("repeats")).alias("weight"),
    ), "term-weights")
    key_type = docs.schema["keys"].dataType.elementType
    shape = StructType().add("query", "long").add(store.key, key_type).add("score", "double")
    average, ranked = float(totals["avg"] or 1.0) or 1.0, None
    for piece in _pieces(weights, query_id, limit):
        names = piece.column(query_id).unique()
        query_no = {q: i for i, q in enumerate(names.to_pylist())}
        shared = spark.sparkContext.broadcast((
            np.array([query_no[q] for q in piece.column(query_id).to_pylist()], np.int64), piece.column("prefix").to_pylist(), piece.column("weight").to_numpy(),
        ))

        found = postings.groupBy("shard").cogroup(docs.groupBy("shard")).applyInArrow(_scorer(shared, len(query_no), n, digits, average, store.key, seen), shape)
        numbers = spark.createDataFrame(pa.table({query_id: names, "query": np.arange(len(names))}), StructType([queries.schema[query_id]]).add("query", "long"))
        part = found.join(F.broadcast(numbers), "query").select(query_id, store.key, "score")
        ranked = part if ranked is None else ranked.unionByName(part)
    out = keep_best(ranked, [query_id], [F.desc("score"), F.asc(store.key)], n)
    return out.select(query_id, "rank", store.key, "score")


class _Best:
    """Rows that can be among a query's best ``n``: all that reach its n-th score so far, ties included."""

    def __init__(self, n: int, queries: int, digits: int) -> None:
        self.n, self.digits, self.floor = n, digits, np.full(queries, -np.inf)
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, queries: np.ndarray, scores: np.ndarray, first: int) -> None:
        rounded = np.round(scores, self.digits)
        row, column = np.nonzero((scores > 0) & (rounded >= self.floor[queries]))
        query = np.concatenate((self.query, queries[column]))
        place = np.concatenate((self.row, first + row))
        score = np.concatenate((self.score, rounded[row, column]))
        order = np.lexsort((-score, query))
        query, place, score = query[order], place[order], score[order]
        starts = np.searchsorted(query, query)
        nth = np.minimum(starts + self.n - 1, len(query) - 1)
        enough = query[nth] == query if len(query) else np.zeros(0, bool)
        full = enough & (nth - starts == self.n - 1)
        self.floor[query[full]] = score[nth[full]]
        keep = score >= self.floor[query]
        self.query, self.row, self.score = query[keep], place[keep], score[keep]
