"""Top-k ranking: exact inner-product search and the shared rank helpers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructField, StructType

from docketry.settings import DEFAULTS


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """All rows with a 1-based rank per group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def keep_best(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with a 1-based rank.

    ``row_number() <= k`` lets Spark cut each group to ``k`` rows in every map
    task before the shuffle, so a very large group costs ``k`` rows per task.
    """
    return numbered(df, by, order, rank).where(F.col(rank) <= k)


class BestOf:
    """Running top-k per query over vector batches.

    One partition of the whole score matrix finds the k-th best of every query; what
    ties with it stays in, so that ties resolve by id.
    """

    def __init__(self, queries: np.ndarray, k: int, digits: int):
        self.queries, self.k, self.digits = queries, k, digits
        self.scores = [np.empty(0) for _ in queries]
        self.ids: list[np.ndarray] = [np.empty(0, dtype=object) for _ in queries]

    def add(self, ids: np.ndarray, matrix: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Meet rows with all queries, or with those whose places are in ``asked``."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        self.meet(ids, np.round(matrix @ self.queries[asked].T, self.digits), asked)

    def meet(self, ids: np.ndarray, scores: np.ndarray, asked: np.ndarray) -> None:
        """Take the best of rounded scores, a row for each id and a column for each place of ``asked``; -inf is no hit."""
        n = len(scores)
        floor = np.partition(scores, n - self.k, axis=0)[n - self.k] if n > self.k else np.full(scores.shape[1], -np.inf)
        held = np.array([self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf for q in asked])
        keep = (scores >= np.maximum(floor, held)) & (scores > -np.inf)
        for place in np.flatnonzero(keep.any(axis=0)).tolist():
            q, column, chosen = asked[place], scores[:, place], np.flatnonzero(keep[:, place])
            merged_scores = np.concatenate([self.scores[q], column[chosen]])
            merged_ids = np.concatenate([self.ids[q], ids[chosen]])
            order = sorted(range(len(merged_scores)), key=lambda i: (-merged_scores[i], merged_ids[i] is not None, merged_ids[i]))[: self.k]
            self.scores[q], self.ids[q] = merged_scores[order], merged_ids[order]


def _query_blocks(queries: DataFrame, query_id: str, vector: str, limit: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Query vectors in pieces that each stay under ``limit`` bytes."""
    size = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim")
    ).first()
    blocks = max(1, -(-size["n"] * max(size["dim"], 1) * 8 // limit))
    slim = queries.select(query_id, F.col(vector).cast("array<double>").alias("v"))
    for block in range(blocks):
        part = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block)
        table = part.toArrow()
        if table.num_rows:
            yield table.column(0).combine_chunks(), _matrix(table.column(0), table.column(1).combine_chunks(), size["dim"], "query")


def _matrix(ids: pa.Array, vectors: pa.ListArray, size: int, what: str) -> np.ndarray:
    """Vectors as rows of a matrix; fails on another length, a null element or a number that is not finite."""
    lengths = np.diff(np.asarray(vectors.offsets))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths != size).any():
        at = int(np.flatnonzero(lengths != size)[0])
        raise ValueError(f"{what} {ids[at].as_py()!r}: vector of {lengths[at]} elements, not {size}")
    matrix = flat.reshape(len(lengths), size)
    bad = np.flatnonzero(~np.isfinite(matrix).all(axis=1))
    if len(bad):
        raise ValueError(f"{what} {ids[int(bad[0])].as_py()!r}: vector with an element that is null or not finite")
    return matrix


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str,
    query_id: str = "query_id",
    vector: str = "vector",
    digits: int = 6,
    block_bytes: int = DEFAULTS.broadcast_bytes,
) -> DataFrame:
    """Exact top-``k`` corpus rows per query by inner product.

    Each task multiplies Arrow batches of corpus vectors with the query matrix and
    emits only its own ``k`` best per query; one small window merges the tasks.
    The corpus itself is never shuffled. Query vectors travel in pieces of bounded
    size: a set beyond ``block_bytes`` takes one corpus pass per piece.

    Rows without a vector are skipped. A vector of another length than the queries'
    fails the job and names the row, as does an element that is null or not finite:
    such scores have no rank.

    Returns ``query_id, rank, <id_col>, score`` with scores rounded to ``digits``
    and ties broken by id.
    """
    spark = corpus.sparkSession
    slim = corpus.where(F.col(vector).isNotNull()).select(id_col, vector)
    id_type = slim.schema[id_col].dataType
    query_type = queries.schema[query_id].dataType
    schema = StructType(
        [StructField(query_id, query_type), StructField(id_col, id_type)]
    ).add("score", "double")

    partial: DataFrame | None = None
    for names, matrix in _query_blocks(queries, query_id, vector, block_bytes):
        shared = spark.sparkContext.broadcast((names, matrix))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best = BestOf(matrix, k, digits)
            kind = None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                kind = batch.column(0).type
                best.add(
                    np.array(batch.column(0).to_pylist(), dtype=object),
                    _matrix(batch.column(0), batch.column(1), matrix.shape[1], "row"),
                )
            if kind is not None:
                counts = [len(ids) for ids in best.ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(np.repeat(np.arange(len(names)), counts))),
                        pa.array([i for ids in best.ids for i in ids], type=kind),
                        pa.array(np.concatenate(best.scores), type=pa.float64()),
                    ],
                    names=[query_id, id_col, "score"],
                )

        found = slim.mapInArrow(scan, schema)
        partial = found if partial is None else partial.unionByName(found)
    if partial is None:
        partial = spark.createDataFrame([], schema)
    ranked = keep_best(partial, [query_id], [F.desc("score"), F.asc(id_col)], k)
    return ranked.select(query_id, "rank", id_col, "score")


def page(df: DataFrame, k: int, offset: int = 0, score: str = "score", key: str = "doc_id",
         by: Sequence[str] = ()) -> DataFrame:
    """Rows ``offset .. offset+k`` per query, highest score first, ties by key."""
    if offset < 0 or k < 1:
        raise ValueError("offset must be >= 0 and k >= 1")
    order = [F.desc(score), F.asc(key)]
    ranked = keep_best(df, by, order, offset + int(k), rank="position")
    return ranked.where(F.col("position") > offset)
