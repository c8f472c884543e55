"""Exact inner-product search over vectors placed in cells, with whole cells left out by a bound.

Rows lie in folders by the nearest of at most ``cells`` centres, which are fitted on a
bounded sample; every row is placed. For a cell with centre c and radius r no row scores
more than q.c + |q| r (Cauchy-Schwarz). A search first scans, for each query, the cells
with the highest bounds that hold ``k`` rows together, which gives a score to beat, and
then only the cells whose bound reaches it. Cells that no query needs are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from docketry.operators.ranking import BestOf, _matrix, keep_best
from docketry.session import stage
from docketry.settings import DEFAULTS

#: Rows that centres are fitted on, rounds of fitting, and most cells.
SAMPLE_ROWS, ROUNDS, CELLS = 20_000, 6, 1_024


@dataclass(frozen=True)
class VectorIndex:
    """``path`` holds cell=<n>/ (id, vector); ``cells`` has a row per cell: cell, centre, radius, n."""

    path: str
    id_col: str
    rows: DataFrame
    cells: DataFrame
    dim: int


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """A few rounds of moving centres to the means of what is nearest to them."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)] if len(sample) else np.zeros((1, 0))
    for _ in range(ROUNDS):
        own = _nearest_centre(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1) if len(rows) else np.zeros(0, np.int64)


def build(corpus: DataFrame, path: str, id_col: str, vector: str = "vector", cells: int | None = None) -> VectorIndex:
    """Place all rows that have a vector under ``path``.

    ``cells`` defaults to the root of the number of rows, CELLS at most. A vector of another
    length than the first one's, or with an element that is null or not finite, fails the
    job and names the row.
    """
    spark = corpus.sparkSession
    slim = corpus.where(F.col(vector).isNotNull()).select(F.col(id_col), F.col(vector).cast("array<double>").alias("vector"))
    n = slim.count()
    cells = cells or max(1, min(CELLS, int(n**0.5)))
    share = min(1.0, 1.1 * SAMPLE_ROWS / max(n, 1))
    picked = slim.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < share * 1_000_003).limit(SAMPLE_ROWS).toArrow()
    dim = len(picked.column("vector")[0]) if picked.num_rows else 0
    centres = _centres(_matrix(picked.column(0), picked.column("vector").combine_chunks(), dim, "row"), cells)
    shared = spark.sparkContext.broadcast(centres)  # CELLS vectors at most
    schema = StructType([slim.schema[id_col]]).add("vector", ArrayType(DoubleType())).add("cell", "integer").add("off", "double")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            rows = _matrix(batch.column(0), batch.column(1), centres.shape[1], "row")
            own = _nearest_centre(rows, centres)
            off = np.sqrt(((rows - centres[own]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(off)], names=schema.names)

    placed = stage(slim.mapInArrow(place, schema), "placed-vectors")
    # A large cell is dealt to several writers; a folder is a cell whatever its number of files.
    parts = F.pmod(F.xxhash64(id_col), F.lit(16))
    placed.drop("off").repartition("cell", parts).write.partitionBy("cell").parquet(f"{path}/rows")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    placed.groupBy("cell").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n")).join(F.broadcast(table), "cell").write.parquet(f"{path}/cells")
    return open_index(corpus, path, id_col)


def open_index(corpus: DataFrame, path: str, id_col: str) -> VectorIndex:
    """An index written earlier; ``corpus`` gives the type of its ids."""
    spark = corpus.sparkSession
    shape = StructType([corpus.schema[id_col]]).add("vector", ArrayType(DoubleType())).add("cell", "integer")
    cells = spark.read.parquet(f"{path}/cells")
    first = cells.select(F.size("centre")).first()
    return VectorIndex(path, id_col, spark.read.schema(shape).parquet(f"{path}/rows"), cells, first[0] if first else 0)


def _scan(index: VectorIndex, names: pa.Array, matrix: np.ndarray, needed: np.ndarray, cells: np.ndarray, k: int, query_id: str, schema: StructType, digits: int) -> DataFrame | None:
    """Best ``k`` per task of the pairs of query and cell in ``needed`` (cells x queries)."""
    live = np.flatnonzero(needed.any(axis=1))
    if not len(live):
        return None
    spark = index.rows.sparkSession
    shared = spark.sparkContext.broadcast((names, matrix, {int(cells[c]): np.flatnonzero(needed[c]) for c in live}))
    wanted = index.rows.where(F.col("cell").isin([int(cells[c]) for c in live]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, asked = shared.value
        best, kind = BestOf(matrix, k, digits), None
        for batch in batches:
            kind = batch.column(0).type
            ids, rows = np.array(batch.column(0).to_pylist(), dtype=object), _matrix(batch.column(0), batch.column(1), matrix.shape[1], "row")
            own = batch.column(2).to_numpy()
            for cell in np.unique(own):
                best.add(ids[own == cell], rows[own == cell], asked[int(cell)])
        if kind is not None:
            counts = [len(x) for x in best.ids]
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(np.repeat(np.arange(len(names)), counts))), pa.array([i for x in best.ids for i in x], type=kind),
                pa.array(np.concatenate(best.scores), type=pa.float64()),
            ], names=schema.names)

    return wanted.select(index.id_col, "vector", "cell").mapInArrow(scan, schema)


def nearest_bounded(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector", digits: int = 6,
                    limit: int = DEFAULTS.broadcast_bytes, seen: list | None = None) -> DataFrame:
    """Exact top-``k`` as :func:`ranking.nearest` gives them: ``query_id, rank, <id>, score``.

    Queries come in pieces whose vectors and bounds take at most ``limit`` bytes. ``seen``
    is given a pair for each piece: pairs of query and cell, and those left out.
    """
    spark = queries.sparkSession
    cells = index.cells.orderBy("cell").toArrow()  # CELLS rows at most
    numbers = cells.column("cell").to_numpy()
    centres = np.array(cells.column("centre").to_pylist(), dtype=np.float64).reshape(len(numbers), index.dim)
    radius, sizes = cells.column("radius").to_numpy(), cells.column("n").to_numpy()
    schema = StructType([StructField(query_id, queries.schema[query_id].dataType), index.rows.schema[index.id_col]]).add("score", "double")
    slim = queries.select(query_id, F.col(vector).cast("array<double>").alias("v"))
    pieces = max(1, -(-queries.count() * 8 * (2 * index.dim + 4 * len(numbers) + 8) // limit))
    found = []
    for piece in range(pieces):
        part = (slim if pieces == 1 else slim.where(F.pmod(F.xxhash64(query_id), F.lit(pieces)) == piece)).toArrow()
        if not part.num_rows or not len(numbers):
            continue
        names = part.column(0).combine_chunks()
        matrix = _matrix(part.column(0), part.column(1).combine_chunks(), index.dim, "query")
        bound = centres @ matrix.T + np.outer(radius, np.sqrt((matrix**2).sum(axis=1))) + 2 * 10.0**-digits
        order = np.argsort(-bound, axis=0, kind="stable")
        before = np.cumsum(sizes[order], axis=0) - sizes[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=0)  # cells until k rows are there
        begun = stage(_scan(index, names, matrix, first, numbers, k, query_id, schema, digits), "first-cells")
        floors = keep_best(begun, [query_id], [F.desc("score")], k).groupBy(query_id).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
        reached = {r[0]: r["floor"] for r in floors.where(F.col("n") == k).collect()}  # one number per query of the piece
        floor = np.array([reached.get(q, -np.inf) for q in names.to_pylist()])
        rest = (bound >= floor) & ~first
        if seen is not None:
            seen.append((bound.size, bound.size - int(np.count_nonzero(first | rest))))
        found.append(begun)
        more = _scan(index, names, matrix, rest, numbers, k, query_id, schema, digits)
        if more is not None:
            found.append(more)
    if not found:
        found.append(spark.createDataFrame([], schema))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return keep_best(every, [query_id], [F.desc("score"), F.asc(index.id_col)], k).select(query_id, "rank", index.id_col, "score")
