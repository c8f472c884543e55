"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are whole numbers (the floor of 256 times the value). The index has blocks of
vectors; in a block, every component is a posting of its dimension, and postings of like
quantised impact form a segment. A block meets a batch of queries in one task, which works
through the segments by descending impact and adds each to the accumulators of all queries.
What an accumulator may still be wrong by is at most the query's norm times the norm of
what the vector's postings do not yet cover (kept in the index for every level), so the
k-th best score has a lower bound and every vector an upper one. Segments are left out only
when these bounds leave few vectors open; those are scored exactly.

Blocks and batches have fixed sizes, whatever the table's. Their number grows with it, and
so does the work: every query is held against all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.session import stage

#: Vectors with a component beyond this take no part, so that scores fit 64 bits.
LARGEST = 2.0**17
INDEX = "block long, ids binary, known binary, ats binary, matrix binary, tails binary, docs binary, segments binary, dims int"
BATCH = "batch long, ids binary, known binary, ats binary, matrix binary, dims int"
HITS = "query_at long, query_id long, at long, vec_id long, score long"


@dataclass(frozen=True)
class Search:
    """``few``: share of a block's pairs that may be left to exact scoring; the rest are sizes of work."""

    k: int = 5
    block: int = 4_096
    batch: int = 1_024
    levels: int = 16
    few: float = 0.05


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, q (whole components) and the row's place, for vectors that take part."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).isNotNull().alias("some"), doubles.alias("x"),
        F.monotonically_increasing_id().alias("at"), usable.alias("usable"),
    ).where("some and usable").select("id", "at", F.transform("x", lambda x: F.floor(x * 256).cast("int")).alias("q"))


def _unpack(table: pa.Table) -> dict:
    """ids, known, ats and the matrix (vectors of unlike lengths are filled up with zeros)."""
    table = table.combine_chunks()
    q = table.column("q").combine_chunks()
    lengths = np.diff(q.offsets.to_numpy())
    values = q.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    matrix = np.zeros((len(q), int(lengths.max(initial=0))), np.int32)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = values
    ids = table.column("id")
    return {
        "ids": ids.fill_null(0).to_numpy().astype(np.int64), "known": ids.is_valid().to_numpy(), "ats": table.column("at").to_numpy().astype(np.int64),
        "matrix": matrix, "dims": matrix.shape[1],
    }


def _row(key: str, value: int, parts: dict, schema: pa.Schema) -> pa.Table:
    cells = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in parts.items()}
    return pa.table({n: [value if n == key else cells[n]] for n in schema.names}, schema)


INDEX_SCHEMA = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("ids", "known", "ats", "matrix", "tails", "docs", "segments")], ("dims", pa.int32())])
BATCH_SCHEMA = pa.schema([("batch", pa.int64()), *[(n, pa.binary()) for n in ("ids", "known", "ats", "matrix")], ("dims", pa.int32())])
HIT_SCHEMA = pa.schema([(n, pa.int64()) for n in ("query_at", "query_id", "at", "vec_id", "score")])


def postings(matrix: np.ndarray, levels: int) -> dict:
    """Segments by descending impact, their postings, and what is left of each vector after each level.

    ``segments`` has rows (level, dimension, impact, first, end); ``tails[l]`` are the norms
    of the vectors less the impacts of levels ``l`` and above, rounded up.
    """
    n, dims = matrix.shape
    size = np.abs(matrix)
    width = max(1, int(np.ceil((np.quantile(size, 0.999) if size.size else 0) / levels)))
    level = np.minimum(size // width, levels - 1)
    impact = np.sign(matrix) * (level + 0.5) * width
    tails = np.empty((levels, n), np.float32)
    for at in range(levels):
        left = matrix - np.where(level >= at, impact, 0)
        tails[at] = np.nextafter(np.sqrt((left * left).sum(axis=1)).astype(np.float32), np.float32(np.inf))
    doc, dim = np.nonzero(matrix)
    own = level[doc, dim]
    kind = ((levels - 1 - own) * max(dims, 1) + dim) * 2 + (matrix[doc, dim] > 0)
    order = np.argsort(kind, kind="stable")
    starts = np.flatnonzero(np.diff(kind[order], prepend=-1))
    heads = order[starts]
    segments = np.stack([own[heads], dim[heads], impact[doc[heads], dim[heads]], starts, np.append(starts[1:], len(order))], axis=1) if len(heads) else np.zeros((0, 5))
    return {"tails": tails, "docs": doc[order].astype(np.int32), "segments": segments.astype(np.float64)}


def _exact(block: dict, queries: dict, doc: np.ndarray, query: np.ndarray, dims: int) -> np.ndarray:
    out = np.empty(len(doc), np.int64)
    for k in range(0, len(doc), 1 << 15):
        some = slice(k, k + (1 << 15))
        out[some] = np.einsum("ij,ij->i", block["matrix"][doc[some], :dims].astype(np.int64), queries["matrix"][query[some], :dims].astype(np.int64))
    return out


def _kth_score(block: dict, queries: dict, low: np.ndarray, k: int, dims: int) -> np.ndarray:
    """A score that ``k`` vectors reach, for each query.

    The leaders of groups of vectors are scored exactly; the k-th of them is at most the
    k-th of all.
    """
    n, m = low.shape
    size = max(1, n // (4 * k))
    groups = n // size
    if groups < k:
        return np.full(m, -np.inf)
    leaders = low[:groups * size].reshape(groups, size, m).argmax(axis=1) + np.arange(groups)[:, None] * size
    scores = _exact(block, queries, leaders.ravel(), np.tile(np.arange(m), groups), dims).astype(np.float64).reshape(groups, m)
    scores[np.isneginf(low[leaders, np.arange(m)])] = -np.inf
    return np.partition(scores, groups - k, axis=0)[groups - k]


def score_block(block: dict, queries: dict, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Positions of queries and of vectors, and exact scores: all that can be among a query's best ``k`` here.

    The last value is the number of postings that were left out, for all queries.
    """
    n = len(block["ats"])
    dims = min(block["dims"], queries["dims"])
    asked = queries["matrix"][:, :dims].astype(np.float64)
    m = len(asked)
    rows = np.ascontiguousarray(asked.T)
    norms = np.sqrt((queries["matrix"].astype(np.float64) ** 2).sum(axis=1))
    own_doc, own_query = np.nonzero(block["ats"][:, None] == queries["ats"][None, :])
    scores = np.zeros((n, m))
    at, skipped = 0, 0
    segments, docs = block["segments"], block["docs"]
    for level in reversed(range(search.levels)):
        while at < len(segments) and segments[at, 0] == level:
            _, dim, impact, first, end = segments[at]
            if dim < dims:
                scores[docs[int(first):int(end)]] += impact * rows[int(dim)]
            at += 1
        if level and 3 * level > search.levels:
            continue  # little is covered yet
        slack = block["tails"][level].astype(np.float64)[:, None] * norms * (1 + 1e-9) + 1e-6
        low = scores - slack
        low[own_doc, own_query] = -np.inf
        floor = _kth_score(block, queries, low, search.k, dims)
        open_ = scores + slack >= floor
        open_[own_doc, own_query] = False
        if np.count_nonzero(open_) <= search.few * n * m + search.k * m:
            skipped = int((segments[at:, 4] - segments[at:, 3]).sum()) * m
            break
    doc, query = np.nonzero(open_)
    exact = _exact(block, queries, doc, query, dims)
    order = np.lexsort((block["ats"][doc], block["ids"][doc], ~block["known"][doc], -exact, query))
    query, doc, exact = query[order], doc[order], exact[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    keep = nth < search.k
    return query[keep], doc[keep], exact[keep], skipped


def _loaded(row: dict) -> dict:
    out = {
        "ids": np.frombuffer(row["ids"], np.int64), "known": np.frombuffer(row["known"], bool), "ats": np.frombuffer(row["ats"], np.int64), "dims": row["dims"],
    }
    out["matrix"] = np.frombuffer(row["matrix"], np.int32).reshape(len(out["ats"]), row["dims"])
    if "tails" in row:
        out |= {
            "tails": np.frombuffer(row["tails"], np.float32).reshape(-1, max(len(out["ats"]), 1)),
            "docs": np.frombuffer(row["docs"], np.int32), "segments": np.frombuffer(row["segments"], np.float64).reshape(-1, 5),
        }
    return out


def _numbers(last: int):
    # Both sides of the cogroup need the same type, or their keys are dealt differently.
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))


def build_index(vectors: DataFrame, search: Search = Search()) -> DataFrame:
    """The written index: a row per block of about ``search.block`` vectors (id, at, q)."""
    blocks = max(1, -(-vectors.count() // search.block))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        parts = _unpack(table)
        return _row("block", key[0].as_py(), parts | postings(parts["matrix"], search.levels), INDEX_SCHEMA)

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)))
    return stage(dealt.groupBy("block").applyInArrow(pack, INDEX), "impact-index")


def top_scores(index: DataFrame, queries: DataFrame, search: Search = Search()) -> DataFrame:
    """The ``k`` best rows of an index for each query (id, at, q): query_at, query_id, rank, vec_id, score.

    A query's own row (the same ``at``) is no candidate. Ties go to the smaller id, null
    ids last, then to the earlier row.
    """
    batches = max(1, -(-queries.count() // search.batch))
    last = index.agg(F.max("block")).first()[0]

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return _row("batch", key[0].as_py(), _unpack(table), BATCH_SCHEMA)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for batch in right.to_pylist():
            batch = _loaded(batch)
            for row in left.to_pylist():
                block = _loaded(row)
                for first in range(0, len(batch["ats"]), 256):  # accumulators that fit a cache
                    some = {k: v if k == "dims" else v[first:first + 256] for k, v in batch.items()}
                    q, d, score, _ = score_block(block, some, search)
                    found.append(pa.table([
                        some["ats"][q], pa.array(some["ids"][q], mask=~some["known"][q]), block["ats"][d],
                        pa.array(block["ids"][d], mask=~block["known"][d]), score,
                    ], schema=HIT_SCHEMA))
        return pa.concat_tables(found) if found else HIT_SCHEMA.empty_table()

    packed = queries.withColumn("batch", F.pmod(F.xxhash64("at"), F.lit(batches))).groupBy("batch").applyInArrow(pack, BATCH)
    asking = stage(packed, "impact-queries").withColumn("block", _numbers(last or 0))
    asked = index.withColumn("batch", _numbers(batches - 1))
    keys = ["block", "batch"]
    hits = asked.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(meet, HITS)
    order = Window.partitionBy("query_at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "at")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k).select("query_at", "query_id", "rank", "vec_id", "score")


def exact_top_k(rows: DataFrame, every: int = 50, search: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the rows whose id ``every`` divides, against all other rows.

    Vectors that are null, or hold a null, a NaN, an infinity or a value beyond 2**17, take
    no part. Vectors of unlike lengths are multiplied over what both have; an empty vector
    scores 0. A null id is no query; rows that share an id are queries and candidates of
    their own. An empty table gives no rows; other columns are ignored. ``rows`` has to be
    re-readable in the same order.
    """
    vectors = stage(whole_vectors(rows, id_col, vector_col), "impact-vectors")
    found = top_scores(build_index(vectors, search), vectors.where(F.col("id") % every == 0), search)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
