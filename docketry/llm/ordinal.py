"""Quality classifier: ordinal cumulative-link regression on hashed text.

All grades share one weight per hashed feature; ordered thresholds cut the score into
grades, so P(grade <= k) = logistic(threshold_k - score). The model is fitted on a
bounded, seeded sample of labelled rows in one task; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.shipping import mapped, ship_arrays
from docketry.llm.textbytes import blocks, mix, prefix_sums, range_hashes, token_bounds, word_bounds
from docketry.session import stage

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


@dataclass(frozen=True)
class Ordinal:
    """``sample``: labelled rows used at most; ``least_docs``: of them a feature needs;
    ``least_z``: standard errors by which its mean grade has to differ from all rows'; ``keep``: least P(grade >= top)."""

    grades: int = 3
    sample: int = 20_000
    least_docs: int = 5
    least_z: float = 4.0
    epochs: int = 40
    rate: float = 0.15
    decay: float = 2e-4
    batch: int = 512
    keep: float = 0.5
    seed: int = 29
    max_bytes: int = 256 << 20


def _buckets(share: np.ndarray) -> np.ndarray:
    return np.minimum((share * 10).astype(np.int64), 10)


def text_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit feature of everything present in a block of texts; a pair may occur more than once.

    Words without punctuation, A-Z lower-cased; their first four and five bytes; shapes of white-space words, with runs of
    like characters taken once; and how much of a text repeats the word before or any
    earlier word, in tenths.
    """
    rows = len(ends) - 1
    low, starts, stops, first = token_bounds(data, ends)
    sums = prefix_sums(low)
    words = range_hashes(sums, starts, stops)
    word_row = np.repeat(np.arange(rows), np.diff(first))
    stems, stem_rows = [], []
    for size in (4, 5):
        longer = stops - starts > size
        stems.append(mix(range_hashes(sums, starts[longer], starts[longer] + size) + np.uint64(size)))
        stem_rows.append(word_row[longer])
    kinds = _CLASS[data]
    begin, end, first_shape = word_bounds(data, ends)
    change = np.ones(len(kinds), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[begin] = True
    upto = np.concatenate(([0], np.cumsum(change)))
    shapes = mix(range_hashes(prefix_sums(kinds[change]), upto[begin], upto[end]) + np.uint64(1))
    shape_row = np.repeat(np.arange(rows), np.diff(first_shape))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1])
    order = np.lexsort((words, word_row))
    again = np.zeros(len(words), bool)
    again[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (word_row[order[1:]] == word_row[order[:-1]])
    counts = np.maximum(np.diff(first), 1)
    scale = np.minimum(np.log2(counts).astype(np.int64), 12)
    every = np.arange(rows)
    next_to = mix((_buckets(np.bincount(word_row[same], minlength=rows) / counts) + 1000).astype(np.uint64))
    spread = mix((_buckets(np.bincount(word_row[again], minlength=rows) / counts) + 100 * scale + 10_000).astype(np.uint64))
    return np.concatenate((word_row, *stem_rows, shape_row, every, every)), np.concatenate((words, *stems, shapes, next_to, spread))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(indptr: np.ndarray, features: np.ndarray, grades: np.ndarray, plan: Ordinal) -> dict[str, np.ndarray]:
    """Weights and thresholds from rows of distinct features (row i owns features[indptr[i]:indptr[i + 1]])."""
    keys, columns = np.unique(features, return_inverse=True)
    counts = np.bincount(columns, minlength=len(keys))
    apart = grades - grades.mean()
    shift = np.bincount(columns, np.repeat(apart, np.diff(indptr)), len(keys))
    often = (counts >= plan.least_docs) & (np.abs(shift) >= plan.least_z * max(apart.std(), 1e-9) * np.sqrt(counts))
    place = np.where(often, np.cumsum(often) - 1, -1)[columns]
    rows = np.repeat(np.arange(len(grades)), np.diff(indptr))[place >= 0]
    place = place[place >= 0]
    starts = np.searchsorted(rows, np.arange(len(grades) + 1))
    weights = np.zeros(int(often.sum()))
    squares = np.full(len(weights), 1e-8)
    share = np.cumsum(np.bincount(grades, minlength=plan.grades))[:-1] / max(1, len(grades))
    cuts = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    cuts = np.maximum.accumulate(cuts) + 1e-3 * np.arange(len(cuts))
    cut_squares = np.full(len(cuts), 1e-8)
    random = np.random.default_rng(plan.seed)
    for _ in range(plan.epochs if len(weights) else 0):
        for part in np.array_split(random.permutation(len(grades)), max(1, len(grades) // plan.batch)):
            spans = [place[starts[i]:starts[i + 1]] for i in part]
            sizes = np.array([len(s) for s in spans])
            own = np.concatenate(spans) if spans else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(part)), sizes)
            score = np.bincount(owner, weights[own], len(part))
            bounds = np.concatenate(([-np.inf], cuts, [np.inf]))
            below, above = _sigmoid(bounds[grades[part]] - score), _sigmoid(bounds[grades[part] + 1] - score)
            # Slopes of -log(above - below) in the score and in the thresholds.
            slope = 1 - above - below
            gap = np.maximum(above - below, 1e-9)
            step = np.bincount(own, slope[owner], len(weights)) / len(part) + plan.decay * weights
            squares += step * step
            weights -= plan.rate * step / np.sqrt(squares)
            push = np.zeros(len(cuts) + 2)
            np.add.at(push, grades[part] + 1, -above * (1 - above) / gap)
            np.add.at(push, grades[part], below * (1 - below) / gap)
            move = push[1:-1] / len(part)
            cut_squares += move * move
            cuts = np.maximum.accumulate(cuts - plan.rate * move / np.sqrt(cut_squares) * 0.1)
    return {"keys": keys[often], "weights": weights.astype(np.float32), "cuts": cuts}


def _distinct(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((features, rows))
    rows, features = rows[order], features[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (features[1:] != features[:-1])
    return rows[new], features[new]


def train(docs: DataFrame, labels: DataFrame, plan: Ordinal = Ordinal(), id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """Fit on at most ``plan.sample`` labelled ids (smallest hashes); ``labels`` has doc_id and grade.

    An id with several labels has its lowest grade; of several rows with one id the one
    whose features have the smallest hash counts. Rows without a grade or id do not count.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64(F.lit(plan.seed), "doc_id"), "doc_id").limit(plan.sample)
    )
    # At most plan.sample rows of two numbers, so the texts need no shuffle.
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id",
    ).select("text", "grade", "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in blocks(batch.column(0)):
                rows, found = _distinct(*text_features(data, ends))
                bounds = np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.view(np.int64))), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a),
                ], names=["features", "grade", "doc_id"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes, grades = [], [], []
        for batch in batches:
            ends = np.asarray(batch.column(0).offsets)
            parts.append(np.asarray(batch.column(0).values)[ends[0]:ends[-1]].view(np.uint64))
            sizes.append(np.diff(ends))
            grades.append(batch.column(1).to_numpy(zero_copy_only=False))
        if not parts:
            return
        indptr = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        model = fit(indptr, np.concatenate(parts), np.clip(np.concatenate(grades).astype(np.int64), 0, plan.grades - 1), plan)
        yield pa.RecordBatch.from_arrays([pa.array([model[k].tobytes()], pa.binary()) for k in ("keys", "weights", "cuts")], names=["keys", "weights", "cuts"])

    kind = docs.schema[id_col].dataType.simpleString()
    sampled = stage(known.mapInArrow(features, f"features array<long>, grade int, doc_id {kind}"), "labelled-features")
    # An id may be on many rows: one of them counts, so that the sample bounds the rows.
    single = sampled.groupBy("doc_id").agg(F.min_by("features", F.xxhash64("features")).alias("features"), F.min("grade").alias("grade"))
    ordered = single.select("features", "grade").repartition(1).sortWithinPartitions(F.xxhash64("features"), "grade")
    got = ordered.mapInArrow(solve, "keys binary, weights binary, cuts binary").first()
    if got is None:
        return {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0, np.float32), "cuts": np.zeros(plan.grades - 1)}
    return {
        "keys": np.frombuffer(got["keys"], np.uint64), "weights": np.frombuffer(got["weights"], np.float32), "cuts": np.frombuffer(got["cuts"], np.float64),
    }


def score(docs: DataFrame, model: dict[str, np.ndarray], plan: Ordinal = Ordinal(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, expected_grade, tail_probability and kept.

    ``tail_probability`` is P(grade >= top grade); a row is kept from ``plan.keep`` on.
    Null and empty texts have only the features of an empty text; repeated rows and null
    ids are rows like others, an empty table gives no rows. Without any label the score
    is 0 and the grades follow from thresholds of 0.
    """
    names = ship_arrays(docs.sparkSession, "ordinal", model, plan.max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = mapped(names)
        keys, weights, cuts = (np.asarray(table[k]) for k in ("keys", "weights", "cuts"))
        for batch in batches:
            scores = [np.zeros(0)]
            for a, b, data, ends in blocks(batch.column(1)):
                total = np.zeros(b - a)
                if len(keys):
                    rows, found = text_features(data, ends)
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    hit = keys[at] == found
                    rows, at = _distinct(rows[hit], at[hit])
                    total = np.bincount(rows, weights[at].astype(np.float64), b - a)
                scores.append(total)
            value = np.concatenate(scores)
            above = 1 - _sigmoid(cuts[None, :] - value[:, None])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(value), pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= plan.keep),
            ], names=["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(
        run, f"doc_id {dict(chosen.dtypes)['doc_id']}, score double, expected_grade double, tail_probability double, kept boolean",
    )
