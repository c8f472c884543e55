"""Which names of a table a text holds: an Aho-Corasick automaton in arrays, walked by many texts at once.

The automaton is built once from the name table and travels to every executor as three
files that tasks map into memory; a table whose automaton would pass the bound is cut into
pieces, and the texts pass one piece after the other. Texts are cut into windows that
overlap by the longest name, and all windows of a batch take a step together.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docketry.functions.text import drop_whitespace, nfc
from docketry.settings import DEFAULTS

#: Characters a window owns, bits of a code point, and bytes that a state takes in the arrays at most.
WINDOW, CODE_BITS, STATE_BYTES = 1_024, 21, 32
_FIRST, _LAST, _OLD = 0xAC00, 0xD7A3, ord("구")


def automaton(names: list[str]) -> dict[str, np.ndarray]:
    """States as arrays: ``moves`` (state and code point, sorted) to ``targets``, ``fail``, the
    name that ends in a state (or -1), and the next state on its way of failures where one ends."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for number, name in enumerate(names):
        state = 0
        for letter in map(ord, name):
            if letter not in children[state]:
                children[state][letter] = len(children)
                children.append({})
                ends.append(-1)
            state = children[state][letter]
        ends[state] = number
    fail, other = np.zeros(len(children), np.int32), np.full(len(children), -1, np.int32)
    line = list(children[0].values())
    for state in line:  # grows: states by depth
        for letter, child in children[state].items():
            back = int(fail[state])
            while back and letter not in children[back]:
                back = int(fail[back])
            fail[child] = children[back].get(letter, 0)
            other[child] = fail[child] if ends[fail[child]] >= 0 else other[fail[child]]
            line.append(child)
    moves = np.array([s << CODE_BITS | c for s, own in enumerate(children) for c in own], np.int64)
    targets = np.array([t for own in children for t in own.values()], np.int32)
    order = np.argsort(moves)
    return {"moves": moves[order], "targets": targets[order], "fail": fail, "ends": np.array(ends, np.int32), "other": other}


def _steps(arrays: dict[str, np.ndarray], state: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The states after one letter each."""
    out = np.zeros(len(state), np.int64)
    todo = np.arange(len(state))
    at = state
    moves, targets = arrays["moves"], arrays["targets"]
    while len(todo):
        key = at << CODE_BITS | letter[todo]
        place = np.minimum(np.searchsorted(moves, key), len(moves) - 1)
        found = moves[place] == key
        out[todo[found]] = targets[place[found]]
        rest = ~found & (at > 0)  # at the root a letter without a move stays there
        todo, at = todo[rest], arrays["fail"][at[rest]].astype(np.int64)
    return out


def matches(arrays: dict[str, np.ndarray], codes: np.ndarray, bounds: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in texts laid end to end (``bounds`` between them): text, end, name."""
    counts = -(-np.diff(bounds) // WINDOW)
    text = np.repeat(np.arange(len(counts)), counts)
    own = bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    at, stop = np.maximum(own - longest + 1, bounds[:-1][text]), np.minimum(own + WINDOW, bounds[1:][text])
    state = np.zeros(len(text), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(text):
        state = _steps(arrays, state, codes[at].astype(np.int64))
        here = np.where(arrays["ends"][state] >= 0, state, arrays["other"][state])
        mine = np.flatnonzero((here >= 0) & (at >= own))
        while len(mine):
            hit = here[mine]
            found.append((text[mine], at[mine] + 1, arrays["ends"][hit]))
            here[mine] = arrays["other"][hit]
            mine = mine[here[mine] >= 0]
        at = at + 1
        more = at < stop
        if not more.all():
            text, own, at, stop, state = text[more], own[more], at[more], stop[more], state[more]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part).astype(np.int64) for part in zip(*found))


def free_standing(codes: np.ndarray, bounds: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Occurrences that do not follow another Hangul syllable, except the mark of an old version."""
    first = start == bounds[:-1][text]
    before = codes[np.maximum(start - 1, 0)]
    return first | (before == _OLD) | (before < _FIRST) | (before > _LAST)


def _shipped(spark: SparkSession, arrays: dict[str, np.ndarray]) -> dict[str, str]:
    names = {}
    folder = tempfile.mkdtemp(prefix="docketry-")
    for key, array in arrays.items():
        names[key] = f"names-{key}-{uuid.uuid4().hex}.npy"
        np.save(os.path.join(folder, names[key]), array)
        spark.sparkContext.addFile(os.path.join(folder, names[key]))
    return names


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [x or "" for x in column.to_pylist()]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def _pass(rows: DataFrame, known: list[tuple[str, str]], into: str, text: str) -> DataFrame:
    """``rows`` with the canonical names of ``known`` found in ``text`` added to ``into``."""
    spark = rows.sparkSession
    spelled = [name for name, _ in known]
    titles = pa.array([title for _, title in known], pa.string())
    files, longest = _shipped(spark, automaton(spelled)), max(map(len, spelled))
    lengths = spark.sparkContext.broadcast((np.array([len(x) for x in spelled], np.int64), titles))
    place, held = rows.columns.index(text), rows.columns.index(into)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {key: np.load(SparkFiles.get(name), mmap_mode="r") for key, name in files.items()}
        size, titles = lengths.value
        for batch in batches:
            codes, bounds = _codes(batch.column(place))
            row, end, name = matches(arrays, codes, bounds, longest)
            keep = free_standing(codes, bounds, row, end - size[name])
            pairs = np.unique(np.stack([row[keep], name[keep]], axis=1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
            # What a row has so far comes with its own titles.
            old = batch.column(held)
            every = [set(x) for x in old.to_pylist()]
            for r, title in zip(pairs[:, 0].tolist(), titles.take(pa.array(pairs[:, 1])).to_pylist()):
                every[r].add(title)
            columns = list(batch.columns)
            columns[held] = pa.array([sorted(x) for x in every], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(read, rows.schema)


def names_cited(rows: DataFrame, text: str, names: DataFrame, into: str = "cited", limit: int = DEFAULTS.broadcast_bytes) -> DataFrame:
    """``rows`` with ``into``: the sorted canonical names of ``names`` (name, canonical) that ``text`` cites.

    White space in texts is ignored and both sides are NFC. A name directly after another
    Hangul syllable does not count, except after ``구``, the mark of an old version. Null
    and blank names are left out, a null text cites nothing. A name given with several
    canonical names stands for the smallest. Tables beyond ``limit`` bytes of automaton are
    searched piece by piece, so each piece costs another pass over the texts.
    """
    clean = names.select(F.trim(nfc(F.col("name"))).alias("name"), F.trim(F.col("canonical")).alias("canonical"))
    clean = clean.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("canonical", F.lit("")) != ""))
    clean = clean.groupBy("name").agg(F.min("canonical").alias("canonical"))
    size = clean.agg(F.coalesce(F.sum((F.length("name") + 1) * STATE_BYTES), F.lit(0))).first()[0]
    pieces = max(1, -(-size // limit))
    out = rows.withColumns({
        "_searched": drop_whitespace(nfc(F.coalesce(F.col(text), F.lit("")))), into: F.array().cast("array<string>"),
    })
    shape = StructType([StructField(f.name, ArrayType(StringType()) if f.name == into else f.dataType) for f in out.schema])
    out = out.to(shape)
    for piece in range(pieces):
        some = clean if pieces == 1 else clean.where(F.pmod(F.xxhash64("name"), F.lit(pieces)) == piece)
        known = [(r["name"], r["canonical"]) for r in some.orderBy("name").toLocalIterator()]
        if known:
            out = _pass(out, known, into, "_searched")
    return out.drop("_searched")
