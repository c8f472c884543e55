"""Byte-level BPE with a lexicon of frequent words in a minimal acyclic transducer.

The words of a corpus are counted, the frequent ones are merged once and compiled into an
automaton that shares suffixes; its edges add up to a word's number, which leads to the
word's ids. Tasks memory-map the automaton and walk all new words of a chunk through it
together. Words it lacks go through the exact merges.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.shipping import mapped, ship_arrays
from docketry.session import stage

# Fixed value: the pattern that splits text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORD = regex.compile(PATTERN)
# The same for texts below code point 256, whose letters, numbers and spaces can be listed.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN_WORD = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


@dataclass(frozen=True)
class Lexicon:
    """``size``: pieces compiled; ``cache``: words a task remembers; ``chunk``: characters handled together."""

    size: int = 131_072
    cache: int = 200_000
    chunk: int = 1_000_000
    max_bytes: int = 64 << 20


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where visible, else the next free code point."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merger:
    """The vocabulary and merge table of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _alphabet(), spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.pieces: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.pieces[i] = token.encode()
        single = {self.pieces[i]: i for i in vocab.values() if len(self.pieces[i]) == 1}
        self.of_byte = [single[bytes([b])] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(pairs)}

    def ids(self, word: bytes) -> list[int]:
        """Merge the best-ranked pair, leftmost first, until none is left; a heap keeps long words linear-logarithmic."""
        symbols = [self.of_byte[b] for b in word]
        if len(symbols) > 64:
            return self._long_ids(symbols)
        size, none, made, rank = self.size, len(self.made), self.made, self.rank.get
        ranks = [rank(a * size + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i] = made[best]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] * size + symbols[i], none)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] * size + symbols[i + 1], none)
        return symbols

    def _long_ids(self, symbols: list[int]) -> list[int]:
        size, rank = self.size, self.rank
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        heap = [(rank[p], i, p) for i, p in enumerate(a * size + b for a, b in zip(symbols, symbols[1:])) if p in rank]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (p := symbols[i] * size + symbols[after[i]]) in rank:
                heapq.heappush(heap, (rank[p], i, p))

        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] * size + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = self.made[best], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal automaton of distinct words in byte order.

    ``keys`` holds state * 256 + byte of every edge in order, ``targets`` its end and
    ``skips`` how many words of its start precede those behind it, so the skips along a
    word sum up to the word's place in the list.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    sizes: list[int] = []

    def settle(final: bool, edges: list) -> int:
        signature = (final, tuple(edges))
        if signature not in register:
            register[signature] = len(states)
            states.append(signature)
            sizes.append(final + sum(sizes[target] for _, target in edges))
        return register[signature]

    open_states: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(open_states) - 1 > depth:
            state = settle(*open_states.pop())
            open_states[-1][1].append((last[len(open_states) - 1], state))

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        close(shared)
        open_states.extend([False, []] for _ in range(len(word) - shared))
        open_states[-1][0] = True
        last = word
    close(0)
    root = settle(*open_states[0])
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(states):
        passed = int(final)
        for byte, target in edges:
            keys.append(state * 256 + byte)
            targets.append(target)
            skips.append(passed)
            passed += sizes[target]
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "skips": np.array(skips, np.int32),
        "finals": np.array([final for final, _ in states], np.uint8), "root": np.array([root], np.int64),
    }


def word_numbers(table: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Place of each word in the compiled list, -1 where it is missing; all walk together."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    keys, found = table["keys"], np.full(len(words), -1, np.int64)
    live = np.arange(len(words))
    state, number = np.full(len(words), int(table["root"][0]), np.int64), np.zeros(len(words), np.int64)
    depth = 0
    while len(live):
        over = sizes[live] == depth
        ended = over & (table["finals"][state] == 1)
        found[live[ended]] = number[ended]
        live, state, number = live[~over], state[~over], number[~over]
        if not len(live) or not len(keys):
            break
        wanted = state * 256 + data[starts[live] + depth]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        live, at = live[hit], at[hit]
        state, number = table["targets"][at].astype(np.int64), number[hit] + table["skips"][at]
        depth += 1
    return found


def split_words(text: str, specials: dict[str, int]) -> list[str]:
    """Words of a text in order; a special token's string stays whole."""
    if not any(s in text for s in specials):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return WORD.findall(text)
        return LATIN_WORD.findall(text)
    cut = regex.split("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")", text)
    return [w for part in cut for w in ([part] if part in specials else WORD.findall(part))]


def _chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def count_pieces(docs: DataFrame, text_col: str = "text", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Pieces between spaces with their counts over all texts; what a chunk has once is left to the exact merges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for a, b in _chunks(texts, lexicon.chunk):
                seen = Counter(" ".join(texts[a:b]).split(" "))
                some = [(w, n) for w, n in seen.items() if n > 1 and len(w) < 64]
                yield pa.RecordBatch.from_arrays([
                    pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64()),
                ], names=["piece", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(
        F.sum("n").alias("n"),
    )


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", lexicon: Lexicon = Lexicon()) -> dict[str, str]:
    """Compile the words of the most frequent pieces and send the automaton to the executors."""
    counts = stage(count_pieces(docs, text_col, lexicon), "pieces").withColumn("level", F.floor(F.log2("n") * 64))
    # The lowest level of counts from which on the pieces fit; levels are few at any size.
    room, level = lexicon.size, None
    for row in counts.groupBy("level").count().orderBy(F.col("level").desc()).collect():
        room -= row["count"]
        if room < 0:
            break
        level = row["level"]
    top = [] if level is None else counts.where(F.col("level") >= level).select("piece").collect()  # at most lexicon.size rows
    rules = merger(path)
    found = {w for row in top for w in split_words(" " + row["piece"], rules.specials)}
    words = sorted(w.encode() for w in found if w not in rules.specials)
    ids = [rules.ids(w) for w in words]
    arrays = compile_words(words) | {
        "ends": np.cumsum([len(i) for i in ids] or [0]).astype(np.int64),
        "ids": np.array([i for word in ids for i in word], np.int32),
    }
    return ship_arrays(docs.sparkSession, "lexicon", arrays, lexicon.max_bytes)


class Encoder:
    """Ids of words inside a task: remembered, from the automaton, or merged."""

    def __init__(self, rules: Merger, table: dict[str, np.ndarray], room: int) -> None:
        self.rules, self.table, self.room = rules, table, room
        self.known: dict[str, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        self.known = {token: (i,) for token, i in self.rules.specials.items()}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.room:
            self.reset()
            new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        numbers = word_numbers(self.table, raw)
        ends = self.table["ends"]
        highs = ends[np.maximum(numbers, 0)]
        lows = np.where(numbers > 0, ends[np.maximum(numbers - 1, 0)], 0)
        flat = self.table["ids"]
        for word, piece, number, low, high in zip(new, raw, numbers.tolist(), lows.tolist(), highs.tolist()):
            self.known[word] = tuple(flat[low:high].tolist()) if number >= 0 else tuple(self.rules.ids(piece))


class Decoder:
    """Texts of ids inside a task: the bytes of all ids, read as UTF-8 with faulty bytes replaced."""

    def __init__(self, rules: Merger) -> None:
        self.sizes = np.array([len(p) for p in rules.pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.stock = np.frombuffer(b"".join(rules.pieces), np.uint8)

    def texts(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        width = self.sizes[flat]
        at = np.concatenate(([0], np.cumsum(width)))
        data = self.stock[np.repeat(self.starts[flat] - at[:-1], width) + np.arange(at[-1])].tobytes()
        bounds = at[ends].tolist()
        return [data[x:y].decode("utf-8", "replace") for x, y in zip(bounds[:-1], bounds[1:])]


def encode(
    docs: DataFrame, path: str, names: dict[str, str], id_col: str = "doc_id", text_col: str = "text", lexicon: Lexicon = Lexicon(),
    decoded: bool = False,
) -> DataFrame:
    """One row per input row: doc_id and the ids of the whole text; with ``decoded`` also what they stand for.

    A null or empty text has no ids. Repeated rows and null ids are rows like others, an
    empty table gives no rows, other columns are ignored.
    """
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = merger(SparkFiles.get(name))
        encoder, decoder = Encoder(rules, mapped(names), lexicon.cache), Decoder(rules)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts, lexicon.chunk):
                words = [split_words(t, rules.specials) for t in texts[a:b]]
                encoder.learn(set().union(*words))
                find = encoder.known.__getitem__
                docs_ids = [np.fromiter(chain.from_iterable(map(find, doc)), np.int32) for doc in words]
                flat = np.concatenate(docs_ids)
                ends = np.concatenate(([0], np.cumsum([len(i) for i in docs_ids]))).astype(np.int32)
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    columns.append(pa.array(decoder.texts(flat, ends), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][:len(columns)])

    docs.sparkSession.sparkContext.addFile(path)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to a table of doc_id and ids; null ids stand for an empty text."""
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(merger(SparkFiles.get(name)))
        for batch in batches:
            ids = batch.column(1)
            ends = np.asarray(ids.offsets, np.int64)
            texts = decoder.texts(np.asarray(ids.values, np.int64)[ends[0]:ends[-1]], ends - ends[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    encoded.sparkSession.sparkContext.addFile(path)
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(
        run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>, decoded string",
    )


def encode_documents(docs: DataFrame, path: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Build the lexicon of ``docs`` and encode and decode every row in one pass."""
    return encode(docs, path, build_lexicon(docs, path, lexicon=lexicon), lexicon=lexicon, decoded=True)
