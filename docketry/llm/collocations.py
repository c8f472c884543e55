"""Phrase mining with Rabin-Karp fingerprints.

A task reads whole texts, gives every distinct word an exact number and a polynomial
fingerprint of its bytes, and hashes all n-grams through prefix sums of the words'
fingerprints, modulo two primes. Equal n-grams of a task are counted together, after their
words have been compared by number; what crosses the shuffle is a fingerprint, its check (a
second one, with other bases), a count and one occurrence (the row's place and the word's
offset), packed in arrays for each part of the fingerprints. Parts add up the counts of
equal fingerprints, tell those with another check apart, and drop what is rarer than asked
for.

Three passes keep this small: words; pairs of frequent words; longer runs whose pairs are
all frequent. The frequent fingerprints of a pass travel to the next as a bitmap of a fixed
size. A bit set by another fingerprint lets a rare n-gram through to its own count; it never
drops one, so the result does not depend on the bitmap's size.

One occurrence of every frequent fingerprint is then looked up in the texts: only here do
phrases become strings, and a fingerprint or check that the text does not have fails the
job. Between tasks n-grams count as equal on 124 bits, inside a task on their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.shipping import mapped, ship_arrays
from docketry.llm.textbytes import LOWER, blocks, mix
from docketry.session import stage

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
#: Primes and bases of the polynomials: two for the fingerprint, two for its check.
FIELDS = tuple((np.uint64(prime), base) for prime, base in (
    (2**31 - 1, 1_163_962_801), (2**31 - 19, 1_907_531_273), (2**31 - 1, 748_664_025), (2**31 - 19, 1_283_169_405),
))

#: Bytes of words that are hashed at once, of texts that are read at once, and of entries that leave a task in one batch.
LETTERS, BLOCK, BATCH = 1 << 18, 1 << 20, 4 << 20


@dataclass(frozen=True)
class Mining:
    """``dominated``: a phrase is dropped if a longer one has this percentage of its count.

    The other numbers are sizes of work: entries that a task gathers before it sends them,
    entries of a part, bits of a bitmap, documents that are looked up together.
    """

    least: int = 30
    max_words: int = 4
    dominated: int = 80
    top: int = 2_000
    scale: int = 2_000_000
    gather: int = 700_000
    part_words: int = 2_000_000
    filter_bits: int = 1 << 27
    together: int = 2_000


class _Powers:
    """Powers of the bases and of their inverses, as long as they are asked for."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, size: int) -> None:
        if size <= self.size:
            return
        self.size = 1 << max(16, int(size - 1).bit_length())
        self.up, self.down = [], []
        for prime, base in FIELDS:
            for into, step in ((self.up, base), (self.down, pow(base, -1, int(prime)))):
                powers, length = np.ones(self.size, np.uint64), 1
                while length < self.size:
                    powers[length:2 * length] = powers[:length] * np.uint64(pow(step, length, int(prime))) % prime
                    length *= 2
                into.append(powers.astype(np.uint32))


_POWERS = _Powers()


def _prefixes(values: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of values (below the primes) times powers, one array for each field."""
    _POWERS.upto(len(values[0]) + 1)
    sums = []
    for value, (prime, _), powers in zip(values, FIELDS, _POWERS.up):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * powers[:len(value)] % prime, out=total[1:])
        sums.append(total)
    return sums


def _ranges(sums: list[np.ndarray], starts: np.ndarray, stops: np.ndarray, some: slice = slice(None)) -> list[np.ndarray]:
    """Polynomials of ranges, moved to power 0."""
    return [(total[stops] - total[starts]) % prime * down[starts] % prime for total, (prime, _), down in zip(sums[some], FIELDS[some], _POWERS.down[some])]


def lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _word_prints(letters: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Fingerprints of words given by their joined bytes and their bounds, one array for each field."""
    joined = letters.astype(np.uint64) + np.uint64(1)
    spelled = _ranges(_prefixes([joined] * len(FIELDS)), ends[:-1], ends[1:])
    # Mixed, so that sums over words do not depend on sums over letters.
    whole = [mix(spelled[k] << np.uint64(31) | spelled[k + 1]) for k in (0, 2)]
    return [mix(whole[k // 2] + np.uint64(k)) % prime for k, (prime, _) in enumerate(FIELDS)]


class Vocabulary:
    """Exact numbers for the words of a task, with their fingerprints; forgotten when large."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.halves = [np.zeros(0, np.uint64)] * len(FIELDS)

    def of(self, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of words given by their joined bytes and their lengths."""
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        numbers = known.fill_null(-1).to_numpy().astype(np.int32)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            fresh = coded.dictionary.take(pa.array(unknown))
            numbers[unknown] = len(self.words) + np.arange(len(unknown))
            self.words = pa.concat_arrays([self.words, fresh])
            _, ends, data = fresh.buffers()
            ends = np.frombuffer(ends, np.int64)[fresh.offset:fresh.offset + len(fresh) + 1]
            made, first = [self.halves], 0
            while first < len(fresh):  # in runs, so that powers and sums stay short
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + LETTERS, "right")) - 1)
                own = ends[first:last + 1] - ends[first]
                made.append(_word_prints(np.frombuffer(data, np.uint8)[ends[first]:ends[last]], own))
                first = last
            self.halves = [np.concatenate(parts) for parts in zip(*made)]
        return numbers[coded.indices.to_numpy()]


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the piece each lies in, and each row's first word."""
    broken = BREAK[data]
    inside = ~(broken | BLANK[data])
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = ends[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, ends)
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    pieces = np.cumsum(broken, dtype=np.int64)[starts] + rows if len(starts) else np.zeros(0, np.int64)
    return starts, stops, pieces, first


class Texts:
    """The words of some rows: numbers, prefix sums, pieces, and the rows' langs."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, langs: np.ndarray, words: Vocabulary) -> None:
        self.data = LOWER[data]
        self.starts, self.stops, self.pieces, self.first = word_bounds(self.data, ends)
        letters = self.data[~(BREAK | BLANK)[self.data]]
        self.numbers = words.of(letters, self.stops - self.starts) if len(self.starts) else np.zeros(0, np.int64)
        self.sums = _prefixes([half[self.numbers] for half in words.halves])
        self.rows = np.repeat(np.arange(len(ends) - 1), np.diff(self.first))
        self.langs = langs[self.rows]

    def grams(self, n: int) -> np.ndarray:
        """Positions of runs of ``n`` words within a piece."""
        size = len(self.pieces) - n + 1
        return np.flatnonzero(self.pieces[:size] == self.pieces[n - 1:]) if size > 0 else np.zeros(0, np.int64)

    def prints(self, at: np.ndarray, n: int, second: bool = False) -> np.ndarray:
        """Fingerprints of runs of ``n`` words, or their checks; a lang's and a length's own."""
        high, low = _ranges(self.sums, at, at + n, slice(2, 4) if second else slice(0, 2))
        return mix((high << np.uint64(31) | low) ^ self.langs[at] ^ (np.uint64(n) << np.uint64(61)))


def _keys(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    known = np.array([lang_key(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


ENTRY = (("print", np.uint64), ("check", np.uint64), ("count", np.int64), ("at", np.int64), ("off", np.uint32), ("n", np.uint8))


def combined(entries: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries of the same n-gram added up; of ``words`` (their numbers) equal fingerprints may differ, and stay apart."""
    prints, words = entries["print"], entries["words"]
    order = np.argsort(prints, kind="stable")
    new = np.concatenate(([True], prints[order][1:] != prints[order][:-1])) if len(order) else np.zeros(0, bool)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    if any((words[order, k] != words[head, k]).any() for k in range(words.shape[1])):
        order = np.lexsort((*words.T, prints))
        same = (prints[order][1:] == prints[order][:-1]) & (words[order][1:] == words[order][:-1]).all(axis=1)
        new = np.concatenate(([True], ~same))
    starts = np.flatnonzero(new)
    out = {k: v[order[starts]] for k, v in entries.items()}
    out["count"] = np.add.reduceat(entries["count"][order], starts) if len(starts) else entries["count"][:0]
    return out


def _in_filter(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = (prints % np.uint64(len(bits) * 8)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


SENT = "part int, print binary, check binary, count binary, at binary, off binary, n binary, lang string, words long"
SENT_SCHEMA = pa.schema([("part", pa.int32()), *[(k, pa.binary()) for k, _ in ENTRY], ("lang", pa.string()), ("words", pa.int64())])
FOUND = "print long, check long, count long, at long, off long, n int"
FOUND_SCHEMA = pa.schema([("print", pa.int64()), ("check", pa.int64()), ("count", pa.int64()), ("at", pa.int64()), ("off", pa.int64()), ("n", pa.int32())])


def _sent(entries: dict[str, np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Entries as one row of arrays for each part of the fingerprints, in batches of bounded size."""
    part = ((entries["print"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    width = sum(np.dtype(kind).itemsize for _, kind in ENTRY)
    rows, size = {k: [] for k in SENT_SCHEMA.names}, 0
    for k in np.flatnonzero(np.diff(bounds)):
        some = order[bounds[k]:bounds[k + 1]]
        rows["part"].append(int(k))
        for name, kind in ENTRY:
            rows[name].append(entries[name][some].astype(kind).tobytes())
        rows["lang"].append(None)
        rows["words"].append(None)
        size += len(some) * width
        if size >= BATCH:
            yield pa.RecordBatch.from_pydict(rows, SENT_SCHEMA)
            rows, size = {k: [] for k in SENT_SCHEMA.names}, 0
    if size:
        yield pa.RecordBatch.from_pydict(rows, SENT_SCHEMA)


def _counted(docs: DataFrame, lengths: tuple[int, ...], filters: dict[int, dict[str, str]], parts: int, mining: Mining) -> DataFrame:
    """Entries of all n-grams of some lengths whose parts pass the filters, packed; for words also their number by lang."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: mapped(names)["bits"] for n, names in filters.items()}
        words, held, size, totals = Vocabulary(), [], 0, {}
        width = max(lengths)

        def merged() -> dict[str, np.ndarray]:
            # Each column of the parts is given up as soon as it is joined.
            return combined({k: np.concatenate([h.pop(k) for h in held]) for k in list(held[0])})

        for batch in batches:
            places = batch.column(0).to_numpy()
            for start, end, data, ends in blocks(batch.column(2), BLOCK):
                own = batch.column(1).slice(start, end - start)
                texts = Texts(data, ends, _keys(own), words)
                if 1 in lengths:
                    for lang, count in zip(own.to_pylist(), np.diff(texts.first).tolist()):
                        totals[lang] = totals.get(lang, 0) + count
                pairs = None
                for n in lengths:
                    at = texts.grams(n)
                    if 1 in bits:
                        passed = np.concatenate((_in_filter(bits[1], texts.prints(np.arange(len(texts.numbers)), 1)), [False]))
                        at = at[np.all([passed[at + k] for k in range(n)], axis=0)] if len(at) else at
                    if 2 in bits:
                        if pairs is None:
                            two = texts.grams(2)
                            pairs = np.zeros(len(texts.numbers) + 1, bool)
                            pairs[two] = _in_filter(bits[2], texts.prints(two, 2))
                        at = at[np.all([pairs[at + k] for k in range(n - 1)], axis=0)] if len(at) else at
                    if not len(at):
                        continue
                    row = texts.rows[at]
                    of = np.full((len(at), width), -1, np.int32)
                    for k in range(n):
                        of[:, k] = texts.numbers[at + k]
                    held.append(combined({
                        "print": texts.prints(at, n), "check": texts.prints(at, n, True), "count": np.ones(len(at), np.int64), "at": places[start + row], "off": (at - texts.first[row]).astype(np.uint32),
                        "n": np.full(len(at), n, np.uint8), "words": of,
                    }))
                    size += len(held[-1]["print"])
                full = len(words.words) > mining.gather
                if held and (full or size > mining.gather):
                    held = [merged()]
                    size = len(held[0]["print"])
                    if full or 2 * size > mining.gather:
                        yield from _sent(held[0], parts)
                        held, size, words = [], 0, Vocabulary()
        if held:
            yield from _sent(merged(), parts)
        if totals:
            none = [None] * len(totals)
            yield pa.RecordBatch.from_pydict({"part": none, **{k: none for k, _ in ENTRY}, "lang": list(totals), "words": list(totals.values())}, SENT_SCHEMA)

    return docs.mapInArrow(read, SENT)


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows of a binary column one after the other, copied once."""
    runs = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        if len(chunk) and data is not None:
            ends = np.frombuffer(offsets, np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            runs.append(np.frombuffer(data, np.uint8)[ends[0]:ends[-1]])
    return np.concatenate(runs) if runs else np.zeros(0, np.uint8)


def _frequent(sent: DataFrame, least: int) -> DataFrame:
    """The frequent fingerprints with their counts and one occurrence each."""
    def total(key: tuple, table: pa.Table) -> pa.Table:
        own = {k: _joined(table.column(k)).view(kind) for k, kind in ENTRY}
        order = np.lexsort((own["check"], own["print"]))
        ranked, checks = own["print"][order], own["check"][order]
        starts = np.flatnonzero(np.concatenate(([True], (ranked[1:] != ranked[:-1]) | (checks[1:] != checks[:-1]))))
        sums = np.add.reduceat(own["count"][order], starts)
        keep = order[starts[sums >= least]]
        return pa.table([
            own["print"][keep].view(np.int64), own["check"][keep].view(np.int64), sums[sums >= least], own["at"][keep],
            own["off"][keep].astype(np.int64), own["n"][keep].astype(np.int32),
        ], schema=FOUND_SCHEMA)

    return sent.where("part is not null").select("part", *[k for k, _ in ENTRY]).groupBy("part").applyInArrow(total, FOUND)


def _filter(found: DataFrame, n: int, size: int) -> np.ndarray:
    """One bit for each fingerprint of length ``n``: at most ``size`` bits, whatever the data."""
    mask = F.col("print").bitwiseAND(size - 1) + 1
    made = found.where(F.col("n") == n).groupBy(F.bitmap_bucket_number(mask).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(mask)).alias("bits"),
    )
    bits = np.zeros(size // 8, np.uint8)
    for row in made.toLocalIterator():
        first = (row.bucket - 1) * 4096
        own = np.frombuffer(bytes(row.bits), np.uint8)[:max(0, len(bits) - first)]
        bits[first:first + len(own)] |= own
    return bits


def _looked_up(docs: DataFrame, found: DataFrame, n_docs: int, mining: Mining) -> DataFrame:
    """lang, phrase, n and count of entries, from the texts they point to."""
    groups = max(1, -(-n_docs // mining.together))
    made = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int32()), ("count", pa.int64())])

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        places = left.column("at").to_numpy()
        order = np.argsort(places)
        asked = {k: right.column(k).to_numpy() for k in ("print", "check", "count", "at", "off", "n")}
        langs, phrases, ns, counts = [], [], [], []
        slot = order[np.minimum(np.searchsorted(places, asked["at"], sorter=order), max(len(order) - 1, 0))] if len(order) else np.zeros(0, np.int64)
        if len(asked["at"]) and (not len(order) or (places[slot] != asked["at"]).any()):
            raise RuntimeError("a document of an earlier pass is not found again; docs has to be re-readable in the same order")
        by_slot = np.argsort(slot, kind="stable")
        column = left.column("text").combine_chunks()
        lang = left.column("lang").combine_chunks()
        for start, end, data, ends in blocks(column):
            some = by_slot[np.searchsorted(slot[by_slot], start):np.searchsorted(slot[by_slot], end)]
            if not len(some):
                continue
            texts = Texts(data, ends, _keys(lang.slice(start, end - start)), Vocabulary())
            at, n = texts.first[slot[some] - start] + asked["off"][some], asked["n"][some].astype(np.int64)
            if (at + n > len(texts.starts)).any():
                raise RuntimeError("a document changed between two passes")
            for length in np.unique(n):
                own = n == length
                for name in ("print", "check"):
                    if (texts.prints(at[own], int(length), name == "check").view(np.int64) != asked[name][some][own]).any():
                        raise RuntimeError("a document changed between two passes")
            raw, starts, stops = texts.data.tobytes(), texts.starts.tolist(), texts.stops.tolist()
            phrases += [b" ".join(raw[s:e] for s, e in zip(starts[a:a + k], stops[a:a + k])) for a, k in zip(at.tolist(), n.tolist())]
            langs.append(lang.take(pa.array(slot[some])))
            ns.append(n)
            counts.append(asked["count"][some])
        if not phrases:
            return made.empty_table()
        return pa.table([
            pa.concat_arrays(langs), pa.array(phrases, pa.binary()).cast(pa.string()), np.concatenate(ns).astype(np.int32), np.concatenate(counts),
        ], schema=made)

    group = F.pmod(F.xxhash64("at"), F.lit(groups)).alias("grp")
    return docs.select(group, "at", "lang", "text").groupBy("grp").cogroup(
        found.select(group, "print", "check", "count", "at", "off", "n").groupBy("grp"),
    ).applyInArrow(read, "lang string, phrase string, n int, count long")


def phrase_counts(docs: DataFrame, mining: Mining = Mining(), lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All runs of 1 to ``max_words`` words found ``least`` times in a language, and the languages' sizes.

    The first table has lang, phrase, n (its words) and count, the second lang and words.
    """
    spark = docs.sparkSession
    plain = docs.select(
        F.monotonically_increasing_id().alias("at"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    n_docs, n_bytes = plain.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    words = stage(_counted(plain, (1,), {}, max(16, -(-(n_bytes or 0) // (8 * mining.part_words))), mining), "phrase-words")
    sizes = words.where("lang is not null").groupBy("lang").agg(F.sum("words").alias("words"))
    sizes = stage(sizes.where("words > 0"), "phrase-sizes")
    total = sizes.agg(F.sum("words")).first()[0] or 0
    parts = max(16, -(-total // mining.part_words))
    found, filters = [stage(_frequent(words, mining.least), "phrase-found")], {}
    for lengths in ((2,), tuple(range(3, mining.max_words + 1))):
        if not lengths or lengths[0] > mining.max_words:
            break
        n = lengths[0] - 1
        filters[n] = ship_arrays(spark, f"phrases-{n}", {"bits": _filter(found[-1], n, mining.filter_bits)}, mining.filter_bits // 8)
        # Longer runs need frequent pairs only: these hold frequent words.
        found.append(stage(_frequent(_counted(plain, lengths, {n: filters[n]}, parts, mining), mining.least), "phrase-found"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return stage(_looked_up(plain, every, n_docs, mining), "phrases"), sizes


def _slice(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, mining: Mining = Mining(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into
    words at blanks and tabs. A phrase of 2 to ``max_words`` words with a occurrences, cut
    in two parts of l and r occurrences, scores floor(scale * a / (l + r)); its worst cut
    counts, the first of equal ones. Phrases inside a longer one that has ``dominated``
    percent of their occurrences are dropped. A null text has no words, a null lang is
    ``und``, repeated rows count as rows, an empty table gives no rows, other columns are
    ignored. ``docs`` has to be re-readable in the same order (a scan or a checkpoint).
    """
    phrases, sizes = phrase_counts(docs, mining, lang_col, text_col)
    words = F.split("phrase", " ")
    long = phrases.where("n > 1")
    cuts = long.select("lang", "phrase", "n", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")).select(
        "lang", "phrase", "n", "a", "k", _slice(words, F.lit(1), F.col("k")).alias("head"), _slice(words, F.col("k") + 1, F.col("n") - F.col("k")).alias("rest"),
    )
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("count").alias("times"))
    cuts = cuts.join(known.withColumnsRenamed({"part": "head", "times": "l"}), ["lang", "head"]).join(
        known.withColumnsRenamed({"part": "rest", "times": "r"}), ["lang", "rest"],
    )
    # Products may pass 64 bits.
    score = F.expr(f"cast({mining.scale} * cast(a as decimal(19, 0)) as decimal(38, 0)) div cast(cast(l as decimal(19, 0)) + r as decimal(38, 0))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("worst"),
    )
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("n") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: _slice(words, i, m)),
    ))
    longer = phrases.where("n > 2").select("lang", F.explode(inner).alias("phrase"), "count").groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100).cast("decimal(10,0)") * F.col("longer") < F.lit(mining.dominated).cast("decimal(10,0)") * F.col("a")),
    )
    order = Window.partitionBy("lang").orderBy(F.col("worst.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"),
        F.col("words").alias("n"), F.col("worst.score").alias("score"),
    )
