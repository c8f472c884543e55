"""Mined phrases against counting every run of words."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import collocations
from docketry.llm.collocations import Mining
from docketry.llm.textbytes import raw
from tests.llm import cases

SMALL = Mining(least=3, gather=200, part_words=50, filter_bits=1 << 15, together=5)


def by_hand(rows, mining):
    found, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(cases.LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(own)
            for n in range(1, mining.max_words + 1):
                found[lang].update(tuple(own[i:i + n]) for i in range(len(own) - n + 1))
    out = []
    for lang, f in found.items():
        whole = [p for p in f if len(p) > 1 and f[p] >= mining.least]
        gone = {
            p[i:j] for p in whole for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and 100 * f[p] >= mining.dominated * f[p[i:j]]
        }
        scored = []
        for p in whole:
            if p not in gone:
                score, _, k = min((mining.scale * f[p] // (f[p[:k]] + f[p[k:]]), k, k) for k in range(1, len(p)))
                scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:mining.top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def run(spark, tmp_path, rows, mining):
    df = cases.table(spark, [(i, text, lang, "s", i) for i, (lang, text) in enumerate(rows)], extra=True)
    df = df.withColumns({c: F.lit(1) for c in ("print", "phrase", "n", "grp", "part")})
    return sorted(map(tuple, collocations.collocations(cases.settled(spark, df, tmp_path), mining).collect()))


def awkward():
    rng = np.random.default_rng(4)
    rows = [
        ("en", None), ("en", ""), (None, " \t "), (None, "a b c d a b c d a b c d e"), ("und", "a b c d. A B C D"), ("en", "New York,new york\tNEW YORK; new\x0byork new york"),
        ("de", "straße öl 漢字 🙂 straße öl 漢字 🙂! straße öl 漢字 🙂?"), ("en", "x " * 500), ("", "p q p q p q p q"), ("en", "..,,;;"), ("en", "x" * 50_000 + " y"),
    ]
    for k in range(60):
        rows.append((("en", "de", None)[k % 3], " ".join(f"w{int(x)}" + (". " if x % 7 == 0 else "") for x in rng.zipf(1.5, 80) if x < 40)))
    return rows + rows[-10:]


@pytest.mark.parametrize("mining", [SMALL, Mining(least=2, max_words=2), Mining(least=5, top=3, dominated=50)])
def test_awkward_texts(spark, tmp_path, mining):
    rows = awkward()
    assert run(spark, tmp_path, rows, mining) == by_hand(rows, mining)


def test_colliding_fingerprints_are_told_apart(spark, tmp_path, monkeypatch):
    """With fingerprints of few values nearly all n-grams collide; the texts keep them apart."""
    rows = awkward()
    plain = collocations.Texts.prints
    monkeypatch.setattr(collocations.Texts, "prints", lambda self, at, n, second=False: plain(self, at, n, second) % np.uint64(1 << 62 if second else 13))
    docs = spark.createDataFrame([(lang, text, k) for k, (lang, text) in enumerate(rows)], "lang string, text string, at long").collect()
    words = collocations.Vocabulary()
    data, ends = raw(pa.array([r.text for r in docs]))
    texts = collocations.Texts(data, ends, np.zeros(len(docs), np.uint64), words)
    at = texts.grams(2)
    pairs = np.stack([texts.numbers[at], texts.numbers[at + 1]], axis=1).astype(np.int32)
    made = collocations.combined({
        "print": texts.prints(at, 2), "check": texts.prints(at, 2, True), "count": np.ones(len(at), np.int64), "at": texts.rows[at], "off": at, "n": np.full(len(at), 2, np.uint8), "words": pairs,
    })
    want = Counter(map(tuple, pairs.tolist()))
    assert {tuple(w): c for w, c in zip(made["words"].tolist(), made["count"].tolist())} == want and len(set(made["print"].tolist())) <= 13


def test_systematic_words_have_their_own_fingerprints():
    """Words on which polynomials modulo a power of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    data, ends = raw(pa.array([one + " " + two]))
    texts = collocations.Texts(data, ends, np.zeros(1, np.uint64), collocations.Vocabulary())
    assert len(set(texts.prints(np.arange(2), 1).tolist())) == 2


def test_fingerprints_depend_on_words_and_lang_alone():
    data, ends = raw(pa.array(["one two  three", "zero one\ttwo", "one two"]))
    texts = collocations.Texts(data, ends, np.array([1, 1, 2], np.uint64), collocations.Vocabulary())
    prints = texts.prints(texts.grams(2), 2).tolist()  # one two, two three, zero one, one two, one two
    assert prints[0] == prints[3] != prints[4] and len(set(prints)) == 4


def test_an_empty_table_has_no_phrases(spark, tmp_path):
    assert run(spark, tmp_path, [], Mining()) == [] and run(spark, tmp_path, [(None, None)], Mining()) == []


def test_pairs_with_equal_letter_sums_have_their_own_fingerprints():
    """Sums of letters at like places agree in many pairs of short words."""
    letters = "abcd"
    pairs = [f"{a}{b} {c}{d}" for a in letters for b in letters for c in letters for d in letters]
    data, ends = raw(pa.array(pairs))
    texts = collocations.Texts(data, ends, np.zeros(len(pairs), np.uint64), collocations.Vocabulary())
    for second in (False, True):
        assert len(set(texts.prints(texts.grams(2), 2, second).tolist())) == len(pairs)


def test_a_counting_task_keeps_little_beside_its_entries():
    """Entries leave in small batches, and joining or hashing them takes no second copy of everything."""
    import tracemalloc

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    mining = collocations.Mining()
    count = collocations._counted(Rows(), (2,), {}, 64, mining)
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(10_000, 10**9, 2_000))) for _ in range(450)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(texts))), pa.array(["en"] * len(texts)), pa.array(texts)], names=["at", "lang", "text"],
    )
    tracemalloc.start()
    sent = [(b.nbytes, sum(len(x) // 8 for x in b.column("print").to_pylist())) for b in count(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, n in sent) == len(texts) * 1_999
    assert max(size for size, _ in sent) < 2 * collocations.BATCH
    assert peak < 200 << 20
