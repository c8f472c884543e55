"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("at", "key", "row", "body", "carried", "kept", "node", "stratum", "size")


def prose(seed: int, words: int) -> str:
    """Reproducible text without repeats."""
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 100_003}" for k in range(words))


def rows() -> list[tuple]:
    """Nulls in every column, empty, blank, very long, repeated and tied rows."""
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    texts = [
        base, base, "  " + base.replace(" ", "\t\n") + " ", " ".join(near), None, "", " \t\n", "one", "Two words",
        "ha " * 50, prose(5, 20_000), "é" * 30 + " ünïcödé 漢字 🙂 <|endoftext|> x", prose(9, 300), prose(9, 300), "#$% &|<>* " * 30,
        "line a\nline a\nline b\n\nline a", prose(12, 45),
    ]
    made = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "ß")[i % 4], i) for i, t in enumerate(texts)]
    return [*made, (None, base, None, None, None), (3, " ".join(near), "en", "b", 3), (7, "one", "de", "ß", 7)]


def table(spark, data=None, extra: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHING}) if extra else df


def settled(spark, df, folder):
    """The same rows from a file, so that they are read in one order."""
    path = str(folder / "rows.parquet")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    own = words(text)
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = [tuple(own[i:i + 8]) for i in range(len(own) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    return (
        len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    )


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for data in raw:
        gone = set()
        for i in range(len(data) - length + 1):
            if seen[data[i:i + length]] > 1:
                gone.update(range(i, i + length))
        spans = sum(i - 1 not in gone for i in gone)
        out.append((len(data), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(data) if i not in gone)).hexdigest()))
    return out


def shingle_set(text: str | None, size: int) -> frozenset:
    own = words((text or "").translate(LOWER))
    if len(own) < size:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i:i + size]) for i in range(len(own) - size + 1))


def near_components(texts: list[str | None], size: int, percent: int) -> list[int]:
    """Smallest row number reachable from each row."""
    sets = [shingle_set(t, size) for t in texts]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def targets(sizes: dict, repeat: int = 3) -> dict:
    """Shares by weight with overflow dealt out again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if repeat * sizes[s] <= weight[s] * level}
        if not full:
            out.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            out[s] = float(repeat * sizes[s])
            left -= out[s]
        open_ -= full
    return out
