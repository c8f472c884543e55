"""The manifest's proofs against trees built by hand."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docketry.llm import merkle
from tests.llm import cases


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def by_hand(rows: list[tuple]) -> list[tuple]:
    """rows: doc_id, source, lang, n_chars, text."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {lang: levels([leaf(r) for r in groups[lang]]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, row in enumerate(groups[lang]):
            hit = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            acc, beside = leaf((*row[:3], row[3] + 1, row[4])) if hit else leaf(row), ""
            for tree, at in ((trees[lang], i), (top, k)):
                for nodes in tree[:-1]:
                    other = nodes[at ^ 1] if at ^ 1 < len(nodes) else None
                    acc = sha(acc if other is None else other + acc if at & 1 else acc + other)
                    beside, at = beside + (other or ""), at // 2
            out.append((row[0], leaf(row), trees[lang][-1][0], top[-1][0], sha(beside), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def ordered(docs) -> list[tuple]:
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_proofs_of_awkward_rows(spark, tmp_path, bits):
    """Nulls everywhere, repeated rows and ids, very long texts, clashing columns."""
    docs = cases.settled(spark, cases.table(spark, extra=True), tmp_path)
    docs = docs.withColumns({c: F.lit(1) for c in ("rank", "grp", "leaf", "n", "number")})
    assert sorted(map(tuple, merkle.audited(docs, bits).collect()), key=repr) == by_hand(ordered(docs))


@pytest.mark.parametrize("sizes", [[1], [2], [3], [1, 1], [5, 1, 16, 17], [1] * 9])
def test_trees_of_all_shapes(spark, tmp_path, sizes):
    rows = [(100 * k + i, f"t{i}", None if k == 0 else f"l{k}", "s", i if i % 3 else None) for k, n in enumerate(sizes) for i in range(n)]
    docs = cases.settled(spark, cases.table(spark, rows), tmp_path)
    got = sorted(map(tuple, merkle.audited(docs, 2).collect()), key=repr)
    assert got == by_hand(ordered(docs)) and len(got) == sum(sizes)


def test_a_hot_repeated_row_keeps_every_proof(spark, tmp_path):
    rows = [(5, "same", "en", "s", 4)] * 300 + [(i, f"t{i}", "en", "s", i) for i in range(100)]
    docs = cases.settled(spark, cases.table(spark, rows), tmp_path)
    got = sorted(map(tuple, merkle.audited(docs, 3).collect()), key=repr)
    assert got == by_hand(ordered(docs))


def test_proofs_of_some_leaves_only(spark, tmp_path):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", i) for i in range(50)]
    docs = cases.settled(spark, cases.table(spark, rows), tmp_path)
    tree = merkle.manifest(docs, 2)
    asked = tree.leaves.where("doc_id in (0, 7, 49)").select("grp", "rank", F.struct("doc_id", "leaf").alias("payload"))
    got = merkle.proofs(tree, asked).withColumn("again", merkle.fold(F.col("payload.leaf"), F.col("siblings"))).collect()
    assert sorted(r.payload.doc_id for r in got) == [0, 7, 49] and all(r.again == r.root for r in got)


def test_an_empty_table_has_no_rows(spark, tmp_path):
    assert merkle.audited(cases.settled(spark, cases.table(spark, []), tmp_path)).collect() == []
