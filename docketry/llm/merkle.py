"""A Merkle manifest of a table: a content-addressed store of digests, and proofs by descent.

Every row is a leaf; the leaves of a language form a binary tree over the rows in id order,
and the languages' roots form one more. The store maps the digest of a node to the digests
``2**bits`` ranks wide below it (its inner nodes are hashed again when it is opened). A
request for a leaf starts at the root and opens one record per digit of its rank; requests
with the same leading digits travel together. At each record the nodes that were not
selected are collected, one for each binary level, and the collected path is reversed.

Rows are numbered by a range partitioning: no window holds a language. Pages of a level are
grouped by rank, so the largest group is a record, whatever the sizes of the languages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.session import stage

#: Tables of languages up to this many rows are sent to every executor; larger ones are joined by shuffle.
SMALL_LANGS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<digest:string,right:boolean>"


@dataclass(frozen=True)
class Tree:
    """``leaves`` (grp, rank, leaf, doc_id, lang, changed), ``langs`` (grp, lang, n, rounds, subroot),
    ``root`` (one row: digest, n, rounds), records of the language trees and of the top tree."""

    leaves: DataFrame
    langs: DataFrame
    root: DataFrame
    records: DataFrame
    top_records: DataFrame
    bits: int


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, changed (the leaf after tampering, or the leaf itself) and the row's place."""
    parts = [field(F.col(c)) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = [field(F.col("n_chars") + 1) if c == "n_chars" else p for c, p in zip(FIELDS, parts)]
    leaf = digest(*parts)
    return docs.select(
        F.col("doc_id"), F.col("lang"), leaf.alias("leaf"),
        F.when(hit & F.col("n_chars").isNotNull(), digest(*altered)).alias("changed"),
        F.monotonically_increasing_id().alias("at"),
    )


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``number``, counted from 0 in the given order over the whole table.

    Rows are range-partitioned and sorted; each partition's start is the sum of the
    partitions before it, a table with one row per partition.
    """
    placed = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), label,
    )
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = parts.select("part", (upto - F.col("first")).alias("shift"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn(
        "number", F.col("place") + F.col("shift"),
    ).drop("part", "shift", "place")


def _halved(nodes: Column) -> Column:
    """The next binary level: each two nodes' digest, a last one without a partner alone."""
    last = F.call_function("shiftright", F.size(nodes) - 1, F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), last), lambda k: digest(F.get(nodes, k * 2), F.coalesce(F.get(nodes, k * 2 + 1), F.lit(""))),
    )


def _opened(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` (children, height) with l0 to l<bits>: the nodes of every binary level of a record."""
    rows = rows.withColumn("l0", F.col("children"))
    for i in range(bits):
        below = F.col(f"l{i}")
        rows = rows.withColumn(f"l{i + 1}", F.when(F.col("height") > i, _halved(below)).otherwise(below))
    return rows


def build(nodes: DataFrame, most: int, bits: int, label: str) -> tuple[DataFrame, DataFrame | None]:
    """Trees over ``nodes`` (grp, rank, digest, n; n is the group's size, ``most`` the largest).

    Gives the groups' roots (grp, digest) and the store (digest, children, height). The last
    node of a level without a partner is hashed alone; a group of one node is its own root.
    """
    spark = nodes.sparkSession
    level, roots, stores = nodes.select("grp", "rank", "digest", "n"), [], []
    while True:
        roots.append(level.where("n = 1").select("grp", "digest"))
        if most <= 1:
            break
        paged = level.where("n > 1").groupBy("grp", F.shiftright("rank", bits).alias("page")).agg(
            F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("own"), F.max("n").alias("n"),
        ).select(
            "grp", "page", F.transform("own", lambda x: x["digest"]).alias("children"),
            # Binary levels of the record: all of them, or as many as it takes down to the only root.
            F.when(F.col("n") > 1 << bits, F.lit(bits)).otherwise(F.length(F.bin(F.col("n") - 1))).alias("height"),
            F.ceil(F.col("n") / F.lit(1 << bits)).cast("long").alias("n"),
        )
        made = stage(_opened(paged, bits).select("grp", F.col("page").alias("rank"), "n", F.get(f"l{bits}", F.lit(0)).alias("digest"), "children", "height"), label)
        stores.append(made.select("digest", "children", "height"))
        level, most = made.select("grp", "rank", "digest", "n"), -(-most // (1 << bits))
    for k in range(1, len(roots)):
        roots[0] = roots[0].unionByName(roots[k])
    for k in range(1, len(stores)):
        stores[0] = stores[0].unionByName(stores[k])
    return roots[0], stores[0] if stores else spark.createDataFrame([], "digest string, children array<string>, height int")


def rounds_of(n: Column, bits: int) -> Column:
    """Digits of a rank: how many records lie between a group's root and its leaves."""
    return F.when(n > 1, F.ceil(F.length(F.bin(n - 1)) / F.lit(bits))).otherwise(0).cast("int")


def manifest(docs: DataFrame, bits: int = 8) -> Tree:
    """The trees of all rows of ``docs``, ordered by lang (null first, by bytes) and doc_id.

    Null ids come first; rows with the same id are ordered by their digests, and equal rows
    stay rows of their own. Any column may be null; an empty table has no root. Other
    columns are ignored. ``docs`` has to be re-readable in the same order.
    """
    rows = numbered(stage(leaf_rows(docs), "merkle-leaves"), ["lang", "doc_id", "leaf", "at"], "merkle-order")
    counts = stage(rows.groupBy("lang").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-counts")
    langs = stage(numbered(counts, ["lang"], "merkle-langs").withColumnRenamed("number", "grp"), "merkle-groups")
    n_langs, most = langs.agg(F.count(F.lit(1)), F.max("n")).first()
    known = langs.select("grp", F.col("lang").alias("_lang"), "first", "n")
    if n_langs <= SMALL_LANGS:
        known = F.broadcast(known)
    leaves = stage(rows.join(known, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "grp", (F.col("number") - F.col("first")).alias("rank"), "n", "leaf", "doc_id", "lang", "changed",
    ), "merkle-ranked")
    subroots, records = build(leaves.withColumnRenamed("leaf", "digest"), most or 0, bits, "merkle-store")
    langs = stage(langs.join(subroots.withColumnRenamed("digest", "subroot"), "grp"), "merkle-subroots")
    over = langs.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("rank"), F.col("subroot").alias("digest"), F.lit(n_langs).cast("long").alias("n"))
    root, top = build(over, n_langs, bits, "merkle-top")
    root = root.select("digest", F.lit(n_langs).cast("long").alias("n"), rounds_of(F.lit(n_langs), bits).alias("rounds"))
    return Tree(leaves, langs.withColumn("rounds", rounds_of(F.col("n"), bits)), root, records, top, bits)


def descend(starts: DataFrame, requests: DataFrame, records: DataFrame, most_rounds: int, bits: int) -> DataFrame:
    """Paths of the requested leaves, from their group's root down.

    ``starts`` has a row per group (grp, rounds, digest, path, carry), ``requests`` (grp,
    rank, payload). Gives payload, carry and path: the given path and below it, level by
    level, the node that was not selected (null where a node had no partner) and whether it
    stands on the right.
    """
    mask = (1 << bits) - 1
    wanted = [requests.groupBy("grp", F.shiftright("rank", bits).alias("page")).agg(
        F.collect_list(F.struct(F.col("rank").bitwiseAND(mask).cast("int").alias("digit"), "payload")).alias("asked"),
    )]
    for _ in range(1, most_rounds):
        wanted.append(wanted[-1].select("grp", "page").groupBy("grp", F.shiftright("page", bits).alias("up")).agg(
            F.collect_list(F.struct(F.col("page").bitwiseAND(mask).cast("int").alias("digit"))).alias("asked"),
        ).withColumnRenamed("up", "page"))
    alone = starts.where("rounds = 0").select("grp", "path", "carry")
    found = requests.where("rank = 0").join(alone, "grp").select("payload", "carry", "path")
    came = None
    for j in reversed(range(most_rounds)):
        new = starts.where(F.col("rounds") == j + 1).select("grp", F.lit(0).cast("long").alias("page"), "digest", "path", "carry")
        came = new if came is None else came.unionByName(new)
        opened = _opened(came.join(records.dropDuplicates(["digest"]), "digest"), bits)
        opened = opened.withColumn("levels", F.array(*[F.col(f"l{i}") for i in range(bits)])).select("grp", "page", "path", "carry", "height", "levels")
        met = wanted[j].join(opened, ["grp", "page"])

        def step(i: Column, digit: Column) -> Column:
            own = F.call_function("shiftright", digit, i)
            other = own.bitwiseXOR(F.lit(1))
            return F.struct(F.get(F.get("levels", i), other).alias("digest"), (other > own).alias("right")).cast(STEP)

        def path(digit: Column) -> Column:
            down = F.sequence(F.col("height") - 1, F.lit(0), F.lit(-1))
            return F.concat(F.col("path"), F.transform(down, lambda i: step(i, digit)))

        if j:
            each = F.transform("asked", lambda a: F.struct(
                (F.shiftleft("page", bits) + a["digit"]).alias("page"), F.get(F.get("levels", F.lit(0)), a["digit"]).alias("digest"),
                path(a["digit"]).alias("path"),
            ))
            came = met.select("grp", "carry", F.inline(each)).select("grp", "page", "digest", "path", "carry")
        else:
            each = F.transform("asked", lambda a: F.struct(a["payload"].alias("payload"), path(a["digit"]).alias("path")))
            found = found.unionByName(met.select("carry", F.inline(each)).select("payload", "carry", "path"))
    return found


def fold(start: Column, upwards: Column) -> Column:
    """The root that a leaf and the nodes beside its path give."""
    return F.aggregate(upwards, start, lambda acc, s: F.sha2(F.when(s["digest"].isNull(), acc).when(
        s["right"], F.concat(acc, s["digest"]),
    ).otherwise(F.concat(s["digest"], acc)), 256))


def proofs(tree: Tree, requests: DataFrame) -> DataFrame:
    """Siblings from leaf to root for requested leaves (grp, rank, payload): payload, subroot, root, siblings.

    A sibling is a digest, null where its level's last node stood alone, and whether it is
    on the right. First the languages' roots are found below the one root, then the leaves.
    """
    rounds = tree.langs.agg(F.max("rounds")).first()[0] or 0
    top_rounds = (tree.root.first() or {"rounds": 0})["rounds"]
    none = F.array().cast(f"array<{STEP}>")
    begin = tree.root.select(F.lit(0).cast("long").alias("grp"), "rounds", "digest", none.alias("path"), F.struct(F.col("digest").alias("root")).alias("carry"))
    langs = tree.langs.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("rank"), F.struct("grp", "subroot", "rounds").alias("payload"))
    tops = stage(descend(begin, langs, tree.top_records, top_rounds, tree.bits), "merkle-tops")
    starts = tops.select(
        "payload.grp", "payload.rounds", F.col("payload.subroot").alias("digest"), "path",
        F.struct(F.col("payload.subroot").alias("subroot"), F.col("carry.root").alias("root")).alias("carry"),
    )
    found = descend(starts, requests, tree.records, rounds, tree.bits)
    return found.select("payload", "carry.subroot", "carry.root", F.reverse("path").alias("siblings"))


def audited(docs: DataFrame, bits: int = 8) -> DataFrame:
    """One row per input row: its leaf, roots, the digest of its proof, and the root refolded after tampering."""
    tree = manifest(docs, bits)
    asked = tree.leaves.select("grp", "rank", F.struct("doc_id", "leaf", "changed").alias("payload"))
    found = proofs(tree, asked)
    known = F.filter(F.transform("siblings", lambda s: s["digest"]), lambda d: d.isNotNull())
    out = found.select(
        "payload.doc_id", "payload.leaf", "subroot", "root", F.sha2(F.concat_ws("", known), 256).alias("proof_sha256"),
        fold(F.coalesce("payload.changed", "payload.leaf"), F.col("siblings")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
