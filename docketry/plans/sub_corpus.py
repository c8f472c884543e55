"""A sub-corpus of rules with the fate of every file, from one parse."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docketry.functions.text import strip
from docketry.operators import filters
from docketry.plans.corpus import folder_of
from docketry.session import stage
from docketry.sources import parsers as P

# What can become of a file.
OUTCOMES = ("kept", "dropped", "denied", "rejected", "skipped")


@dataclass(frozen=True)
class SubCorpus:
    """Kept documents; a row per file (path, scope, doc_id, outcome, term); files by outcome."""

    docs: DataFrame
    files: DataFrame
    counts: dict[str, int]


def listed(lines: DataFrame, column: str = "value") -> list[str]:
    """Terms of a list file, in its order: a term a line, blank lines and ``#`` comments left out.

    A list is what an editor keeps by hand; it becomes part of the plan.
    """
    term = strip(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "#.*$", ""))
    rows = lines.select(term.alias("term"), F.monotonically_increasing_id().alias("at")).where("term <> ''")
    return [r["term"] for r in rows.orderBy("at").toLocalIterator()]


def rules_sub_corpus(files: DataFrame, include: Iterable[str], deny: Iterable[str]) -> SubCorpus:
    """Canonical rules of the folders that hold an ``include`` term and no ``deny`` term.

    Every file has one outcome: ``skipped`` (no term), ``denied`` (with the denying term),
    ``rejected`` (with the parser's reason), ``dropped`` (an older revision) or ``kept``. The
    chosen files are parsed once, into one table that all outputs read; the counts are
    observed while the outcomes are written.
    """
    include, deny = list(include), list(deny)
    chosen = files.select("path", "content", folder_of().alias("scope")).withColumn("choice", filters.keyword_decision(F.col("scope"), include, deny))
    parsed = P.parse_rules(chosen.where("choice.keep").select("path", "content"))
    scope = folder_of()
    parsed = stage(parsed.withColumn("scope", scope).withColumn("matched", filters.first_keyword(scope, include)), "parsed-rules")
    best = P.canonical_rules(parsed)
    winners = best.select("path", F.lit(True).alias("wins"))
    read = parsed.join(winners, "path", "left").select(
        "path", "scope", F.when(F.col("reject_reason").isNull(), F.col("doc_id")).alias("doc_id"),
        F.when(F.col("reject_reason").isNotNull(), "rejected").when(F.col("wins"), "kept").otherwise("dropped").alias("outcome"),
        F.coalesce("reject_reason", "matched").alias("term"),
    )
    unread = chosen.where(~F.coalesce("choice.keep", F.lit(False))).select(
        "path", "scope", F.lit(None).cast("string").alias("doc_id"),
        F.when(F.col("choice.matched").isNull(), "skipped").otherwise("denied").alias("outcome"),
        F.when(F.col("choice.matched").isNotNull(), F.col("choice.denied")).alias("term"),
    )
    seen = Observation()
    fates = read.unionByName(unread).observe(seen, *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    fates = stage(fates, "file-outcomes")
    return SubCorpus(best.drop("matched", "scope"), fates, seen.get)
