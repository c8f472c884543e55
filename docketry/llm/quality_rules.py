"""Quality rules whose cut-offs are certified on labelled rows.

A rule is a score that grows as a text gets worse, with a fixed list of cut-offs. A good
labelled row that a cut-off would reject is a false rejection. A cut-off is usable in a
stratum when the exact binomial (Clopper-Pearson) upper bound of its false rejection rate
is at most the rule's share of ``max_rate``. The confidence is shared equally among all strata and rules
(Bonferroni); within a rule the cut-offs are tested from mild to strict and the first that
fails ends the sequence, which needs no further correction.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.binding import let
from docketry.session import stage

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8

#: Cut-offs from mild to strict, as shares; a row at or above the cut-off is rejected.
SHARES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)


@dataclass(frozen=True)
class Risk:
    """``max_rate``: false rejections allowed per stratum, shared equally by the rules; ``error``: chance that any bound is wrong."""

    max_rate: float = 0.05
    error: float = 0.05


RULES = ("symbol_share", "dup_line_share", "repeat_share", "shout_share", "same_word_share")


def words_of(text: Column) -> Column:
    """Words in order; a text with leading or trailing white space gives no empty words."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows of eight that occur twice or more.

    Windows are hashed and sorted with their places; neighbours with one hash are
    repeats. Their places, sorted again, cover eight words each, less where the next
    one starts earlier.
    """

    def places(ranked: Column) -> Column:
        def shared(x: Column, i: Column) -> Column:
            near = (F.get(ranked, i - 1)["key"], F.get(ranked, i + 1)["key"])
            return F.coalesce(near[0] == x["key"], F.lit(False)) | F.coalesce(near[1] == x["key"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ranked, shared), lambda x: x["at"]))

    def covered(spots: Column) -> Column:
        steps = F.transform(spots, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(spots, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

    def counted(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
        found = let(lambda ranked: let(covered, spots=places(ranked)), ranked=ranked)
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(found)

    # Single elements are looked up, as a slice would copy the whole array each time.
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) > WINDOW, let(counted, keys=windows)).otherwise(F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Counts and scores of every whole text; all of them stay inside the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), (carry if carry is not None else F.lit(None)).alias("carried"), text.alias("body"),
    )
    lines = F.filter(F.split("body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column, lines: Column) -> Column:
        def by_hash(hashes: Column) -> Column:
            same = F.filter(hashes, lambda h, i: h == F.get(hashes, i + 1))
            return F.struct(_repeated(hashes).cast("long").alias("repeat"), F.size(same).cast("long").alias("same"))

        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length("body") - F.length(F.regexp_replace("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.length("body") - F.length(F.replace("body", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
            let(by_hash, hashes=F.transform(words, lambda w: F.xxhash64(w))).alias("same_words"),
        )

    made = base.select("doc_id", "carried", let(counts, words=words_of(F.col("body")), lines=lines).alias("m"))
    return made.select(
        "doc_id", "carried", "m.*", F.col("m.same_words.repeat").alias("n_repeat_words"), F.col("m.same_words.same").alias("n_same_words"),
    ).drop("same_words")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def with_scores(counted: DataFrame) -> DataFrame:
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumns({
        "base_failed": base,
        "symbol_share": _share("n_symbols", "word_chars"), "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"), "shout_share": _share("n_shouts", "n_words"),
        "same_word_share": _share("n_same_words", "n_words"),
    })


def binomial_tail(hits: Column, total: Column, rate: float) -> Column:
    """P(X <= hits) for X ~ Binomial(total, rate), summed in logarithms from the first term."""
    odds = math.log(rate) - math.log1p(-rate)
    start = F.struct(
        (total * F.lit(math.log1p(-rate))).cast("double").alias("term"), (total * F.lit(math.log1p(-rate))).cast("double").alias("sum"),
    )

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((total - i + 1).cast("double") / i) + F.lit(odds)
        top = F.greatest(acc["sum"], term)
        return F.struct(
            term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"),
        )

    steps = F.when(hits > 0, F.sequence(F.lit(1).cast("long"), hits)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, step, lambda acc: acc["sum"]))


def certified_cutoffs(scored: DataFrame, labels: DataFrame, risk: Risk = Risk(), good: Column | None = None) -> DataFrame:
    """One row per stratum: the strictest certified cut-off of each rule, or null.

    ``scored`` has doc_id, stratum, base_failed and the rules' scores. Labelled rows that
    the base rules reject anyway do not count. Rows of a null stratum form one. Sizes of
    every aggregate here: strata x rules x cut-offs.
    """
    good = F.col("quality") == 1 if good is None else good
    truth = labels.where(good & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = scored.where(~F.col("base_failed")).join(truth, "doc_id", "left_semi")
    def met(rule: str) -> Column:
        return sum((F.when(F.col(rule) >= x, 1).otherwise(0) for x in SHARES), F.lit(0))

    hit = [F.struct(F.lit(r).alias("rule"), met(r).alias("met")) for r in RULES]
    tallies = (
        known.select("stratum", F.explode(F.array(*hit)).alias("h")).groupBy("stratum", "h.rule", "h.met")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A row that meets j of the falling cut-offs is rejected by the last j of them.
    rates = tallies.groupBy("stratum", "rule").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("met", "n")).alias("by_met"),
    ).withColumn("n_tests", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    tests = rates.select(
        "stratum", "rule", "total", "n_tests",
        F.posexplode(F.transform(
            F.sequence(F.lit(1), F.lit(len(SHARES))),
            lambda j: F.aggregate(
                F.filter("by_met", lambda x: x["met"] > F.lit(len(SHARES)) - j), F.lit(0).cast("long"), lambda a, x: a + x["n"],
            ),
        )).alias("at", "hits"),
    )
    # One row per stratum and rule: as many tests share the error.
    level = F.lit(risk.error) / F.col("n_tests")
    judged = tests.select(
        "stratum", "rule", "at",
        (binomial_tail(F.col("hits"), F.col("total"), risk.max_rate / len(RULES)) > level).alias("fails"),
    )
    first = judged.groupBy("stratum", "rule").agg(
        F.coalesce(F.min(F.when(F.col("fails"), F.col("at"))), F.lit(len(SHARES))).alias("passed"),
    )
    cut = F.when(F.col("passed") > 0, F.get(F.array(*[F.lit(x) for x in SHARES]), F.col("passed") - 1))
    return first.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, cut)).alias(f"{r}_cut") for r in RULES
    ])


def judge(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``kept``; the cut-offs are joined null-safely, one row per stratum."""
    cuts = cutoffs.withColumnRenamed("stratum", "cut_stratum")
    joined = scored.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left").drop("cut_stratum")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) >= F.col(f"{r}_cut"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(
    docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
) -> DataFrame:
    """Counts, scores and verdict of every row.

    A null or empty text has zero counts and fails the base rules. A null or repeated id
    is judged like any other row; null ids are never labelled. A stratum without enough
    good labels gets no cut-offs, so only the base rules act there. Texts are read once:
    their counts are written to the shared folder and read by both later steps.
    """
    counted = measures(docs, id_col, text_col, F.col(stratum_col).cast("string"))
    scored = with_scores(stage(counted, "quality-counts")).withColumnRenamed("carried", "stratum")
    return judge(scored, certified_cutoffs(scored, labels, risk))


def passing(
    docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows are matched by their place in the table, so repeated rows are judged one by one;
    ``docs`` has to be re-readable in the same order (a scan or a checkpoint).
    """
    at = F.monotonically_increasing_id()
    carry = F.struct(F.col(stratum_col).cast("string").alias("stratum"), at.alias("at"))
    counted = stage(measures(docs, id_col, text_col, carry), "quality-counts")
    scored = with_scores(counted.select("carried.*", *[c for c in counted.columns if c != "carried"]))
    kept = judge(scored, certified_cutoffs(scored, labels, risk)).where("kept").select(F.col("at").alias("_kept_at"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), at.alias("at"))
    return marked.join(kept, F.col("at") == F.col("_kept_at"), "left_semi").select("row.*")
