"""Citation verification against the corpus and a registry of laws and cases.

The registry tables stand for a remote service: what it listed, loaded as data.

Citations are joined to one row per title or case. A title that holds a large share
of the citations makes the citation side uneven; adaptive execution splits that
side at run time, which costs no extra pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.dates import in_force_if_known, registry_date
from docketry.functions.ids import article_key, case_key, mentions_article, registry_article
from docketry.functions.text import blank_to_null, nfc, squeeze, strip
from docketry.operators.dedup import keep_first
from docketry.operators.joins import substring_matches

IN_FORCE = "현행"


def title_key(col: Column) -> Column:
    return squeeze(nfc(F.coalesce(col, F.lit(""))))


def public_url(url: Column) -> Column:
    """Link without its access token, made absolute."""
    cleaned = F.regexp_replace(F.regexp_replace(url, "([?&])OC=[^&]*&?", "$1"), "[?&]+$", "")
    absolute = F.when(F.startswith(cleaned, F.lit("/")), F.concat(F.lit("https://www.law.go.kr"), cleaned)).otherwise(cleaned)
    return F.when(F.coalesce(url, F.lit("")) != "", absolute)


def classify(citations: DataFrame) -> DataFrame:
    """Add ``kind`` (precedent, statute or malformed), ``title``, ``key`` and ``case_key``.

    ``citations`` has ``citation_id, case_no, law_name, article_no``.
    """
    case = blank_to_null(F.col("case_no"))
    name = F.nullif(F.col("law_name"), F.lit(""))
    kind = F.when(case.isNotNull(), "precedent").when(name.isNotNull(), "statute").otherwise("malformed")
    return citations.withColumn("kind", kind).select(
        "citation_id", "kind",
        F.when(kind == "statute", title_key(name)).alias("title"),
        F.when(kind == "statute", article_key(blank_to_null(F.col("article_no")))).alias("key"),
        F.when(kind == "precedent", case_key(case)).alias("case_key"),
        F.when(kind == "precedent", case).alias("case_no"),
    )


def in_corpus(classified: DataFrame, parents: DataFrame, order: str = "position") -> DataFrame:
    """Corpus evidence: ``citation_id, db_match, db_grade, db_url, db_effective``.

    A statute is the first parent of that exact title; a cited article must occur
    in its text. A precedent needs a parent that carries the case number.
    """
    def first_by(key: Column) -> DataFrame:
        """Narrow index: the first parent per key. Texts are not read here."""
        keyed = parents.select(key.alias("k"), order, "parent_id").where(F.col("k") != "")
        return keep_first(keyed, "k", [order]).drop(order)

    statutes = classified.where(F.col("kind") == "statute").select("citation_id", F.col("title").alias("k"), "key")
    cited = statutes.join(first_by(title_key(F.col("title"))), "k")
    if "case_no" in parents.columns:
        cases = classified.where(F.col("kind") == "precedent").select(
            "citation_id", F.col("case_key").alias("k"), F.lit(None).cast("string").alias("key")
        )
        cited = cited.unionByName(cases.join(first_by(case_key(F.col("case_no"))), "k"))

    # One test per parent and article, however often the pair is cited.
    pairs = cited.select("parent_id", "key").distinct()
    text = F.coalesce("full_text", F.lit(""))
    grade = F.when(F.coalesce("trust_grade", F.lit("A")) == "B", "B").when(text != "", "A").otherwise("B")
    tested = parents.join(pairs, "parent_id").where(F.col("key").isNull() | mentions_article(text, F.col("key"))).select(
        "parent_id", F.coalesce("key", F.lit("")).alias("_key"), grade.alias("db_grade"),
        F.col("source_url").alias("db_url"), F.col("effective_from").alias("db_effective"),
    )
    found = cited.withColumn("_key", F.coalesce("key", F.lit(""))).join(tested, ["parent_id", "_key"])
    return found.select("citation_id", F.lit(True).alias("db_match"), "db_grade", "db_url", "db_effective")


def in_registry(classified: DataFrame, laws: DataFrame, articles: DataFrame, cases: DataFrame) -> DataFrame:
    """Registry evidence: ``citation_id, api_match, api_current, api_url, api_effective``.

    A law is looked up by exact title, failing that by a title that contains it;
    rows in force come before others.

    ``laws``: law_name, status, serial, effective, link, position.
    ``articles``: serial, article_no, effective. ``cases``: case_no, decided, link, position.
    """
    statutes = classified.where(F.col("kind") == "statute").select("citation_id", "title", "key")
    listed = laws.withColumn("listed", title_key(F.col("law_name"))).drop("law_name")
    current_first = [F.when(F.col("status") == IN_FORCE, 0).otherwise(1), F.col("position")]
    wanted = statutes.select("title").distinct()
    exact = wanted.join(listed.withColumnRenamed("listed", "title"), "title")
    near = substring_matches(wanted.join(listed.select(F.col("listed").alias("title")), "title", "left_anti"), listed, "title", "listed", ["position"])
    best = keep_first(exact.unionByName(near.drop("listed")), "title", current_first)
    rows = statutes.join(best, "title", "left")
    units = articles.select(
        "serial", F.coalesce(article_key(F.col("article_no")), strip(F.col("article_no"))).alias("key"),
        F.col("effective").alias("unit_effective"), F.lit(True).alias("has_unit"),
    )
    units = keep_first(units, ["serial", "key"], ["unit_effective"])
    checked = rows.join(units, ["serial", "key"], "left")
    no_article_query = F.col("key").isNull() | (F.coalesce("serial", F.lit("")) == "") | registry_article(F.col("key")).isNull()
    match = F.when(F.col("status").isNull(), False).when(no_article_query, True).otherwise(F.coalesce("has_unit", F.lit(False)))
    law_part = checked.select(
        "citation_id", match.alias("api_match"), (F.coalesce(F.col("status"), F.lit("")) == IN_FORCE).alias("api_current"),
        public_url(F.col("link")).alias("api_url"),
        F.coalesce(F.when(F.col("has_unit"), registry_date(F.col("unit_effective"))), registry_date(F.col("effective"))).alias("api_effective"),
    )
    numbered = keep_first(cases.withColumn("case_key", case_key(F.col("case_no"))).drop("case_no"), "case_key", ["position"])
    case_rows = classified.where(F.col("kind") == "precedent").select("citation_id", "case_key").join(numbered, "case_key", "left")
    case_part = case_rows.select(
        "citation_id", F.col("position").isNotNull().alias("api_match"), F.lit(True).alias("api_current"),
        public_url(F.col("link")).alias("api_url"), registry_date(F.col("decided")).alias("api_effective"),
    )
    return law_part.unionByName(case_part)


def verdict(classified: DataFrame, corpus: DataFrame, registry: DataFrame | None, as_of: str | None = None) -> DataFrame:
    """One audit record per citation; malformed ones are reported, not dropped.

    ``registry=None`` is the case where the service gave no answer at all.
    """
    rows = classified.join(corpus, "citation_id", "left")
    if registry is None:
        rows = rows.withColumn("api_match", F.lit(None).cast("boolean")).withColumn("api_current", F.lit(False)) \
            .withColumn("api_url", F.lit(None).cast("string")).withColumn("api_effective", F.lit(None).cast("string"))
    else:
        rows = rows.join(registry, "citation_id", "left")
    sound = F.col("kind") != "malformed"
    db = F.coalesce("db_match", F.lit(False)) & sound
    api = F.when(sound, F.col("api_match"))
    confirmed = F.coalesce(api, F.lit(False))
    current = sound & F.when(confirmed, F.coalesce("api_current", F.lit(False))).otherwise(db)
    effective = F.coalesce(F.nullif("api_effective", F.lit("")), F.col("db_effective"))
    on_time = in_force_if_known(effective, F.lit(as_of).cast("string")) if as_of else F.lit(True)
    verified = F.when(F.coalesce(~api, F.lit(False)), False).otherwise(db & on_time)
    grade = F.when(db & (F.col("db_grade") == "A"), "A").otherwise("B")
    points = 50 + F.when(confirmed, 30).otherwise(0) + F.when(current, 15).otherwise(0) + F.when(grade == "A", 5).otherwise(0)
    score = F.when(~verified, F.when(db, 15).otherwise(0)).otherwise(F.least(points, F.lit(100)))
    flag = (
        F.when(~verified, "red")
        .when((confirmed & current & (grade == "A")) | (score >= 80), "green")
        .otherwise("yellow")
    )
    location = F.when(F.col("kind") == "precedent", F.col("case_no")).otherwise(F.concat(F.lit("제"), F.col("key"), F.lit("조")))
    return rows.select(
        "citation_id", "kind", verified.alias("verified"),
        F.when(sound, score).cast("int").alias("trust_score"), F.when(sound, flag).alias("flag"), grade.alias("trust_grade"),
        current.alias("current"), F.coalesce(F.nullif("api_url", F.lit("")), F.col("db_url")).alias("source_url"),
        effective.alias("effective_from"), F.lit(as_of).cast("string").alias("as_of_date"), location.alias("location"),
        db.alias("db_match"), api.alias("api_match"),
    )
