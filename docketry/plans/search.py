"""Retrieval: dense, lexical and hybrid search with metadata and date filters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.dates import optional_calendar_date
from docketry.functions.ids import owner_of_hit, stored_article
from docketry.functions.text import blank_to_null, strip
from docketry.functions.vectors import dot, unit
from docketry.operators import posting_store
from docketry.operators.filters import looks_like_citation, metadata_filter
from docketry.operators.fusion import law_first, rrf
from docketry.operators.lexical import build_index, bm25_top
from docketry.operators.ranking import keep_best, nearest, page
from docketry.session import stage
from docketry.settings import DEFAULT_LICENSE, DEFAULTS, Settings

# Everyday words and the statutory term searched along with them.
SYNONYMS = {
    "월급": "임금", "봉급": "임금", "급여": "임금", "월급여": "임금",
    "성인": "성년",
    "집주인": "임대인", "세입자": "임차인", "세 든": "임차", "세든": "임차",
    "전세": "임대차", "월세": "임대차",
    "잘렸": "해고", "잘림": "해고", "잘리": "해고", "짤렸": "해고",
    "짤림": "해고", "해고당": "해고",
    "빌린 돈": "채무", "빌린돈": "채무", "빚": "채무",
    "보이스피싱": "전기통신금융사기",
    "갑질": "직장 내 괴롭힘",
    "음주 운전": "음주운전",
}


@dataclass(frozen=True)
class Corpus:
    """Searchable rows: a key, a unit ``vector``, and the payload as plain columns.

    ``index`` is a stored word index of these rows; ``filtered`` says that ``rows`` are
    only a part of what it holds. Without one a hybrid search builds its own.
    """

    rows: DataFrame
    key: str = "chunk_id"
    title: str | None = "heading"
    body: str = "text"
    index: posting_store.PostingStore | None = None
    filtered: bool = False


def indexed(corpus: Corpus, path: str) -> Corpus:
    """The corpus with the word index under ``path``, which is written if there is none."""
    spark = corpus.rows.sparkSession
    if posting_store.exists(spark, path):
        return replace(corpus, index=posting_store.open_store(spark, path))
    return replace(corpus, index=posting_store.create(corpus.rows, path, corpus.key, corpus.title, corpus.body))


def word_ranks(corpus: Corpus, queries: DataFrame, n: int) -> DataFrame:
    """Best ``n`` rows per query by words: ``query_id, rank, <key>, score``."""
    if corpus.index is None:
        return bm25_top(build_index(corpus.rows, corpus.key, corpus.title, corpus.body), queries, "query_id", "text", n)
    among = corpus.rows.select(corpus.key) if corpus.filtered else None
    return posting_store.top(corpus.index, queries, "query_id", "text", n, among=among)


def expand(query: Column, terms: Mapping[str, str] = SYNONYMS) -> Column:
    """Query followed by the terms its everyday words stand for, unless already there."""
    added = [
        F.when(F.contains(query, F.lit(word)) & ~F.contains(query, F.lit(term)), F.lit(term))
        for word, term in terms.items()
    ]
    extra = F.array_distinct(F.array_compact(F.array(*added)))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", query, F.array_join(extra, " "))).otherwise(query)


def prepare_queries(queries: DataFrame, text: str = "text", vector: str = "vector") -> DataFrame:
    """Trim the text, scale the vector, and fail on a blank query."""
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    checked = F.when(blank, F.raise_error(F.lit("query must not be blank")).cast("array<double>"))
    return queries.withColumn(vector, checked.otherwise(unit(F.col(vector))))


def is_small(queries: DataFrame, per_query: int, row_bytes: int = 512, limit: int = DEFAULTS.broadcast_bytes) -> bool:
    """Whether ``per_query`` result rows for every query stay within the broadcast bound."""
    return queries.count() * per_query * row_bytes <= limit


def lookup(small: DataFrame, big: DataFrame, key: str | list[str], broadcast: bool = True, how: str = "inner") -> DataFrame:
    """Fetch the rows of ``big`` for a short list of keys without shuffling ``big``."""
    keys = [key] if isinstance(key, str) else key
    wanted = small.select(*keys).distinct()
    found = big.join(F.broadcast(wanted) if broadcast else wanted, keys, "left_semi")
    return small.join(found, keys, how)


def search(
    corpus: Corpus,
    queries: DataFrame,
    k: int = DEFAULTS.top_k,
    where: Mapping[str, Any] | None = None,
    as_of: str | None = None,
    mode: str = "exact",
    hybrid: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Best ``k`` rows per query: ``query_id, rank, <key>, score`` and the payload.

    ``queries`` has ``query_id, text, vector``; words are searched together with the terms
    that everyday words stand for. ``mode="exact"`` filters before
    ranking. ``mode="overfetch"`` ranks first and filters the candidates; queries that
    find fewer than ``k`` rows that way are answered by an exact pass, so both modes
    give the same rows. A hybrid search always filters first. The score is always the dense one; in a hybrid
    search the order follows the fused rank instead.
    """
    if mode not in ("exact", "overfetch"):
        raise ValueError(f"unknown mode {mode!r}")
    k = max(1, int(k))
    keep = metadata_filter(where, as_of)
    queries = prepare_queries(queries)
    if settings.expand_queries:
        queries = queries.withColumn("text", expand(F.col("text")))
    rows, key = corpus.rows, corpus.key
    late = keep if keep is not None and mode == "overfetch" and not hybrid else None
    searched = rows.where(keep) if keep is not None and late is None else rows
    payload = rows.drop("vector")

    if hybrid:
        n = max(settings.hybrid_candidates, k)
        small = is_small(queries, 2 * n)
        candidates = hybrid_ranks(replace(corpus, rows=searched, filtered=corpus.filtered or keep is not None), queries, n, settings, small)
    else:
        n = k * settings.overfetch if late is not None else k
        small = is_small(queries, n)
        candidates = nearest(searched, queries.select("query_id", "vector"), n, key)
    # A few rows per query, read twice below: staged so that the corpus is ranked once.
    hits = lookup(stage(candidates, "candidates"), payload, key, small)
    if hybrid or late is not None:
        kept = hits if late is None else hits.where(late)
        hits = keep_best(kept.withColumnRenamed("rank", "_rank"), ["query_id"], [F.asc("_rank")], k).drop("_rank")
    if late is not None:
        hits = stage(hits, "overfetched")
        full = hits.where(F.col("rank") == k).select("query_id")
        short = stage(queries.join(full, "query_id", "left_anti").select("query_id", "vector"), "short-queries")
        rest = lookup(stage(nearest(rows.where(late), short, k, key), "exact"), payload, key, small)
        hits = hits.join(full, "query_id", "left_semi").unionByName(rest.select(*hits.columns))
    return hits


def hybrid_ranks(corpus: Corpus, queries: DataFrame, n: int, settings: Settings = DEFAULTS, small: bool = True,
                 lexical_when: Column | None = None) -> DataFrame:
    """Fused ranking of up to ``2n`` rows per query: ``query_id, rank, rrf, <key>, score``.

    The lexical half only runs for queries that look like a citation, and lists
    statutes first.
    """
    key, rows = corpus.key, corpus.rows
    dense = stage(nearest(rows, queries.select("query_id", "vector"), n, key), "dense")
    wanted = looks_like_citation(F.col("text")) if lexical_when is None else lexical_when
    lexical = stage(word_ranks(corpus, queries.where(wanted), n), "lexical")
    typed = lookup(lexical.drop("score"), rows.select(key, "doc_type"), key, small)
    fused = rrf(dense, law_first(typed, "query_id"), "query_id", key, settings.rrf_k0, settings.rrf_lexical_weight)
    # Rows found only by words get their true dense score.
    scored = fused.join(dense.select("query_id", key, "score"), ["query_id", key], "left")
    only_lexical = lookup(scored.where(F.col("score").isNull()).select("query_id", key), rows.select(key, "vector"), key, small)
    query_vectors = queries.select("query_id", F.col("vector").alias("_q"))
    rescored = only_lexical.join(query_vectors, "query_id").select(
        "query_id", key, F.round(dot(F.col("_q"), F.col("vector")), 6).alias("_dot")
    )
    return scored.join(rescored, ["query_id", key], "left").select(
        "query_id", "rank", "rrf", key, F.coalesce("score", "_dot", F.lit(0.0)).alias("score")
    )


def statutes_page(hits: DataFrame, k: int = DEFAULTS.top_k, offset: int = 0, as_of: str | None = None,
                  key: str = "chunk_id") -> DataFrame:
    """One result page: rows re-sorted by score, with the common provenance columns.

    Sorting by score means a hybrid search decides which rows appear, not their order.
    """
    as_of = optional_calendar_date(as_of)
    text = lambda name: blank_to_null(F.col(name))
    rows = hits.select(
        "query_id",
        owner_of_hit(F.col("doc_id"), F.col("parent_id"), F.col(key), F.col(key)).alias("doc_id"),
        text("doc_type").alias("doc_type"), text("title").alias("title"), text("article_no").alias("article_no"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.nullif("trust_grade", F.lit("")), F.lit("A")).alias("trust_grade"),
        text("source_url").alias("source_url"),
        F.coalesce(text("license"), F.lit(DEFAULT_LICENSE)).alias("license"),
        F.lit(as_of).cast("string").alias("as_of_date"),
        text("effective_from").alias("effective_from"),
        F.col(key).alias("_key"),
    )
    return page(rows.withColumn("_tie", F.concat_ws("\u0000", "doc_id", "_key")), k, offset, "score", "_tie",
                by=["query_id"]).drop("_tie", "_key")


def articles_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Statute articles by law id and label (``4``, ``4조`` or ``제4조``): ``asked`` has request, law_id, article_no.

    Both sides meet by law; a request that fits nothing gives no row.
    """
    wanted = asked.select("request", "law_id", stored_article(F.col("article_no")).alias("_label"))
    laws = docs.where(F.startswith(F.col("doc_id"), F.lit("LAW:"))).withColumn("law_id", F.split_part("doc_id", F.lit(":"), F.lit(2)))
    art = F.col("article")
    return (
        laws.join(wanted, "law_id")
        .withColumn("article", F.explode(F.filter("articles", lambda a: a["article_no"] == F.col("_label"))))
        .select(
            "request", "doc_id", "title", "law_kind", art["article_no"].alias("article_no"), art["title"].alias("article_title"),
            art["text"].alias("text"), "source_url", "effective_from",
            F.coalesce("trust_grade", F.lit("A")).alias("trust_grade"), F.lit(DEFAULT_LICENSE).alias("license"),
        )
    )


def cases_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Precedents by serial number: ``asked`` has request and serial."""
    wanted = asked.select("request", F.concat(F.lit("PREC:"), "serial").alias("doc_id"))
    return docs.join(wanted, "doc_id").select(
        "request", "doc_id", F.coalesce(F.nullif("case_no", F.lit("")), "title").alias("case_no"), F.col("title").alias("case_name"),
        F.col("jurisdiction").alias("court"), F.col("effective_from").alias("decided"), F.col("law_kind").alias("case_kind"),
        F.transform("articles", lambda a: F.struct(a["article_no"].alias("article_no"), a["text"].alias("text"))).alias("sections"),
        "source_url", F.coalesce("trust_grade", F.lit("A")).alias("trust_grade"), F.lit(DEFAULT_LICENSE).alias("license"),
    )


def article_lookup(docs: DataFrame, law_id: str, article_no: str) -> DataFrame:
    """One statute article; see :func:`articles_of`."""
    asked = docs.sparkSession.createDataFrame([(0, law_id, article_no)], "request int, law_id string, article_no string")
    return articles_of(docs, asked).drop("request")


def case_lookup(docs: DataFrame, serial: str) -> DataFrame:
    """One precedent by its serial number."""
    return cases_of(docs, docs.sparkSession.createDataFrame([(0, serial)], "request int, serial string")).drop("request")
