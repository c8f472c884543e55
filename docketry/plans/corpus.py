"""Corpus build: files to documents, chunks, parents, vectors and the search table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import nfc
from docketry.operators import chunking, embedding, filters
from docketry.operators.names import names_cited
from docketry.plans.search import Corpus
from docketry.session import stage
from docketry.settings import DEFAULTS, Settings
from docketry.sources import markdown as M
from docketry.sources import parsers as P

# Fixed value: the order in which sources claim a document id.
SOURCE_ORDER = ("law", "ordinance", "admrule", "precedent")


def parse_corpora(files: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Documents and rejects of the given corpora (``{doc_type: files}``)."""
    parse = {"law": P.parse_statutes, "ordinance": P.parse_ordinances, "admrule": P.parse_rules, "precedent": P.parse_cases}
    parsed = {name: parse[name](df) for name, df in files.items()}
    rejects = reduce(DataFrame.unionByName, [M.rejected(df) for df in parsed.values()])
    docs = []
    for name, df in parsed.items():
        good = P.canonical_rules(df) if name == "admrule" else M.accepted(df)
        docs.append(good.withColumn("source_order", F.lit(SOURCE_ORDER.index(name))).withColumn("position", F.col("path")))
    return reduce(DataFrame.unionByName, docs), rejects


def read_corpora(spark: SparkSession, roots: Mapping[str, str]) -> dict[str, DataFrame]:
    """File tables of the four folder layouts."""
    names = {"law": ("*.md", True), "ordinance": ("본문.md", True), "admrule": ("본문.md", True), "precedent": ("*.md", True)}
    return {kind: M.read_files(spark, root, *names[kind]) for kind, root in roots.items()}


def build_chunks(docs: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Chunks and parents of the first document per id.

    The kept documents are written once to the shared folder, because both outputs
    read them.
    """
    kept = stage(chunking.first_documents(docs).withColumn("meta", F.to_json("meta")), "documents")
    return chunking.chunk(kept, settings), chunking.parents(kept, settings.license)


def embed_chunks(chunks: DataFrame, cache: DataFrame, embedder: Callable[[list[str]], np.ndarray],
                 settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Vectors of every chunk (cached and new) and the new cache lines.

    New vectors are staged: they are both returned and joined, and must not be
    computed twice.
    """
    known = embedding.valid_cache(cache, settings.embed_dim)
    todo = embedding.missing(chunks.withColumn("position", F.col("chunk_id")), known)
    fresh = stage(embedding.embed(todo, embedder, settings.embed_dim), "vectors")
    return embedding.fan_out(chunks, known.unionByName(fresh)), fresh


def search_table(chunks: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS, medical: bool = False) -> Corpus:
    """Flat search rows. The full index drops grade B; the sub-corpus keeps grade A only."""
    rows = embedding.index_rows(chunks, vectors, settings.embed_dim)
    if medical:
        rows = rows.where(F.col("payload.trust_grade") == "A")
    flat = rows.select("chunk_id", "vector", "text", "content_hash", "payload.*")
    heading = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("article_no", F.lit("")), F.coalesce("article_title", F.lit("")))
    return Corpus(flat.withColumn("heading", heading))


# --- sub-corpus ---------------------------------------------------------------

def folder_of(path: str = "path"):
    return nfc(F.regexp_extract(path, "([^/]+)/[^/]+$", 1))


def require_folders(files: DataFrame, wanted: Iterable[str]) -> None:
    """Fail when a listed folder has no file at all."""
    names = sorted({w.strip() for w in wanted if w.strip()})
    if not names:
        raise ValueError("the folder list is empty")
    there = {r[0] for r in files.select(folder_of().alias("f")).where(F.col("f").isin(names)).distinct().collect()}
    gone = [n for n in names if n not in there]
    if gone:
        raise FileNotFoundError(f"{len(gone)} listed folder(s) absent: {', '.join(gone)}")


def pick_statutes(files: DataFrame, folders: Iterable[str], kinds: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents of the listed statute folders and their audit rows."""
    folders, kinds = list(folders), list(kinds)
    require_folders(files, folders)
    chosen = files.where(folder_of().isin(folders))
    if kinds:
        chosen = chosen.where(nfc(F.regexp_extract("path", r"([^/]+)\.md$", 1)).isin(kinds))
    parsed = P.parse_statutes(chosen)
    audit = parsed.select(
        F.lit("law").alias("corpus"), folder_of().alias("scope"), F.regexp_extract("path", "([^/]+)$", 1).alias("item"),
        F.when(F.col("reject_reason").isNull(), F.coalesce("law_kind", F.lit(""))).otherwise("skip").alias("rule_or_kind"),
        F.coalesce("reject_reason", "trust_grade").alias("matched_term"),
    )
    return M.accepted(parsed), audit


def pick_rules(files: DataFrame, include: Iterable[str], deny: Iterable[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical rules whose folder name holds a wanted keyword and no denied one, with audits."""
    decided = files.withColumn("choice", filters.keyword_decision(folder_of(), include, deny)).where(F.col("choice.matched").isNotNull())
    denied = decided.where(~F.col("choice.keep")).select(
        F.lit("admrule").alias("corpus"), folder_of().alias("scope"), folder_of().alias("item"),
        F.lit("deny").alias("rule_or_kind"), F.col("choice.denied").alias("matched_term"),
    )
    kept = decided.where("choice.keep")
    parsed = P.parse_rules(kept.select("path", "content"))
    best = P.canonical_rules(parsed)
    dropped = M.accepted(parsed).select("doc_id", "path", "serial").join(best.select("path"), "path", "left_anti").select(
        "doc_id", F.lit("dropped").alias("action"), F.col("serial").alias("prev"), "path"
    )
    audit = denied.unionByName(best.select(
        F.lit("admrule").alias("corpus"), folder_of().alias("scope"), folder_of().alias("item"),
        filters.first_keyword(folder_of(), list(include)).alias("rule_or_kind"), F.col("trust_grade").alias("matched_term"),
    ))
    return best, audit, dropped


def pick_cases(docs: DataFrame, section: str, names: Iterable[str] | DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Precedents whose named section cites a listed law; adds ``match_rule`` and ``matched_term``.

    ``names`` is a short list, or a table (name, canonical) of any length.
    """
    reference = F.get(F.filter("articles", lambda a: a["article_no"] == section), F.lit(0))["text"]
    cited = docs.withColumn("_ref", reference).where(F.coalesce("_ref", F.lit("")) != "")
    if isinstance(names, DataFrame):
        matched = names_cited(cited, "_ref", names, "matched_term")
    else:
        matched = cited.withColumn("matched_term", filters.laws_cited(F.col("_ref"), names, aliases))
    return (
        matched.where(F.size("matched_term") > 0)
        .withColumn("match_rule", F.lit(f"phase1:{section}:exact"))
        .drop("_ref")
    )
