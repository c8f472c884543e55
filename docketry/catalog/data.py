"""Inputs of the named queries: the legal-document view of the given tables.

Every column is plain arithmetic or text work on the source row, written once with
the DataFrame API and once as SQL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import strip
from docketry.functions.vectors import unit
from docketry.plans.search import Corpus, indexed
from docketry.session import shared_folder, stage
from docketry.sources.markdown import ARTICLE_TYPE, ATTACHMENT_TYPE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key before heavy per-row work, at every size alike.

    The files here have one row group, so one task would read and process them.
    """
    return df.repartition(key)


def wide_lines(text: str = "text") -> Column:
    return F.split(text, "\n")


def documents(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """One legal document per row of ``documents``; its lines are the articles.

    With ``wanted`` (``doc_id``, few enough to broadcast) only those, chosen before any row is moved.
    """
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    source = table(spark, folder, "documents")
    if wanted is not None:
        source = source.join(F.broadcast(wanted), "doc_id", "left_semi")
    rows = spread(source, "doc_id").join(labels, "doc_id", "left").withColumnRenamed("doc_id", "k")
    k, kind = F.col("k"), F.pmod(F.col("k"), F.lit(4))
    key = k.cast("string")
    by_kind = lambda a, b, c, d: F.when(kind == 0, a).when(kind == 1, b).when(kind == 2, c).otherwise(d)
    dated = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(k * 37, F.lit(11000)).cast("int")), "yyyy-MM-dd")
    none = F.lit(None).cast("string")

    def article(line: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.struct(
            F.when(kind == 3, F.concat(F.lit("절"), n)).otherwise(F.concat(F.lit("제"), n, F.lit("조"))).alias("article_no"),
            F.when((i % 2 == 0) & (kind != 3), F.concat(F.lit("항목"), n)).alias("title"),
            line.alias("text"),
            F.when(kind != 3, F.concat(F.lit("제"), (F.floor(i / 5) + 1).cast("string"), F.lit("장"))).alias("chapter_path"),
            none.alias("kind"), F.lit(None).cast("array<string>").alias("amendments"),
        )

    articles = F.filter(F.transform(wide_lines(), article), lambda a: strip(a["text"]) != "")
    return rows.select(
        by_kind(F.concat_ws(":", F.lit("LAW"), key, "lang"), F.concat_ws(":", F.lit("ORD"), "source", key),
                F.concat_ws(":", F.lit("ADMRULE"), key), F.concat_ws(":", F.lit("PREC"), key)).alias("doc_id"),
        by_kind(F.lit("law"), F.lit("ordinance"), F.lit("admrule"), F.lit("precedent")).alias("doc_type"),
        F.concat("source", F.lit(" "), "lang", F.lit("법")).alias("title"),
        F.col("source").alias("jurisdiction"), F.col("lang").alias("law_kind"),
        F.when(F.pmod(k, F.lit(10)) != 0, dated).alias("effective_from"),
        F.concat(F.lit("https://example.org/doc/"), key).alias("source_url"),
        F.when((F.col("n_chars") < 5) | F.coalesce(F.col("quality") == 0, F.lit(False)), "B").otherwise("A").alias("trust_grade"),
        articles.cast(f"array<{ARTICLE_TYPE}>").alias("articles"),
        F.array().cast(ATTACHMENT_TYPE).alias("attachments"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.concat("source", F.lit("청"))).alias("authority"),
        F.when(kind == 3, F.concat(F.lit("2020다"), key)).alias("case_no"),
        F.when(kind == 1, F.when(F.pmod(k, F.lit(3)) == 0, "광역").otherwise("기초")).alias("gov_level"),
        F.when((kind == 1) & (F.pmod(k, F.lit(3)) != 0), F.concat("source", F.lit("시"))).alias("locality"),
        none.alias("serial"), none.alias("meta"),
        F.lit(0).alias("source_order"), k.alias("position"), "text", "n_chars",
    )


CORPUS_SQL = """
corpus AS (
  SELECT d.doc_id AS k, d.text, d.n_chars, d.lang, d.source,
    CASE d.doc_id % 4 WHEN 0 THEN 'LAW:' || d.doc_id || ':' || d.lang WHEN 1 THEN 'ORD:' || d.source || ':' || d.doc_id
      WHEN 2 THEN 'ADMRULE:' || d.doc_id ELSE 'PREC:' || d.doc_id END AS doc_id,
    CASE d.doc_id % 4 WHEN 0 THEN 'law' WHEN 1 THEN 'ordinance' WHEN 2 THEN 'admrule' ELSE 'precedent' END AS doc_type,
    d.source || ' ' || d.lang || '법' AS title, d.source AS jurisdiction, d.lang AS law_kind,
    CASE WHEN d.doc_id % 10 <> 0 THEN strftime(DATE '2000-01-01' + CAST(d.doc_id * 37 % 11000 AS INTEGER), '%Y-%m-%d') END
      AS effective_from,
    'https://example.org/doc/' || d.doc_id AS source_url,
    CASE WHEN d.n_chars < 5 OR coalesce(l.quality = 0, false) THEN 'B' ELSE 'A' END AS trust_grade,
    CASE WHEN d.doc_id % 3 = 0 THEN d.source || '청' END AS authority,
    CASE WHEN d.doc_id % 4 = 3 THEN '2020다' || d.doc_id END AS case_no,
    CASE WHEN d.doc_id % 4 = 1 THEN CASE WHEN d.doc_id % 3 = 0 THEN '광역' ELSE '기초' END END AS gov_level,
    CASE WHEN d.doc_id % 4 = 1 AND d.doc_id % 3 <> 0 THEN d.source || '시' END AS locality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

ARTICLES_SQL = """
raw_lines AS (
  SELECT k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM corpus
), articles AS (
  SELECT k, i, line,
    CASE WHEN k % 4 = 3 THEN '절' || (i + 1) ELSE '제' || (i + 1) || '조' END AS article_no,
    CASE WHEN i % 2 = 0 AND k % 4 <> 3 THEN '항목' || (i + 1) END AS article_title,
    CASE WHEN k % 4 <> 3 THEN '제' || (i // 5 + 1) || '장' END AS chapter
  FROM raw_lines WHERE trim(line) <> ''
)"""

LICENSE_SQL = "'공공저작물(저작권법 §7) · 출처표기: law.go.kr'"

# Embedding text of every article, as the chunker builds it (no text here has
# amendment notes, circled numerals or double spaces to clean).
CHUNKS_SQL = f"""{CORPUS_SQL}, {ARTICLES_SQL}, placed AS (
  SELECT c.*, a.i, a.line, a.article_no, a.article_title, a.chapter,
    CASE WHEN doc_type = 'precedent' THEN jurisdiction ELSE coalesce(authority, jurisdiction) END AS body_name,
    CASE doc_type WHEN 'law' THEN '법령' WHEN 'ordinance' THEN '자치법규' WHEN 'admrule' THEN '행정규칙' ELSE '판례' END AS label
  FROM corpus c JOIN (
    SELECT * FROM articles
    UNION ALL
    SELECT k, 0, '', '메타', law_kind, NULL FROM corpus WHERE k NOT IN (SELECT k FROM articles)
  ) a ON c.k = a.k
), chunk_text AS (
  SELECT *, doc_id || '#' || article_no || '#0' AS chunk_id,
    CASE WHEN doc_type = 'precedent'
      THEN concat_ws(' · ', '[판례] ' || concat_ws(' ', jurisdiction, effective_from, case_no), law_kind, article_no)
      ELSE concat_ws(' · ',
        '[' || label || '] ' || concat_ws(' > ', title, chapter, article_no || coalesce('(' || article_title || ')', '')),
        '시행 ' || effective_from,
        CASE WHEN doc_type = 'ordinance' THEN '지자체 ' || body_name || ' (' || gov_level || ')' ELSE '소관 ' || body_name END)
    END AS line1,
    CASE WHEN doc_type = 'precedent'
      THEN '이 판례 섹션은 ' || body_name || ' ''' || case_no || '''(' || law_kind || ') 판결의 ''' || article_no || '''이다.'
      ELSE '이 조문은 ''' || title || '''(' || law_kind || ', ' ||
        CASE WHEN doc_type = 'ordinance' THEN '지자체 ' ELSE '소관 ' END || body_name || ') ' || label || '의 일부로, ''' ||
        coalesce(article_title, article_no) || '''에 관한 사항을 규정한다.'
    END AS line2
  FROM placed
), chunks AS (
  SELECT *, line1 || chr(10) || line2 || chr(10) || trim(line) AS chunk_body,
    CASE WHEN article_no = '메타' THEN '메타' ELSE '본문' END AS kind
  FROM chunk_text
)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the document fields of the same number; rows without a document keep nulls."""
    docs = documents(spark, folder).select(
        F.col("position").alias("vec_id"), "doc_id", "doc_type", "title", "jurisdiction", "law_kind", "effective_from",
        "source_url", "trust_grade", "text", F.col("doc_id").alias("parent_id"),
        F.lit(None).cast("string").alias("article_no"), F.lit(None).cast("string").alias("license"),
    )
    emb = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return emb.join(docs, "vec_id")


VECTORS_SQL = f"""{CORPUS_SQL}, vectors AS (
  SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS vector, e.label, c.* FROM embeddings e JOIN corpus c ON c.k = e.vec_id
)"""


def corpus(spark: SparkSession, folder: str) -> Corpus:
    return Corpus(vectors(spark, folder), key="vec_id", title="title", body="text")


def index_path(spark: SparkSession, folder: str, name: str) -> str:
    """Where an application keeps a word index of a folder's tables."""
    mark = hashlib.sha256(folder.encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/docketry-indexes/{spark.sparkContext.applicationId}/{name}-{mark}"


def indexed_documents(spark: SparkSession, folder: str) -> Corpus:
    docs = documents(spark, folder).select(F.col("position").alias("doc"), "title", "text")
    return indexed(Corpus(docs, "doc", "title", "text"), index_path(spark, folder, "documents"))


def prepare_indexes(spark: SparkSession, folder: str) -> None:
    """Write the word indexes that the search queries open."""
    indexed_documents(spark, folder)
    indexed_corpus(spark, folder)


def indexed_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The corpus with its word index; the first query of an application writes it, the others open it."""
    return indexed(corpus(spark, folder), index_path(spark, folder, "vectors"))


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean of all its vectors, at unit length."""
    emb = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = emb.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One label has as many rows here as a vector has dimensions.
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return rows.select(
        F.col("label").alias("query_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"),
        unit(F.transform("v", lambda p: p["x"])).alias("vector"),
    )


LABEL_QUERIES_SQL = """
dims AS (
  SELECT label, unnest(range(len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings
), means AS (
  SELECT label, dim, avg(x) AS x FROM dims GROUP BY label, dim
), centers AS (
  SELECT label, list(x ORDER BY dim) AS v FROM means GROUP BY label
), queries AS (
  SELECT label AS query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vector
  FROM centers
)"""


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as queries, with the vector of the same number.

    Every other one also cites an article, so that both kinds of query occur.
    """
    items = table(spark, folder, "benchmark")
    vec = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    cited = F.when(F.pmod("item_id", F.lit(2)) == 0, F.concat("text", F.lit(" 제"), (F.pmod("item_id", F.lit(7)) + 1).cast("string"), F.lit("조")))
    return items.join(vec, "item_id").select(
        F.col("item_id").alias("query_id"), F.coalesce(cited, "text").alias("text"), "vector"
    )


BENCHMARK_QUERIES_SQL = """
queries AS (
  SELECT b.item_id AS query_id,
    CASE WHEN b.item_id % 2 = 0 THEN b.text || ' 제' || (b.item_id % 7 + 1) || '조' ELSE b.text END AS text,
    b.item_id % 2 = 0 AS cites,
    list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(
      list_transform(CAST(e.embedding AS DOUBLE[]), lambda y: y * y)))) AS vector
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id
)"""


def dense_sql(source: str, queries: str = "queries") -> str:
    """Scores of every query against every row of ``source``."""
    return (
        f"SELECT q.query_id, v.vec_id, round(list_dot_product(v.vector, q.vector), 6) AS score, v.* EXCLUDE (vec_id) "
        f"FROM {source} v, {queries} q"
    )


TOKENS_SQL = r"""
words AS (
  SELECT vec_id, w, 5.0 AS weight FROM (
    SELECT vec_id, unnest(regexp_split_to_array(strip_accents(lower(title)), '[^\p{L}\p{N}]+')) AS w FROM searched) WHERE w <> ''
  UNION ALL
  SELECT vec_id, w, 1.0 AS weight FROM (
    SELECT vec_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+')) AS w FROM searched) WHERE w <> ''
), term_freq AS (
  SELECT vec_id, w, sum(weight) AS freq, substr(w, 1, 2) AS lead FROM words GROUP BY vec_id, w
), lengths AS (
  SELECT s.vec_id, count(w.w) AS n_words FROM searched s LEFT JOIN words w ON s.vec_id = w.vec_id GROUP BY s.vec_id
), totals AS (
  SELECT count(*) AS n_rows, avg(n_words) AS avg_words FROM lengths
), terms AS (
  SELECT query_id, prefix, count(*) AS repeats FROM (
    SELECT query_id, regexp_replace(unnest(regexp_split_to_array(lower(text), '\s+')), '[^0-9a-z가-힣]', '', 'g') AS prefix
    FROM word_queries) WHERE length(prefix) >= 2 GROUP BY query_id, prefix
), hits AS (
  SELECT t.vec_id, p.prefix, sum(t.freq) AS freq
  FROM term_freq t JOIN (SELECT DISTINCT prefix, substr(prefix, 1, 2) AS lead FROM terms) p
    ON t.lead = p.lead AND starts_with(t.w, p.prefix)
  GROUP BY t.vec_id, p.prefix
), spread AS (
  SELECT prefix, count(*) AS n_with FROM hits GROUP BY prefix
), bm25 AS (
  SELECT query_id, vec_id, round(sum(
      CASE WHEN ln((n_rows - n_with + 0.5) / (n_with + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n_with + 0.5) / (n_with + 0.5)) END
      * repeats * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * n_words / avg_words))), 6) AS score
  FROM hits JOIN terms USING (prefix) JOIN spread USING (prefix) JOIN lengths USING (vec_id), totals
  GROUP BY query_id, vec_id
)"""
