"""Lookups, index checks, file modes and the answer plan in one piece."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.catalog import query
from docketry.catalog.answers import TODAY
from docketry.catalog.data import ARTICLES_SQL, CORPUS_SQL, LABEL_QUERIES_SQL, VECTORS_SQL, corpus, dense_sql, documents, label_queries, table
from docketry.functions.vectors import unit
from docketry.operators import inventory
from docketry.operators.lexical import build_index
from docketry.plans import answer, review
from docketry.plans.search import articles_of, cases_of
from docketry.session import fresh_path, stage
from docketry.sources import records


#: Documents whose words one task counts, about.
INDEX_ROWS = 4_096


@query("lexical_index", rf"""
WITH {CORPUS_SQL}, searched AS (SELECT k AS doc, title, text FROM corpus), words AS (
  SELECT doc, w, 5.0 AS weight FROM (SELECT doc, unnest(regexp_split_to_array(strip_accents(lower(title)), '[^\p{{L}}\p{{N}}]+')) AS w FROM searched) WHERE w <> ''
  UNION ALL
  SELECT doc, w, 1.0 FROM (SELECT doc, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+')) AS w FROM searched) WHERE w <> '')
SELECT doc, w AS word, CAST(sum(weight) AS DOUBLE) AS freq, CAST(sum(count(*)) OVER (PARTITION BY doc) AS BIGINT) AS n_words FROM words GROUP BY doc, w""")
def lexical_index(spark, folder):
    """All postings of the written index; the two fields of a word are summed."""
    docs = documents(spark, folder).select(F.col("position").alias("doc"), "title", "text")
    index = build_index(docs, "doc", "title", "text")
    parts = max(1, -(-index.totals.first()["n_rows"] // INDEX_ROWS))
    return index.postings.repartition(parts, "doc").groupBy("doc", "word").agg(F.sum("freq").alias("freq"), F.first("n_words").cast("long").alias("n_words"))


@query("article_lookup", f"""
WITH {CORPUS_SQL}, {ARTICLES_SQL}, asked AS (SELECT k, CAST(k AS VARCHAR) AS law_id, k % 7 + 1 AS n FROM corpus)
SELECT q.k AS request, c.doc_id, a.article_no, a.article_title, trim(a.line) AS text
FROM asked q JOIN corpus c ON c.k = q.k AND c.doc_type = 'law' JOIN articles a ON a.k = c.k AND a.article_no = '제' || q.n || '조'""")
def article_lookup(spark, folder):
    """One article asked for per document, in all the ways a label is written; some do not exist."""
    docs = documents(spark, folder)
    k, n = F.col("position"), (F.pmod("position", F.lit(7)) + 1).cast("string")
    label = F.when(k % 3 == 0, n).when(k % 3 == 1, F.concat(n, F.lit("조"))).otherwise(F.concat(F.lit("제"), n, F.lit("조")))
    asked = docs.select(k.alias("request"), k.cast("string").alias("law_id"), label.alias("article_no"))
    found = articles_of(docs, asked)
    return found.select("request", "doc_id", "article_no", "article_title", F.btrim("text").alias("text"))


@query("case_lookup", f"""
WITH {CORPUS_SQL}, {ARTICLES_SQL}, held AS (SELECT k, count(*) AS n FROM articles GROUP BY k)
SELECT q.k AS request, c.case_no, c.title AS case_name, c.jurisdiction AS court, c.effective_from AS decided, coalesce(h.n, 0) AS n_sections
FROM corpus q JOIN corpus c ON c.k = q.k + 1 AND c.doc_type = 'precedent' LEFT JOIN held h ON h.k = c.k""")
def case_lookup(spark, folder):
    """Every document asks for the case with the next number; three in four do not exist."""
    docs = documents(spark, folder)
    asked = docs.select(F.col("position").alias("request"), (F.col("position") + 1).cast("string").alias("serial"))
    return cases_of(docs, asked).select(
        "request", "case_no", "case_name", "court", "decided", F.size("sections").cast("long").alias("n_sections"),
    )


@query("index_health", """
SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 4 <> 0) AS n_rows, 0 AS bad_dim, 0 AS norm_drift,
  (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.vec_id % 4 <> 0)) AS missing""")
def index_health(spark, folder):
    """The index of three quarters of the vectors against all documents."""
    emb = table(spark, folder, "embeddings").where("vec_id % 4 <> 0")
    index = emb.select(F.col("vec_id").cast("string").alias("chunk_id"), unit(F.col("embedding")).alias("vector"))
    chunks = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return inventory.index_health(index, chunks, 64)


@query("files_by_corpus", "SELECT source AS corpus, count(*) AS files FROM documents GROUP BY source")
def files_by_corpus(spark, folder):
    rows = table(spark, folder, "documents")
    return inventory.files_by_corpus(rows.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path")))


@query("first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def first_rows(spark, folder):
    return records.first_rows(table(spark, folder, "documents").select("doc_id", "lang"), 25, "doc_id")


def _json_lines(spark, folder):
    """Turns as JSON lines; every seventh line is broken."""
    turns = table(spark, folder, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    broken = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(7)) == 0
    path = fresh_path(spark, "json-lines")
    turns.select(F.when(broken, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    return path


_TURN = "conv_id long, turn long, role string, text string"


@query("json_lenient", "SELECT conv_id, turn, role, text FROM conversations WHERE (conv_id * 3 + turn) % 7 <> 0")
def json_lenient(spark, folder):
    return records.read_lenient(spark, _json_lines(spark, folder), _TURN)


@query("json_counting", """
SELECT (conv_id * 3 + turn) % 7 = 0 AS broken, count(*) AS n FROM conversations GROUP BY 1""")
def json_counting(spark, folder):
    rows = stage(records.read_counting(spark, _json_lines(spark, folder), _TURN), "counted-lines")
    return rows.withColumn("broken", F.col(records.CORRUPT).isNotNull()).groupBy("broken").agg(F.count(F.lit(1)).alias("n"))


@query("json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark, folder):
    path = fresh_path(spark, "json-rows")
    records.write_json(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"), path)
    return records.read_strict(spark, path, _TURN)


@query("audit_file", "SELECT source AS scope, lang AS rule, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY ALL")
def audit_file(spark, folder):
    path = fresh_path(spark, "audit")
    counted = table(spark, folder, "documents").groupBy(F.col("source").alias("scope"), F.col("lang").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    records.write_audit(counted, path)
    return spark.read.option("header", "true").csv(path)


@query("cache_file", """
SELECT content_hash, max(seq) AS seq, count(*) AS lines FROM (
  SELECT 'h' || (vec_id % 50) AS content_hash, vec_id % 2 AS seq FROM embeddings) GROUP BY 1""")
def cache_file(spark, folder):
    """Two appends to the cache; per hash the newest sequence and how many lines there are."""
    path = fresh_path(spark, "cache")
    emb = table(spark, folder, "embeddings").select(
        F.concat(F.lit("h"), F.pmod("vec_id", F.lit(50)).cast("string")).alias("content_hash"), F.col("embedding").alias("vector"), "vec_id",
    )
    for sequence in (0, 1):
        records.append_cache(emb.where(F.pmod("vec_id", F.lit(2)) == sequence), path, sequence)
    return spark.read.parquet(path).groupBy("content_hash").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("lines"))


@query("answer_plan", f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL}, scored AS ({dense_sql("vectors")}),
hits AS (SELECT query_id, rank, vec_id, score, doc_type, trust_grade FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 3),
short AS (SELECT query_id, max(rank) AS last_rank FROM hits GROUP BY query_id HAVING count(*) FILTER (WHERE doc_type IN ('law', 'admrule')) < 2),
extra AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE doc_type IN ('law', 'admrule')) WHERE place <= 5),
added AS (SELECT e.query_id, s.last_rank + row_number() OVER (PARTITION BY e.query_id ORDER BY place) AS rank,
    row_number() OVER (PARTITION BY e.query_id ORDER BY place) AS n, e.vec_id, e.score, e.doc_type, e.trust_grade
  FROM extra e JOIN short s ON e.query_id = s.query_id
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = e.query_id AND h.vec_id = e.vec_id)),
shown AS (SELECT * FROM hits UNION ALL SELECT query_id, rank, vec_id, score, doc_type, trust_grade FROM added WHERE n <= 3),
gated AS (SELECT query_id, count(*) AS n_blocks, max(CASE WHEN rank = 1 THEN score END) AS top_score FROM shown GROUP BY query_id),
cited AS (SELECT query_id, trust_grade FROM shown WHERE rank % 2 = 1),
trusted AS (SELECT query_id, count(*) AS n_citations, CAST(round_even(avg(CASE WHEN trust_grade = 'B' THEN 60 ELSE 100 END), 0) AS INTEGER) AS trust FROM cited GROUP BY query_id)
SELECT g.query_id, CASE WHEN top_score < 0.7 THEN 'low_score' ELSE 'answer' END AS decision, n_blocks,
  CASE WHEN top_score < 0.7 THEN 0 ELSE n_citations END AS n_citations, CASE WHEN top_score < 0.7 THEN 0 ELSE trust END AS trust_score
FROM gated g JOIN trusted t USING (query_id)""")
def answer_plan(spark, folder):
    """Search, backfill, context, gate, citation check and trust as one plan.

    The model's part is a table: it cites every other block, and blocks that do not exist.
    """
    queries = label_queries(spark, folder)
    cites = lambda shown: shown.where("rank % 2 = 1").select(
        "query_id", F.col("rank").alias("ordinal"), F.col("vec_id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("location"),
    ).unionByName(queries.select(
        "query_id", F.lit(99).alias("ordinal"), F.lit("none").alias("source_id"), F.lit(None).cast("string").alias("location"),
    ))
    done = answer.answer_plan(corpus(spark, folder), queries, cites, TODAY, k=3, min_score=0.7)
    return done.select("query_id", "decision", "n_blocks", "n_citations", "trust_score")


@query("review_plan", f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL}, scored AS ({dense_sql("vectors")}),
found AS (
  SELECT query_id, vec_id, title, rank, 0 AS pass FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored WHERE doc_type IN ('law', 'admrule')) WHERE rank <= 4
  UNION ALL SELECT query_id, vec_id, title, rank, 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 2),
shown AS (SELECT query_id % 2 AS review_id, title, row_number() OVER (PARTITION BY query_id % 2 ORDER BY query_id, pass, rank) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id % 2, vec_id ORDER BY query_id, pass, rank) AS n FROM found) WHERE n = 1),
copies AS (SELECT review_id, string_agg(title, ' / ') AS copy FROM shown WHERE rank % 2 = 0 GROUP BY review_id),
claims AS (SELECT query_id % 2 AS review_id, count(*) AS n_claims FROM queries GROUP BY 1)
SELECT c.review_id, n_claims, (SELECT count(*) FROM shown s WHERE s.review_id = c.review_id) AS n_blocks,
  (SELECT count(*) FROM shown s WHERE s.review_id = c.review_id) AS n_issues,
  (SELECT count(*) FROM shown s WHERE s.review_id = c.review_id AND s.rank % 5 IN (0, 1)) AS n_violations,
  (SELECT count(*) FROM shown s WHERE s.review_id = c.review_id AND s.rank % 3 = 0) AS n_citations,
  (SELECT count(*) FROM shown s JOIN copies p USING (review_id) WHERE s.review_id = c.review_id AND s.rank % 5 IN (0, 1) AND contains(copy, s.title)) AS n_unresolved
FROM claims c""")
def review_plan(spark, folder):
    """Two reviews whose claims are the labels; the model's part is planted on the shown blocks."""
    claims = label_queries(spark, folder).withColumns({"review_id": F.col("query_id") % 2, "ordinal": F.col("query_id")})

    def judge(shown):
        verdicts = F.array(*[F.lit(v) for v in ("위반", "위반소지", "주의", "적정", "unknown")])
        issues = shown.select(
            "review_id", F.col("rank").alias("issue_no"), F.concat(F.lit(" "), "title").alias("claim"),
            F.element_at(verdicts, (F.col("rank") % 5 + 1).cast("int")).alias("verdict"), F.lit("high").alias("severity"),
        )
        none = F.lit(None).cast("string").alias("location")
        cited = shown.where("rank % 3 = 0").select("review_id", F.col("rank").alias("ordinal"), F.col("vec_id").cast("string").alias("source_id"), none)
        unknown = shown.where("rank = 1").select("review_id", F.lit(0).alias("ordinal"), F.lit("none").alias("source_id"), none)
        copies = shown.where("rank % 2 = 0").groupBy("review_id").agg(F.array_join(F.collect_list("title"), " / ").alias("corrected_copy"))
        return issues, cited.unionByName(unknown).unionByName(cited), copies

    return review.review_plan(corpus(spark, folder), claims, judge, TODAY)
