"""Search queries: dense, lexical, hybrid, filters, pages, bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.catalog import query
from docketry.catalog.data import (
    BENCHMARK_QUERIES_SQL, CORPUS_SQL, LABEL_QUERIES_SQL, LICENSE_SQL, TOKENS_SQL, VECTORS_SQL,
    benchmark_queries, corpus, dense_sql, documents, indexed_corpus, indexed_documents, label_queries, table, vectors,
)
from docketry.functions.dates import in_force_if_known, in_force_lenient, in_force_listed, in_force_strict, force_status
from docketry.functions.vectors import dot, norm, unit
from docketry.operators import posting_store, vector_index
from docketry.operators.filters import looks_like_citation, metadata_filter
from docketry.operators.lexical import build_index, bm25_top, prefix_terms
from docketry.operators.ranking import keep_best, nearest
from docketry.operators.fusion import rrf
from docketry.plans import answer, source_pack
from docketry.plans.search import expand, hybrid_ranks, prepare_queries, search, statutes_page, word_ranks
from docketry.session import fresh_path

AS_OF = "2015-06-30"
TODAY = "2024-01-15"


_DENSE_SQL = f"""
WITH {LABEL_QUERIES_SQL}, vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
scored AS ({dense_sql("vectors")})
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 8"""


@query("dense_topk", _DENSE_SQL)
def dense_topk(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, label_queries(spark, folder), 8, "vec_id")


@query("dense_topk_bounded", _DENSE_SQL)
def dense_topk_bounded(spark, folder):
    """The same rows from an index in cells; cells that cannot hold one of them are not read."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    index = vector_index.build(rows, fresh_path(spark, "vector-index"), "vec_id")
    return vector_index.nearest_bounded(index, label_queries(spark, folder), 8)


_FILTER = {"doc_type": ["law", "admrule"], "law_kind": "en"}
_FILTER_SQL = f"doc_type IN ('law', 'admrule') AND law_kind = 'en' AND effective_from <= '{AS_OF}'"


@query("dense_topk_filtered_exact", f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL},
scored AS (SELECT * FROM ({dense_sql("vectors")}) WHERE {_FILTER_SQL})
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score, doc_id, effective_from FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 8""")
def dense_topk_filtered_exact(spark, folder):
    hits = search(corpus(spark, folder), label_queries(spark, folder), 8, _FILTER, AS_OF)
    return hits.select("query_id", "rank", "vec_id", "score", "doc_id", "effective_from")


@query("dense_topk_overfetch", f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL}, scored AS ({dense_sql("vectors")}),
fitting AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE {_FILTER_SQL})
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score, doc_id, effective_from FROM fitting WHERE place <= 8""")
def dense_topk_overfetch(spark, folder):
    hits = search(corpus(spark, folder), label_queries(spark, folder), 8, _FILTER, AS_OF, mode="overfetch")
    return hits.select("query_id", "rank", "vec_id", "score", "doc_id", "effective_from")


@query("unit_vectors", """
SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS squared,
  round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * CAST(embedding[i] AS DOUBLE)))
    / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS weighted_unit,
  len(embedding) = 64 AS right_size
FROM embeddings""")
def unit_vectors(spark, folder):
    v = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        "vec_id", F.round(dot(v, v), 6).alias("squared"), F.round(F.aggregate(F.transform(unit(v), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("weighted_unit"),
        (F.size(v) == 64).alias("right_size"),
    )


@query("filter_match_any", f"""
WITH {CORPUS_SQL} SELECT doc_id, doc_type, jurisdiction, law_kind FROM corpus
WHERE doc_type IN ('law', 'precedent') AND jurisdiction IN ('src1', 'src3', 'src5')""")
def filter_match_any(spark, folder):
    keep = metadata_filter({"doc_type": ["law", "precedent"], "jurisdiction": {"src1", "src3", "src5"}})
    return documents(spark, folder).where(keep).select("doc_id", "doc_type", "jurisdiction", "law_kind")


@query("as_of_rules", f"""
WITH {CORPUS_SQL} SELECT doc_id,
  coalesce(effective_from <= '{AS_OF}', false) AS strict, coalesce(effective_from <= '{AS_OF}', true) AS lenient,
  coalesce(effective_from <= '{AS_OF}', false) AS listed, coalesce(effective_from <= '{AS_OF}', true) AS if_known,
  CASE WHEN effective_from IS NULL THEN '미상' WHEN effective_from > '{TODAY}' THEN '시행예정' ELSE '현행' END AS status
FROM corpus""")
def as_of_rules(spark, folder):
    date = F.col("effective_from")
    return documents(spark, folder).select(
        "doc_id", in_force_strict(date, AS_OF).alias("strict"), in_force_lenient(date, AS_OF).alias("lenient"),
        in_force_listed(date, AS_OF).alias("listed"), in_force_if_known(date, F.lit(AS_OF)).alias("if_known"),
        force_status(date, TODAY).alias("status"),
    )


@query("query_terms", r"""
SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'),
    lambda t: regexp_replace(t, '[^0-9A-Za-z가-힣]', '', 'g')), lambda t: length(t) >= 2) AS terms FROM benchmark""")
def query_terms(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", prefix_terms(F.col("text")).alias("terms"))


@query("citation_like", r"""
WITH t AS (SELECT conv_id, turn, replace(replace(text, ' the ', ' 민법 '), ' les ', ' 제 4 조 ') AS x FROM conversations)
SELECT conv_id, turn, regexp_matches(x, '제\s?\d+\s?조')
  OR len(list_filter(list_transform(regexp_split_to_array(x, '\s+'), lambda w: regexp_replace(w, '[^0-9A-Za-z가-힣]', '', 'g')),
    lambda w: length(w) >= 2 AND regexp_matches(w, '(법|법률|령|규칙)$'))) > 0 AS cites FROM t""")
def citation_like(spark, folder):
    rows = table(spark, folder, "conversations")
    x = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" 민법 ")), F.lit(" les "), F.lit(" 제 4 조 "))
    return rows.select("conv_id", "turn", looks_like_citation(x).alias("cites"))


@query("query_expansion", """
WITH t AS (SELECT conv_id, turn, replace(replace(text, ' the ', ' 월급 '), ' de ', ' 집주인 ') AS x FROM conversations)
SELECT conv_id, turn, x || CASE WHEN contains(x, '월급') OR contains(x, '집주인') THEN ' ' ELSE '' END
  || concat_ws(' ', CASE WHEN contains(x, '월급') THEN '임금' END, CASE WHEN contains(x, '집주인') THEN '임대인' END) AS expanded
FROM t""")
def query_expansion(spark, folder):
    x = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" 월급 ")), F.lit(" de "), F.lit(" 집주인 "))
    return table(spark, folder, "conversations").select("conv_id", "turn", expand(x).alias("expanded"))


_WORDS_SQL = f"""
WITH {CORPUS_SQL}, searched AS (SELECT k AS vec_id, title, text FROM corpus),
word_queries AS (SELECT item_id AS query_id, text FROM benchmark), {TOKENS_SQL}
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc, score FROM (
  SELECT query_id, vec_id AS doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM bm25)
WHERE rank <= 10"""


@query("bm25_topk", _WORDS_SQL)
def bm25_topk(spark, folder):
    queries = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    return word_ranks(indexed_documents(spark, folder), queries, 10)


@query("bm25_appended", _WORDS_SQL)
def bm25_appended(spark, folder):
    """Two thirds of the documents indexed at first, the rest appended, one at a time opened by version."""
    docs = documents(spark, folder).select(F.col("position").alias("doc"), "title", "text")
    queries = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    path = fresh_path(spark, "appended-index")
    base = posting_store.create(docs.where(F.pmod("doc", F.lit(3)) != 0), path, "doc", "title", "text")
    posting_store.append(base, docs.where(F.pmod("doc", F.lit(3)) == 0), "title", "text")
    return posting_store.top(posting_store.open_store(spark, path), queries, "query_id", "text", 10)


@query("bm25_built_here", _WORDS_SQL)
def bm25_built_here(spark, folder):
    """The same ranking from an index that only this search uses."""
    docs = documents(spark, folder).select(F.col("position").alias("doc"), "title", "text")
    queries = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    return bm25_top(build_index(docs, "doc", "title", "text"), queries, "query_id", "text", 10)


def _fused_sql(rows: str) -> str:
    """Fused ranking over the vectors that ``rows`` admits; only ids and scores are carried."""
    return f"""
WITH {VECTORS_SQL}, {BENCHMARK_QUERIES_SQL}, searched AS (SELECT vec_id, title, text FROM vectors WHERE {rows}),
word_queries AS (SELECT query_id, text FROM queries WHERE cites), {TOKENS_SQL},
scored AS MATERIALIZED (SELECT q.query_id, v.vec_id, round(list_dot_product(v.vector, q.vector), 6) AS score FROM vectors v, queries q WHERE {rows}),
dense AS MATERIALIZED (SELECT * FROM (SELECT query_id, vec_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 50),
lexical_raw AS MATERIALIZED (SELECT * FROM (SELECT query_id, vec_id,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM bm25) WHERE rank <= 50),
lexical AS MATERIALIZED (SELECT query_id, l.vec_id, row_number() OVER (PARTITION BY query_id
  ORDER BY CASE WHEN l.vec_id % 4 = 0 THEN 0 ELSE 1 END, rank) AS rank FROM lexical_raw l),
both_lists AS (
  SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.vec_id, l.vec_id) AS vec_id, d.rank AS dr, l.rank AS lr,
    coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(2.0::DOUBLE / (60 + l.rank), 0) AS rrf
  FROM dense d FULL JOIN lexical l ON d.query_id = l.query_id AND d.vec_id = l.vec_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dr NULLS LAST, lr NULLS LAST) AS rank FROM both_lists),
fused AS MATERIALIZED (SELECT o.*, s.score FROM ordered o JOIN scored s ON o.query_id = s.query_id AND o.vec_id = s.vec_id)"""


@query("rrf_hybrid", f"""{_fused_sql("true")}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(rrf, 9) AS rrf, score FROM fused""")
def rrf_hybrid(spark, folder):
    """The whole fused list of every query, both lists 50 deep."""
    ranked = hybrid_ranks(indexed_corpus(spark, folder), prepare_queries(benchmark_queries(spark, folder)), 50)
    return ranked.select("query_id", "rank", "vec_id", F.round("rrf", 9).alias("rrf"), "score")


@query("hybrid_page", f"""{_fused_sql(f"effective_from <= '{TODAY}'")},
kept AS (SELECT f.query_id, f.vec_id, f.score, c.doc_id, c.title, c.effective_from, c.trust_grade, c.source_url, c.doc_type
  FROM fused f JOIN corpus c ON c.k = f.vec_id WHERE f.rank <= 12),
paged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM kept)
SELECT query_id, CAST(position AS INTEGER) AS position, doc_id, doc_type, title, score, trust_grade, source_url,
  {LICENSE_SQL} AS license, '{TODAY}' AS as_of_date, effective_from
FROM paged WHERE position > 4 AND position <= 12""")
def hybrid_page(spark, folder):
    """Second page of a hybrid search: fusion decides membership, the score decides order."""
    hits = search(indexed_corpus(spark, folder), benchmark_queries(spark, folder), 12, as_of=TODAY, hybrid=True)
    page = statutes_page(hits, 8, 4, TODAY, key="vec_id")
    return page.select("query_id", "position", "doc_id", "doc_type", "title", "score", "trust_grade", "source_url",
                       "license", "as_of_date", "effective_from")


_HITS_SQL = f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL}, scored AS ({dense_sql("vectors")}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored) WHERE rank <= 8)"""


def _hits(spark, folder, k=8):
    return search(corpus(spark, folder), label_queries(spark, folder), k)


@query("ensure_statutes", f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL}, scored AS ({dense_sql("vectors")}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored) WHERE rank <= 3),
short AS (SELECT query_id, max(rank) AS last_rank FROM hits GROUP BY query_id
  HAVING count(*) FILTER (WHERE doc_type IN ('law', 'admrule')) < 2),
extra AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE doc_type IN ('law', 'admrule')) WHERE place <= 5),
added AS (SELECT e.query_id, s.last_rank + row_number() OVER (PARTITION BY e.query_id ORDER BY place) AS rank,
    row_number() OVER (PARTITION BY e.query_id ORDER BY place) AS n, e.vec_id, e.score, e.doc_type
  FROM extra e JOIN short s ON e.query_id = s.query_id
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = e.query_id AND h.vec_id = e.vec_id))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score, doc_type FROM hits
UNION ALL SELECT query_id, CAST(rank AS INTEGER), vec_id, score, doc_type FROM added WHERE n <= 3""")
def ensure_statutes(spark, folder):
    queries = label_queries(spark, folder)
    rows = corpus(spark, folder)
    out = answer.ensure_statutes(rows, queries, search(rows, queries, 3))
    return out.select("query_id", "rank", "vec_id", "score", "doc_type")


@query("context_blocks", f"""{_HITS_SQL},
blocks AS (SELECT query_id, rank, '[' || rank || '] id=' || vec_id || ' | 종류=' || doc_type || ' | 제목=' || title || ' | 위치=- | 등급='
  || trust_grade || CASE WHEN trust_grade = 'B' THEN ' [본문없음·메타데이터만(B등급)]' ELSE '' END || ' | 출처=' || source_url || chr(10)
  || trim(text) AS block FROM hits)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY query_id""")
def context_blocks(spark, folder):
    return answer.contexts(_hits(spark, folder), "vec_id")


@query("low_score_gate", f"""{_HITS_SQL}
SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top_score,
  CASE WHEN max(CASE WHEN rank = 1 THEN score END) < 0.7 THEN 'low_score' ELSE 'answer' END AS decision
FROM hits GROUP BY query_id""")
def low_score_gate(spark, folder):
    return answer.gate(label_queries(spark, folder), _hits(spark, folder), 0.7)


_PACK_SQL = f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL}, scored AS ({dense_sql("vectors")}),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored) WHERE rank <= 24),
live AS (SELECT * FROM ranked WHERE effective_from IS NULL OR effective_from <= '{AS_OF}'),
grouped AS (SELECT query_id, jurisdiction AS parent_id, min(rank) AS first_rank, count(*) AS n_children,
    arg_min(score, rank) AS score, arg_min(title, rank) AS child_title, arg_min(trust_grade, rank) AS child_grade,
    arg_min(effective_from, CASE WHEN effective_from IS NULL THEN NULL ELSE rank END) AS any_from
  FROM live GROUP BY query_id, jurisdiction),
texts AS (SELECT query_id, parent_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS child_text FROM (
    SELECT query_id, jurisdiction AS parent_id, trim(text) AS text, min(rank) AS rank FROM live
    WHERE trim(text) <> '' GROUP BY query_id, jurisdiction, trim(text)) GROUP BY query_id, parent_id),
packed AS (SELECT g.*, t.child_text, row_number() OVER (PARTITION BY g.query_id ORDER BY first_rank) AS rank
  FROM grouped g LEFT JOIN texts t ON g.query_id = t.query_id AND g.parent_id = t.parent_id)"""


def _by_source(spark, folder):
    """Hits whose parent is their source, so that several children share a parent."""
    hits = _hits(spark, folder, 24)
    return hits.withColumn("parent_id", F.col("jurisdiction"))


@query("parent_promotion", f"""{_PACK_SQL}
SELECT query_id, CAST(rank AS INTEGER) AS rank, parent_id, n_children, score, child_title, child_grade,
  coalesce(child_text, '') AS child_text FROM packed""")
def parent_promotion(spark, folder):
    out = source_pack.promote(_by_source(spark, folder), AS_OF, "vec_id")
    return out.select("query_id", "rank", "parent_id", "n_children", F.col("rep.score").alias("score"),
                      F.col("rep.title").alias("child_title"), F.col("rep.trust_grade").alias("child_grade"), "child_text")


_DOC_PACK_SQL = f"""
WITH {VECTORS_SQL}, {LABEL_QUERIES_SQL}, scored AS ({dense_sql("vectors")}),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
  FROM scored) WHERE place <= 8),
live AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM ranked
  WHERE effective_from IS NULL OR effective_from <= '{AS_OF}'),
whole AS (SELECT query_id, rank, doc_id, doc_type, title, trust_grade, source_url, effective_from, score, trim(text) AS full_text,
  CASE WHEN vec_id % 5 = 0 OR trim(text) = '' THEN 'child' ELSE 'parent' END AS text_origin FROM live)"""


def _packed(spark, folder):
    """Sources of a bundle; parents are missing for every fifth document."""
    parents = documents(spark, folder).where(F.pmod("position", F.lit(5)) != 0).select(
        F.col("doc_id").alias("parent_id"), "doc_type", "title", "law_kind", "jurisdiction", "trust_grade", "source_url",
        F.lit(None).cast("string").alias("license"), "effective_from", F.col("text").alias("full_text"),
    )
    return source_pack.sources(source_pack.promote(_hits(spark, folder), AS_OF, "vec_id"), parents, AS_OF)


@query("source_pack_sources", f"""{_DOC_PACK_SQL}
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, doc_type, title, trust_grade, source_url, {LICENSE_SQL} AS license,
  effective_from, '{AS_OF}' AS as_of_date, text_origin, CAST(length(full_text) AS INTEGER) AS chars, score FROM whole""")
def source_pack_sources(spark, folder):
    return _packed(spark, folder).select("query_id", "rank", "doc_id", "doc_type", "title", "trust_grade", "source_url",
                                         "license", "effective_from", "as_of_date", "text_origin", "chars", "score")


@query("source_pack_markdown", f"""{_DOC_PACK_SQL},
sections AS (SELECT query_id, rank, concat_ws(chr(10),
    '## [' || rank || '] ' || CASE doc_type WHEN 'law' THEN '법령' WHEN 'ordinance' THEN '자치법규' WHEN 'admrule' THEN '행정규칙' ELSE '판례' END
      || ' · ' || title,
    '- 시행/선고일: ' || coalesce(effective_from, '미상') || ' · 신뢰등급: ' || trust_grade || ' · 라이선스: ' || {LICENSE_SQL},
    '- 출처: ' || source_url, '- 식별자: `' || doc_id || '`',
    CASE WHEN text_origin = 'child' THEN '- ⚠️ 주의: 전체 원문 미확보 — 검색된 조문/섹션 일부만 포함됩니다.' END,
    CASE WHEN trust_grade = 'B' THEN '- ⚠️ 주의: 본문 없음(B등급) — 메타데이터에 한정된 출처입니다.' END,
    '',
    (SELECT string_agg(CASE WHEN l = '' THEN '>' ELSE '> ' || l END, chr(10) ORDER BY n) FROM (
      SELECT unnest(string_split(shown, chr(10))) AS l, unnest(range(len(string_split(shown, chr(10))))) AS n)),
    '') AS section
  FROM (SELECT *, CASE WHEN full_text = '' THEN '_(원문 본문 없음)_' ELSE full_text END AS shown FROM whole))
SELECT query_id, '# 소스 팩 (인용 가능 원문 번들)' || chr(10) || chr(10)
  || '> 아래 각 출처의 원문만 근거로 인용하십시오. 본문에 없는 사실은 추가하지 마십시오. 각 출처의 시행일·등급·라이선스를 함께 명시하십시오.'
  || chr(10) || chr(10) || rtrim(string_agg(section, chr(10) ORDER BY rank), chr(10)) || chr(10) AS markdown
FROM sections GROUP BY query_id""")
def source_pack_markdown(spark, folder):
    return source_pack.bundle(label_queries(spark, folder), _packed(spark, folder))
