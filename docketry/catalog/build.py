"""Corpus-building queries: chunks, parents, governance, dedup, embedding plans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from docketry.catalog import query
from docketry.catalog.data import ARTICLES_SQL, CHUNKS_SQL, CORPUS_SQL, documents, spread, table
from docketry.functions.text import content_hash, count_tokens
from docketry.operators import chunking, dedup, embedding, filters, governance, inventory, names, waves
from docketry.operators.joins import substring_matches
from docketry.operators.sequences import changes, greedy_batches
from docketry.operators.waves import Waves
from docketry.session import fresh_path, stage
from docketry.settings import DEFAULTS


@query("chunk_documents", f"""
WITH {CHUNKS_SQL}
SELECT chunk_id, doc_id, sha256(trim(chunk_body, ' ' || chr(10))) AS content_hash, article_no, article_title, chapter AS chapter_path,
  CAST(0 AS INTEGER) AS part_idx, kind, trust_grade, gov_level, locality FROM chunks""")
def chunk_documents(spark, folder):
    return chunking.chunk(documents(spark, folder)).select(
        "chunk_id", "doc_id", "content_hash", "payload.article_no", "payload.article_title", "payload.chapter_path",
        "payload.part_idx", "payload.kind", "payload.trust_grade", "payload.gov_level", "payload.locality",
    )


# Windows step by step: sentence ends, token sums, then one window after the other.
_WINDOWS_SQL = rf"""
WITH RECURSIVE {CHUNKS_SQL}, heads AS (
  SELECT k, i, chunk_id, line1 || chr(10) || line2 AS head, trim(line) AS body,
    len(regexp_extract_all(line1 || ' ' || line2, '\S+')) AS head_tokens, len(regexp_extract_all(trim(line), '\S+')) AS body_tokens FROM chunks
), long AS (
  SELECT *, 160 - head_tokens AS room, least(60, 160 - head_tokens) AS goal,
    string_split(regexp_replace(body, '([.!?。])[\s''"”’」』)\]]*\s+', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM heads WHERE head_tokens + body_tokens > 160
), raw_parts AS (
  SELECT k, i, room, goal, trim(unnest(parts)) AS s, unnest(range(len(parts))) AS place FROM long
), sized AS (
  SELECT k, i, room, goal, s, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY k, i) AS parts, regexp_extract_all(s, '\S+') AS tokens,
    sum(len(regexp_extract_all(s, '\S+'))) OVER w AS upto
  FROM raw_parts WHERE s <> '' WINDOW w AS (PARTITION BY k, i ORDER BY place)
), ends AS (
  SELECT a.k, a.i, a.j, any_value(a.room) AS room, any_value(a.tokens) AS tokens, any_value(a.upto) AS upto, any_value(a.parts) AS parts,
    greatest(max(b.j) FILTER (b.upto - (a.upto - len(a.tokens)) <= a.goal), a.j) + 1 AS stop
  FROM sized a JOIN sized b ON a.k = b.k AND a.i = b.i AND b.j BETWEEN a.j AND a.j + 60 GROUP BY a.k, a.i, a.j
), follow AS (
  SELECT e.k, e.i, e.j, any_value(e.room) AS room, any_value(e.tokens) AS tokens, any_value(e.stop) AS stop, any_value(e.parts) AS parts,
    string_agg(b.s, ' ' ORDER BY b.j) FILTER (b.j < e.stop) AS text,
    coalesce(max(b.j) FILTER (b.j > e.j AND b.j < e.stop AND l.upto - (b.upto - len(b.tokens)) >= 12), e.j + 1) AS back
  FROM ends e JOIN sized b ON e.k = b.k AND e.i = b.i AND b.j BETWEEN e.j AND e.stop - 1
    JOIN sized l ON l.k = e.k AND l.i = e.i AND l.j = e.stop - 1 GROUP BY e.k, e.i, e.j
), steps AS (
  SELECT *, CASE WHEN len(tokens) > room THEN j + 1 WHEN stop = parts THEN NULL ELSE greatest(back, j + 1) END AS next FROM follow
), walk(k, i, j, n) AS (
  SELECT k, i, CAST(0 AS BIGINT), 0 FROM long UNION ALL
  SELECT w.k, w.i, s.next, n + 1 FROM walk w JOIN steps s ON s.k = w.k AND s.i = w.i AND s.j = w.j WHERE s.next IS NOT NULL AND s.next < s.parts
), pieces AS (
  SELECT w.k, w.i, w.n, 0 AS m, text FROM walk w JOIN steps s ON s.k = w.k AND s.i = w.i AND s.j = w.j WHERE len(tokens) <= room
  UNION ALL
  SELECT k, i, n, m, array_to_string(tokens[m + 1:m + room], ' ') FROM (
    SELECT w.k, w.i, w.n, tokens, room, unnest(range(0, greatest(1, len(tokens) - 12), room - 12)) AS m
    FROM walk w JOIN steps s ON s.k = w.k AND s.i = w.i AND s.j = w.j WHERE len(tokens) > room)
), cut AS (
  SELECT k, i, row_number() OVER (PARTITION BY k, i ORDER BY n, m) - 1 AS part_idx, text FROM pieces
), every AS (
  SELECT h.chunk_id, h.head, h.head_tokens, coalesce(c.part_idx, 0) AS part_idx, coalesce(c.text, h.body) AS part
  FROM heads h LEFT JOIN cut c ON c.k = h.k AND c.i = h.i
)
SELECT regexp_replace(chunk_id, '#0$', '#' || part_idx) AS chunk_id, CAST(head_tokens + len(regexp_extract_all(part, '\S+')) AS INTEGER) AS n_tokens,
  sha256(trim(nfc_normalize(head) || chr(10) || part)) AS content_hash, CAST(part_idx AS INTEGER) AS part_idx FROM every"""


@query("window_chunks", _WINDOWS_SQL)
def window_chunks(spark, folder):
    """Chunks under a small size limit, so that most articles are cut into overlapping windows."""
    small = replace(DEFAULTS, embed_max_tokens=160, window_tokens=60, overlap_tokens=12)
    return chunking.chunk(documents(spark, folder), small).select("chunk_id", "n_tokens", "content_hash", "payload.part_idx")


@query("parents_full_text", f"""
WITH {CORPUS_SQL}, {ARTICLES_SQL}, joined AS (
  SELECT k, string_agg(article_no || coalesce('(' || article_title || ')', '') || chr(10) || trim(line), chr(10) || chr(10) ORDER BY i) AS t
  FROM articles GROUP BY k)
SELECT c.doc_id AS parent_id, doc_type, title, trust_grade, sha256(coalesce(t, '')) AS full_text FROM corpus c LEFT JOIN joined j ON c.k = j.k""")
def parents_full_text(spark, folder):
    return chunking.parents(documents(spark, folder)).select(
        "parent_id", "doc_type", "title", "trust_grade", F.sha2("full_text", 256).alias("full_text")
    )


def _flawed_chunks(spark, folder):
    """Chunks with one fault planted by the shape of their id."""
    chunks = chunking.chunk(documents(spark, folder))
    flaw = F.pmod(F.length("chunk_id"), F.lit(8))
    payload = F.col("payload")
    set_field = lambda name, value: payload.withField(name, value)
    none = F.lit(None).cast("string")
    broken = (
        F.when(flaw == 1, set_field("law_kind", none)).when(flaw == 2, set_field("kind", F.lit("별지")))
        .when(flaw == 3, set_field("trust_grade", none)).when(flaw == 4, set_field("parent_id", F.lit("LAW:0:x")))
        .when(flaw == 5, set_field("article_no", F.lit("제999조"))).otherwise(payload)
    )
    text = F.when(flaw == 6, F.regexp_replace("text", "(?s)^([^\n]*)\n[^\n]*", "$1\n")).when(flaw == 7, "").otherwise(F.col("text"))
    return governance.validate(chunks.withColumn("payload", broken).withColumn("text", text))


_FLAWED_SQL = f"""
WITH {CHUNKS_SQL}, flawed AS (
  SELECT chunk_id, doc_id, doc_type, effective_from, length(chunk_id) % 8 AS flaw FROM chunks),
errors AS (SELECT chunk_id, doc_type, list_filter([
    CASE WHEN flaw = 7 THEN 'empty or missing ''text''' END,
    CASE WHEN flaw = 1 THEN 'payload filter key ''law_kind'' is empty/None' END,
    CASE WHEN effective_from IS NULL AND doc_type <> 'precedent' THEN 'payload filter key ''effective_from'' is empty/None' END,
    CASE WHEN flaw = 2 THEN 'invalid kind 별지' END,
    CASE WHEN flaw = 3 THEN 'invalid trust_grade None' END,
    CASE WHEN flaw = 4 THEN 'parent_id LAW:0:x != doc_id ' || doc_id END,
    CASE WHEN flaw = 7 THEN 'missing L1 인용헤더 (first line empty)' END,
    CASE WHEN flaw = 5 THEN 'L1 missing required field ''article_no'': 제999조 not in L1 header' END,
    CASE WHEN flaw IN (6, 7) THEN 'missing L2 맥락헤더 (second line empty)' END
  ], lambda e: e IS NOT NULL) AS errors FROM flawed)"""


@query("validate_chunks", f"{_FLAWED_SQL} SELECT chunk_id, errors FROM errors")
def validate_chunks(spark, folder):
    return _flawed_chunks(spark, folder).select("chunk_id", "errors")


@query("governance_by_type", f"{_FLAWED_SQL} SELECT doc_type, count(*) AS n, count(*) FILTER (WHERE len(errors) > 0) AS n_bad FROM errors GROUP BY doc_type")
def governance_by_type(spark, folder):
    return governance.by_type(_flawed_chunks(spark, folder))


@query("governance_by_error", f"""{_FLAWED_SQL}
SELECT string_split(e, ':')[1] AS error_class, count(*) AS n FROM (SELECT unnest(errors) AS e FROM errors) GROUP BY 1""")
def governance_by_error(spark, folder):
    return governance.by_error(_flawed_chunks(spark, folder))


@query("governance_first_faults", f"""{_FLAWED_SQL}
SELECT chunk_id, errors FROM errors WHERE len(errors) > 0""")
def governance_first_faults(spark, folder):
    return governance.faults(_flawed_chunks(spark, folder))


@query("doc_dedup_first", f"""
WITH {CORPUS_SQL} SELECT key, k, doc_type FROM (
  SELECT md5(text) AS key, k, doc_type, row_number() OVER (PARTITION BY md5(text)
    ORDER BY CASE doc_type WHEN 'law' THEN 0 WHEN 'ordinance' THEN 1 WHEN 'admrule' THEN 2 ELSE 3 END, k) AS n FROM corpus) WHERE n = 1""")
def doc_dedup_first(spark, folder):
    docs = documents(spark, folder)
    source = F.expr("array_position(array('law', 'ordinance', 'admrule', 'precedent'), doc_type)")
    rows = docs.select(F.md5("text").alias("key"), F.col("position").alias("k"), "doc_type", source.alias("source_order"))
    return dedup.keep_first(rows, "key", ["source_order", "k"]).drop("source_order")


@query("best_revision", f"""
WITH {CORPUS_SQL}, r AS (SELECT source || '/' || lang AS key, k, n_chars % 7 AS serial, trust_grade, n_chars FROM corpus)
SELECT key, k, trust_grade, n_chars, first_seen FROM (
  SELECT *, min(k) OVER (PARTITION BY key) AS first_seen, row_number() OVER (PARTITION BY key
    ORDER BY serial DESC, CASE WHEN trust_grade = 'A' THEN 1 ELSE 0 END DESC, n_chars DESC, k) AS n FROM r) WHERE n = 1""")
def best_revision(spark, folder):
    rows = documents(spark, folder).select(
        F.concat_ws("/", "jurisdiction", "law_kind").alias("key"), F.col("position").alias("k"),
        F.concat(F.lit("제"), (F.col("n_chars") % 7).cast("string"), F.lit("호")).alias("serial"), "trust_grade", "n_chars",
    )
    return dedup.keep_best_revision(rows, "key", "serial", "trust_grade", "n_chars", "k").drop("serial")


@query("content_hash_dedup", """
SELECT sha256(trim(text)) AS content_hash, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS n_members FROM documents GROUP BY 1""")
def content_hash_dedup(spark, folder):
    rows = table(spark, folder, "documents").withColumn("content_hash", content_hash(F.col("text")))
    return dedup.one_per_hash(rows, "content_hash", "doc_id", ["lang"])


@query("cache_last_wins", """
SELECT 'h' || (vec_id % 97) AS content_hash, max(vec_id) AS vec_id FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1""")
def cache_last_wins(spark, folder):
    """Last cache line per hash; lines whose vector has the wrong size do not count."""
    emb = table(spark, folder, "embeddings")
    wrong = F.pmod("vec_id", F.lit(5)) == 0
    cache = emb.select(
        F.concat(F.lit("h"), (F.col("vec_id") % 97).cast("string")).alias("content_hash"), F.col("vec_id").alias("seq"),
        F.when(wrong, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"), "vec_id",
    )
    best = embedding.valid_cache(cache, 64)
    return best.join(cache.select("content_hash", "vector", "vec_id"), ["content_hash", "vector"]).select("content_hash", "vec_id")


def _hashed_documents(spark, folder):
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("doc_id").alias("position"), "lang",
        content_hash(F.col("text")).alias("content_hash"),
    )


def _german_cache(spark, folder):
    return _hashed_documents(spark, folder).where("lang = 'de'").select("content_hash").distinct()


@query("embed_misses", """
WITH h AS (SELECT doc_id, lang, sha256(trim(text)) AS content_hash FROM documents)
SELECT content_hash, min(doc_id) AS position, count(*) AS n_members FROM h
WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE lang = 'de') GROUP BY content_hash""")
def embed_misses(spark, folder):
    return embedding.missing(_hashed_documents(spark, folder), _german_cache(spark, folder)).drop("text")


@query("resume_filter", "SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def resume_filter(spark, folder):
    done = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"))
    return embedding.remaining(_hashed_documents(spark, folder), done).select("chunk_id")


@query("cost_estimate", r"""
WITH h AS (SELECT sha256(trim(text)) AS c, lang, len(regexp_split_to_array(trim(text), '\s+')) AS t FROM documents),
per AS (SELECT c, count(*) AS n, max(t) AS t, c IN (SELECT c FROM h WHERE lang = 'de') AS hit FROM h GROUP BY c)
SELECT CAST(sum(n) AS BIGINT) AS n_chunks, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS n_cached, count(*) FILTER (WHERE NOT hit) AS n_unique_misses,
  CAST(sum(CASE WHEN hit THEN 0 ELSE t END) AS BIGINT) AS total_tokens,
  round(CAST(sum(CASE WHEN hit THEN 0 ELSE t END) AS DOUBLE) / 1000000 * 0.02 * 0.5, 4) AS est_usd FROM per""")
def cost_estimate(spark, folder):
    return embedding.estimate(_hashed_documents(spark, folder), _german_cache(spark, folder))


@query("vector_fan_out", """
WITH h AS (SELECT doc_id, sha256(trim(text)) AS c FROM documents), first AS (SELECT c, min(doc_id) AS vec_id FROM h GROUP BY c)
SELECT CAST(h.doc_id AS VARCHAR) AS chunk_id, round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: i * CAST(e.embedding[i] AS DOUBLE))), 4) AS x
FROM h JOIN first USING (c) JOIN embeddings e USING (vec_id)""")
def vector_fan_out(spark, folder):
    chunks = _hashed_documents(spark, folder)
    emb = table(spark, folder, "embeddings").select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    vectors = dedup.one_per_hash(chunks, "content_hash", "position", []).join(emb, "position")
    return embedding.fan_out(chunks, vectors).select("chunk_id", F.round(_weighted_sum(F.col("vector")), 4).alias("x"))


def _weighted_sum(vector):
    """A number that every element of a vector takes part in, each with its own weight."""
    return F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def _batches_sql(size: str, items: int, limit: int, order: str = "doc_id") -> str:
    return f"""
WITH RECURSIVE s AS (SELECT {order} AS doc_id, {size} AS size, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
p AS (SELECT *, sum(size) OVER (ORDER BY n) AS upto FROM s),
nxt AS (SELECT a.n AS n, min(b.n) AS m FROM p a JOIN p b ON b.n > a.n AND b.n <= a.n + {items}
    AND (b.n - a.n + 1 > {items} OR b.upto - (a.upto - a.size) > {limit}) GROUP BY a.n),
starts(n, batch_no) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
  SELECT nxt.m, batch_no + 1 FROM starts JOIN nxt ON nxt.n = starts.n)
SELECT p.doc_id, max(batch_no) AS batch_no FROM p JOIN starts ON starts.n <= p.n GROUP BY p.doc_id"""


@query("request_batches", _batches_sql(r"len(regexp_split_to_array(trim(text), '\s+'))", 24, 4000))
def request_batches(spark, folder):
    """Requests filled in order up to an item and a token limit."""
    rows = table(spark, folder, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens"))
    return greedy_batches(rows, "doc_id", "tokens", 24, 4000)


@query("shard_plan", _batches_sql("strlen(text)", 100, 60_000))
def shard_plan(spark, folder):
    """Upload shards filled in order up to a line and a byte limit."""
    rows = table(spark, folder, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    return greedy_batches(rows, "doc_id", "bytes", 100, 60_000)


@query("request_batches_sparse", _batches_sql(r"len(regexp_split_to_array(trim(text), '\s+'))", DEFAULTS.batch_items, DEFAULTS.batch_tokens, "doc_id * 5000011"))
def request_batches_sparse(spark, folder):
    """Requests under the production limits, numbered far apart."""
    rows = table(spark, folder, "documents").select((F.col("doc_id") * 5000011).alias("doc_id"), count_tokens(F.col("text")).alias("tokens"))
    return greedy_batches(rows, "doc_id", "tokens", DEFAULTS.batch_items, DEFAULTS.batch_tokens)


@query("shard_plan_sparse", _batches_sql("strlen(text)", DEFAULTS.shard_lines, DEFAULTS.shard_bytes // 512, "doc_id * 5000011"))
def shard_plan_sparse(spark, folder):
    """Upload shards under the production line limit and a byte limit that these tables reach."""
    rows = table(spark, folder, "documents").select((F.col("doc_id") * 5000011).alias("doc_id"), F.octet_length("text").alias("bytes"))
    return greedy_batches(rows, "doc_id", "bytes", DEFAULTS.shard_lines, DEFAULTS.shard_bytes // 512)


def _greedy_sql(name: str, rows: str, items: int, limit: int) -> str:
    """CTEs that fill batches from ``rows`` (key, size) in order of the key."""
    return f"""
{name}_p AS (SELECT *, sum(size) OVER (ORDER BY n) AS upto FROM (SELECT key, size, row_number() OVER (ORDER BY key) AS n FROM {rows})),
{name}_x AS (SELECT a.n AS n, min(b.n) AS m FROM {name}_p a JOIN {name}_p b ON b.n > a.n AND b.n <= a.n + {items}
    AND (b.n - a.n + 1 > {items} OR b.upto - (a.upto - a.size) > {limit}) GROUP BY a.n),
{name}_s(n, batch_no) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
  SELECT x.m, batch_no + 1 FROM {name}_s s JOIN {name}_x x ON x.n = s.n),
{name} AS (SELECT p.key, p.size, s.batch_no FROM {name}_p p ASOF JOIN {name}_s s ON p.n >= s.n)"""


def _plan_sql(name: str, rows: str, w: Waves) -> str:
    return f"""{_greedy_sql(name + "_r", rows, w.request_items, w.request_tokens)},
{name}_z AS (SELECT batch_no AS key, sum(size) AS size FROM {name}_r GROUP BY batch_no),
{_greedy_sql(name + "_w", name + "_z", w.wave_requests, w.wave_tokens)},
{name} AS (SELECT r.key, r.size, r.batch_no AS request_no, w.batch_no + 1 AS wave_no FROM {name}_r r JOIN {name}_w w ON w.key = r.batch_no)"""


_WAVES = Waves(request_items=24, request_tokens=4_000, wave_requests=5, wave_tokens=12_000)


@query("wave_resume", f"""
WITH RECURSIVE sized AS (SELECT doc_id AS key, len(regexp_split_to_array(trim(text), '\\s+')) AS size FROM documents),
{_plan_sql("a", "sized", _WAVES)},
half AS (SELECT max(wave_no) // 2 AS h FROM a),
rest AS (SELECT key, size FROM a, half WHERE wave_no > h + 1 OR wave_no = h + 1 AND key % 2 = 1),
{_plan_sql("b", "rest", _WAVES)}
SELECT key AS doc_id, wave_no + h + 1 AS wave_no, request_no FROM b, half""")
def wave_resume(spark, folder):
    """A run in waves that broke off: half of its waves are complete, the next one has the vectors of even keys and was refused."""
    rows = stage(table(spark, folder, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens")), "wave-sizes")
    path = fresh_path(spark, "wave-run")
    first = stage(waves.plan_waves(rows, *waves.opened(spark, path, "doc_id"), _WAVES, "doc_id"), "wave-plan")
    half = first.agg(F.floor(F.max("wave_no") / 2)).first()[0] or 0
    log = first.where(F.col("wave_no") <= half + 1).select("wave_no").distinct().select(
        "wave_no", F.lit(1).alias("attempt"), F.when(F.col("wave_no") <= half, "completed").otherwise("failed").alias("status"),
        F.when(F.col("wave_no") > half, "token_limit_exceeded").alias("code"),
    )
    known = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    finished = first.where((F.col("wave_no") <= half) | (F.col("wave_no") == half + 1) & (F.col("doc_id") % 2 == 0))
    waves.write_waves(finished.select("doc_id", "wave_no").join(known, "doc_id", "left"), path)
    waves.append_log(log, path)
    return waves.plan_waves(rows, *waves.opened(spark, path, "doc_id"), _WAVES, "doc_id")


@query("wave_states", """
WITH lines AS (SELECT l_orderkey AS wave_no, l_linenumber AS attempt, l_returnflag = 'R' AND l_linenumber > 3 AS ok, l_suppkey % 7 > 0 AS quota FROM lineitem),
log AS (SELECT DISTINCT wave_no, attempt, ok, quota AND NOT ok AS quota FROM lines),
w AS (SELECT wave_no, count(DISTINCT attempt) AS attempts, count(*) FILTER (WHERE quota) AS refusals, bool_or(ok) AS done, count(*) AS n FROM log GROUP BY wave_no)
SELECT wave_no, attempts, refusals, CASE WHEN done THEN 'done' WHEN refusals = n AND refusals <= 4 THEN 'retry' ELSE 'stopped' END AS state FROM w""")
def wave_states(spark, folder):
    """Order lines as attempts at waves: refused for quota, failed for good, or completed."""
    ok = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 3)
    quota = F.col("l_suppkey") % 7 > 0
    log = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("wave_no"), F.col("l_linenumber").alias("attempt"), F.when(ok, "completed").otherwise("failed").alias("status"),
        F.when(~ok, F.when(quota, F.lit("token_limit_exceeded")).otherwise("invalid")).alias("code"),
    )
    return waves.wave_states(log, Waves(quota_retries=4))


@query("corpus_stats", f"""
WITH {CORPUS_SQL}, {ARTICLES_SQL}, n AS (SELECT k, count(*) AS a FROM articles GROUP BY k)
SELECT doc_type, law_kind, count(*) AS docs, CAST(sum(coalesce(a, 0)) AS BIGINT) AS articles,
  count(*) FILTER (WHERE trust_grade = 'B') AS grade_b, count(DISTINCT jurisdiction) AS regions
FROM corpus c LEFT JOIN n ON c.k = n.k GROUP BY doc_type, law_kind""")
def corpus_stats(spark, folder):
    return inventory.corpus_stats(documents(spark, folder))


@query("chunk_stats", f"""
WITH {CHUNKS_SQL}, twice AS (SELECT count(*) AS n FROM corpus WHERE k % 9 = 0)
SELECT (SELECT count(*) FROM corpus) + n AS docs, (SELECT count(*) FROM corpus) AS parents, CAST(n AS BIGINT) AS duplicate_docs,
  (SELECT count(*) FROM chunks) AS chunks,
  (SELECT count(*) FROM chunks WHERE len(regexp_split_to_array(trim(chunk_body), '\\s+')) > 40) AS over_limit FROM twice""")
def chunk_stats(spark, folder):
    """Every ninth document comes again from a second source; its first reading stays."""
    read = documents(spark, folder).withColumn("source_order", F.explode(F.sequence(F.lit(0), (F.col("position") % 9 == 0).cast("int"))))
    return inventory.chunk_stats(read, chunking.chunk(chunking.first_documents(read)), 40)


@query("chunk_histogram", f"""
WITH {CHUNKS_SQL} SELECT kind, trust_grade, count(*) AS chunks, CAST(0 AS BIGINT) AS blank FROM chunks GROUP BY kind, trust_grade""")
def chunk_histogram(spark, folder):
    return inventory.chunk_histogram(chunking.chunk(documents(spark, folder)))


@query("prefix_coverage", f"""
WITH {CORPUS_SQL} SELECT string_split(doc_id, ':')[1] AS prefix, count(*) AS rows, count(DISTINCT doc_id) AS ids
FROM corpus JOIN embeddings ON vec_id = k GROUP BY 1""")
def prefix_coverage(spark, folder):
    emb = table(spark, folder, "embeddings").select(F.col("vec_id").alias("position"))
    return inventory.coverage(documents(spark, folder).select("position", "doc_id").join(emb, "position"), "doc_id")


@query("block_transitions", """
SELECT doc_id, lang FROM (SELECT doc_id, lang, lag(lang) OVER (ORDER BY doc_id) AS prev FROM documents) WHERE prev IS DISTINCT FROM lang""")
def block_transitions(spark, folder):
    return changes(table(spark, folder, "documents"), "doc_id", "lang")


@query("core_corpus", f"WITH {CORPUS_SQL} SELECT doc_id FROM corpus WHERE NOT starts_with(doc_id, 'ORD:')")
def core_corpus(spark, folder):
    return filters.drop_corpus(documents(spark, folder)).select("doc_id")


@query("grade_filters", f"""
WITH {CORPUS_SQL}, g AS (SELECT doc_id, CASE WHEN k % 7 = 0 THEN NULL ELSE trust_grade END AS grade FROM corpus)
SELECT doc_id, 'full' AS rule FROM g WHERE grade IS DISTINCT FROM 'B' UNION ALL SELECT doc_id, 'sub' FROM g WHERE grade = 'A'""")
def grade_filters(spark, folder):
    """The full index keeps rows of unknown grade, the sub-corpus does not."""
    rows = documents(spark, folder).select(
        "doc_id", F.when(F.pmod("position", F.lit(7)) != 0, F.col("trust_grade")).alias("trust_grade")
    )
    tag = lambda df, rule: df.select("doc_id", F.lit(rule).alias("rule"))
    return tag(filters.drop_metadata_only(rows), "full").unionByName(tag(filters.keep_full_text(rows), "sub"))


@query("index_rows", f"""
WITH {CORPUS_SQL} SELECT c.doc_id AS chunk_id, trust_grade,
  round(list_sum(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * x)), 4) AS squared
FROM corpus c JOIN embeddings e ON e.vec_id = c.k WHERE trust_grade <> 'B'""")
def index_rows(spark, folder):
    docs = documents(spark, folder).select(
        "position", F.col("doc_id").alias("chunk_id"), F.struct("doc_type", "trust_grade").alias("payload")
    )
    emb = table(spark, folder, "embeddings").select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    vectors = docs.select("position", "chunk_id").join(emb, "position").select("chunk_id", "vector")
    rows = embedding.index_rows(docs.drop("position"), vectors, 64)
    squared = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return rows.select("chunk_id", "payload.trust_grade", F.round(squared, 4).alias("squared"))


@query("keyed_upsert", """
SELECT c_custkey AS point_id, c_name AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'new' ELSE 'old' END AS version FROM customer""")
def keyed_upsert(spark, folder):
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_name").alias("name"), F.lit("old").alias("version"))
    active = table(spark, folder, "orders").select(F.col("o_custkey").alias("point_id")).distinct()
    new = old.join(active, "point_id", "left_semi").withColumn("version", F.lit("new"))
    return embedding.upsert(old, new)


_INCLUDE, _DENY = ["의료", "약사", "src1"], ["src12", "수의"]


@query("keyword_selection", f"""
WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN contains(title, '의료') THEN '의료' WHEN contains(title, '약사') THEN '약사'
    WHEN contains(title, 'src1') THEN 'src1' END AS matched,
  CASE WHEN contains(title, 'src12') THEN 'src12' END AS denied,
  contains(title, 'src1') AND NOT contains(title, 'src12') AS keep FROM corpus""")
def keyword_selection(spark, folder):
    choice = filters.keyword_decision(F.col("title"), _INCLUDE, _DENY)
    return documents(spark, folder).select("doc_id", choice.alias("c")).select("doc_id", "c.matched", "c.denied", "c.keep")


@query("laws_cited", r"""
WITH t AS (SELECT doc_id, regexp_replace(replace(replace(replace(replace(text, ' the ', ' 구 의료법 '), ' les ', ' 국민의료법 '),
    ' der ', ' 약사 법 '), ' de ', ' 옛의료법,구약사법 '), '\s+', '', 'g') AS x FROM documents)
SELECT doc_id, list_sort(list_filter([
    CASE WHEN regexp_matches(x, '(^|[^가-힣]|구)의료법') THEN '의료법' END,
    CASE WHEN regexp_matches(x, '(^|[^가-힣]|구)(약사법|국민의료법)') THEN '약사법' END], lambda v: v IS NOT NULL)) AS laws FROM t""")
def laws_cited(spark, folder):
    x = F.col("text")
    for word, law in ((" the ", " 구 의료법 "), (" les ", " 국민의료법 "), (" der ", " 약사 법 "), (" de ", " 옛의료법,구약사법 ")):
        x = F.replace(x, F.lit(word), F.lit(law))
    laws = filters.laws_cited(x, ["의료법", "약사법"], {"국민의료법": "약사법"})
    return table(spark, folder, "documents").select("doc_id", laws.alias("laws"))


@query("names_cited", r"""
WITH known AS (SELECT DISTINCT name FROM (SELECT unnest(string_split_regex(text, '\s+')) AS name FROM benchmark) WHERE length(name) >= 9),
texts AS (SELECT doc_id, regexp_replace(replace(replace(text, ' the ', ' 가 '), ' of ', ' 구 '), '\s+', '', 'g') AS x FROM documents),
found AS (SELECT doc_id, list_sort(list(name)) AS laws FROM texts JOIN known ON contains(x, name)
  AND regexp_matches(x, '(^|[^가-힣]|구)' || regexp_escape(name)) GROUP BY doc_id)
SELECT doc_id, coalesce(laws, []) AS laws FROM documents LEFT JOIN found USING (doc_id)""")
def names_cited(spark, folder):
    """All long words of the passages as names, searched in whole texts by one automaton."""
    x = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" 가 ")), F.lit(" of "), F.lit(" 구 "))
    known = table(spark, folder, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("name")).where(F.length("name") >= 9)
    rows = spread(table(spark, folder, "documents").select("doc_id", x.alias("x")), "doc_id")
    return names.names_cited(rows, "x", known.withColumn("canonical", F.col("name")), "laws").select("doc_id", "laws")


@query("title_in_text", """
WITH names AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(text, ' ')) AS name FROM benchmark) WHERE length(name) >= 9), texts AS (SELECT conv_id, turn, text FROM conversations)
SELECT name, conv_id, turn FROM names JOIN texts ON contains(text, name)""")
def title_in_text(spark, folder):
    """Containment join: all long words of the passages found inside turns, through their rarest letter pair."""
    names = table(spark, folder, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).where(F.length("name") >= 9).distinct()
    texts = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return substring_matches(names, texts, "name", "text", ["conv_id", "turn"]).select("name", "conv_id", "turn")
