"""The named queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.catalog import Entry
from docketry.llm import bpe, collocations, exact_dedup, html_text, impact, licenses, merkle, minhash, mixing, ordinal, quality_rules, repeats, url_filter

ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str | None = None):
    def keep(fn):
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_SQL = rf"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS body, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS pos
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
  ) GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, lang, len(w) AS n_words, length(translate(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(body) - length(translate(body, '!', '')) AS n_shouts,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_same
  FROM words w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), scored AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS r1, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS r2,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS r3, CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0 END AS r4,
    CASE WHEN n_words > 0 THEN n_same / n_words ELSE 0 END AS r5
  FROM counted
), long AS (
  SELECT s.lang, u.rule, u.v FROM (SELECT * FROM scored WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) s,
    LATERAL (VALUES ('r1', s.r1), ('r2', s.r2), ('r3', s.r3), ('r4', s.r4), ('r5', s.r5)) u(rule, v)
), grid AS (
  SELECT lang, rule, cut, pos, count(*) AS total, count(*) FILTER (v >= cut) AS hits
  FROM long, (SELECT unnest([{", ".join(map(str, quality_rules.SHARES))}]) AS cut, unnest(range(0, {len(quality_rules.SHARES)})) AS pos)
  GROUP BY ALL
), tested AS (
  SELECT *, list_sum(list_transform(range(0, hits + 1), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1)
    + i * ln(0.01) + (total - i) * ln(0.99)))) > 0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM long)) AS fails FROM grid
), usable AS (
  SELECT lang, rule, min(cut) AS cut FROM tested t
  WHERE NOT EXISTS (SELECT 1 FROM tested f WHERE f.lang IS NOT DISTINCT FROM t.lang AND f.rule = t.rule AND f.pos <= t.pos AND f.fails)
  GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM usable u WHERE u.lang IS NOT DISTINCT FROM s.lang
    AND CASE u.rule WHEN 'r1' THEN r1 WHEN 'r2' THEN r2 WHEN 'r3' THEN r3 WHEN 'r4' THEN r4 ELSE r5 END >= u.cut) AS kept
FROM scored s
"""


@entry("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


@entry("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, folder, "documents"), keep_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@entry("op3_exact_dedup", r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW w AS (PARTITION BY body)
""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


@entry("op4_mix_sources")
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


#: Block and allow rules of the url query.
URL_RULES = (
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
)


@entry("op5_url_filter", r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), judged AS (
  SELECT page_id, host, path, (
    SELECT max_by(r, strlen(r.host || r.path)) FROM (VALUES
      ({'verdict': 'block', 'host': 'net', 'path': '/'}), ({'verdict': 'allow', 'host': 'example.net', 'path': '/en/'}),
      ({'verdict': 'block', 'host': 'example.com', 'path': '/de/'}), ({'verdict': 'allow', 'host': 'org', 'path': '/fr/'})) t(r)
    WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  ) AS best FROM parsed p
)
SELECT page_id, host, path, best.host || best.path AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
""")
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_filter(table(spark, folder, "pages"), URL_RULES)


@entry("op6_minhash_dedup")
def op6_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = minhash.near_groups(table(spark, folder, "documents"), minhash.Near(words=3, percent=85))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@entry("op7_html_text")
def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


@entry("op8_bpe")
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    made = bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@entry("op9_ordinal_quality")
def op9_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = table(spark, folder, "labels").select("doc_id", grade.alias("grade"))
    return ordinal.score(docs, ordinal.train(docs, graded))


@entry("op10_license_scan")
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    best = F.get("matches", F.lit(0))
    return found.select(
        "doc_id", best["license"].alias("license"), best["coverage"].alias("coverage"), best["start"].alias("start"), best["stop"].alias("stop"),
        F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"),
    )


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), sizes AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang
), runs AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, pos, array_to_string(c.w[1:pos], ' ') AS head, array_to_string(c.w[pos + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS pos FROM f WHERE k > 1) c
), scored AS (
  SELECT c.lang, c.phrase, any_value(c.k) AS k, any_value(c.a) AS a,
    min({'score': (2000000 * c.a::HUGEINT // (h.a::HUGEINT + r.a))::BIGINT, 'k': c.pos, 'l': h.a, 'r': r.a}) AS worst
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest GROUP BY c.lang, c.phrase
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2))
), longer AS (
  SELECT lang, phrase, max(a) AS b FROM inside GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY worst.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, worst.l AS l, worst.r AS r, z.n, worst.score AS score
FROM scored s JOIN sizes z USING (lang) LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
WHERE o.b IS NULL OR 100 * o.b < 80 * s.a QUALIFY rank <= 2000
"""


@entry("op11_phrase_mining", PHRASE_SQL)
def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@entry("op12_exact_topk", """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""")
def op12_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return impact.exact_top_k(table(spark, folder, "embeddings"))


MANIFEST_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) t(i))
), tampered AS (
  SELECT d.*, coalesce(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: xor(tab[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) % 7 = 0, false) AS hit FROM documents d, crc_table
), written AS (
  SELECT doc_id, lang, hit, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other,
    coalesce(strlen(text) || ':' || text, '-') AS back FROM tampered
), leaves AS (
  SELECT doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rk, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (ORDER BY lang NULLS FIRST, doc_id, leaf) AS no
  FROM (SELECT doc_id, lang, sha256(front || own || back) AS leaf, sha256(front || CASE WHEN hit THEN other ELSE own END || back) AS changed FROM written)
), low AS (
  SELECT lang, 0 AS lvl, rk AS i, leaf AS d, n AS c FROM leaves
  UNION ALL
  SELECT lang, any_value(lvl) + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(c) + 1) // 2 FROM low WHERE c > 1 GROUP BY lang, i // 2
), subs AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM low WHERE c = 1
), high AS (
  SELECT 0 AS lvl, k AS i, subroot AS d, n AS c FROM subs
  UNION ALL
  SELECT any_value(lvl) + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(c) + 1) // 2 FROM high WHERE c > 1 GROUP BY i // 2
), steps AS (
  SELECT l.no, a.lvl, b.d, a.i % 2 = 0 AS is_right FROM leaves l JOIN low a ON a.lang IS NOT DISTINCT FROM l.lang AND a.i = l.rk >> a.lvl AND a.c > 1
    LEFT JOIN low b ON b.lang IS NOT DISTINCT FROM a.lang AND b.lvl = a.lvl AND b.i = xor(a.i, 1)
  UNION ALL
  SELECT l.no, 100 + a.lvl, b.d, a.i % 2 = 0 FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN high a ON a.i = s.k >> a.lvl AND a.c > 1
    LEFT JOIN high b ON b.lvl = a.lvl AND b.i = xor(a.i, 1)
), paths AS (
  SELECT l.no, l.changed, coalesce(list({'d': s.d, 'r': s.is_right} ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL), []) AS p, coalesce(string_agg(s.d, '' ORDER BY s.lvl), '') AS proof
  FROM leaves l LEFT JOIN steps s USING (no) GROUP BY ALL
), folding AS (
  SELECT no, p, changed AS acc, 1 AS pos FROM paths
  UNION ALL
  SELECT no, p, sha256(CASE WHEN p[pos].d IS NULL THEN acc WHEN p[pos].r THEN acc || p[pos].d ELSE p[pos].d || acc END), pos + 1 FROM folding WHERE pos <= len(p)
)
SELECT l.doc_id, l.leaf, s.subroot, h.d AS root, sha256(q.proof) AS proof_sha256, f.acc AS folded_root, f.acc = h.d AS verified
FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN paths q USING (no) JOIN folding f ON f.no = l.no AND f.pos > len(f.p), (SELECT d FROM high WHERE c = 1) h
"""


@entry("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audited(table(spark, folder, "documents"))
