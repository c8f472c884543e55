"""Parser queries: every text is dressed as a source file, then parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.catalog import query
from docketry.catalog.data import spread, table, wide_lines
from docketry.functions.text import strip
from docketry.plans.sub_corpus import rules_sub_corpus
from docketry.sources import markdown as M
from docketry.sources import parsers as P


def _numbered(render) -> Column:
    """Lines of the text, each rendered with its 1-based number, joined again."""
    return F.array_join(F.transform(wide_lines(), lambda line, i: render(line, (i + 1).cast("string"), i)), "\n")


def _file(spark, folder, path: Column, head: Column, body: Column) -> DataFrame:
    rows = spread(table(spark, folder, "documents"), "doc_id")
    return rows.select(path.alias("path"), F.concat(F.lit("---\n"), head, F.lit("\n---\n"), body).alias("content"))


def _exploded(parsed: DataFrame, *columns: str) -> DataFrame:
    return parsed.select(*columns, F.posexplode("articles").alias("pos", "a")).select(
        *columns, "pos", F.col("a.article_no").alias("article_no"), F.col("a.title").alias("article_title"),
        F.col("a.chapter_path").alias("chapter_path"), F.sha2(F.col("a.text"), 256).alias("text_hash"),
    )


_LINES = """
l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"""


@query("parse_statutes", f"""
WITH {_LINES}, kept AS (SELECT * FROM l WHERE trim(line) <> '')
SELECT 'LAW:' || doc_id || ':' || lang AS doc_id, 'A' AS trust_grade, '2024-07-03' AS effective_from, source AS authority,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos,
  '제' || (i + 1) || '조' || CASE WHEN i % 4 = 3 THEN '의2' ELSE '' END AS article_no,
  CASE WHEN i % 2 = 0 THEN '제목' || (i + 1) END AS article_title,
  '제' || (i // 6 + 1) || '장 총칙' || CASE WHEN i % 6 >= 3 THEN ' > 제1절 세부' ELSE '' END AS chapter_path,
  sha256(trim(line)) AS text_hash FROM kept""")
def parse_statutes(spark, folder):
    def render(line, n, i):
        chapter = F.when(i % 6 == 0, F.concat(F.lit("## 제"), (F.floor(i / 6) + 1).cast("string"), F.lit("장 총칙 <개정 2018.3.27>\n"))) \
            .when(i % 6 == 3, "### 제1절 세부\n").otherwise("")
        branch = F.when(i % 4 == 3, "의2").otherwise("")
        title = F.when(i % 4 == 2, F.concat(F.lit(" ((제목"), n, F.lit("))"))).when(i % 2 == 0, F.concat(F.lit(" (제목"), n, F.lit(")"))).otherwise("")
        return F.concat(chapter, F.lit("##### 제"), n, F.lit("조"), branch, title, F.lit("\n"), line, F.lit("\n"))

    key = F.col("doc_id").cast("string")
    head = F.concat(F.lit("제목: 법 "), key, F.lit("\n법령ID: '"), key, F.lit("'\n법령구분: '"), "lang", F.lit("'\n소관부처:\n- "), "source",
                    F.lit("\n시행일자: 2024-07-03\n첨부파일: []"))
    files = _file(spark, folder, F.concat(F.lit("/law/"), key, F.lit("/법률.md")), head, F.concat(F.lit("# 법\n"), _numbered(render)))
    # A heading without text is no article; the next heading's chapter lines are not text of this one.
    parsed = M.accepted(P.parse_statutes(files))
    return _exploded(_without_chapter_lines(parsed), "doc_id", "trust_grade", "effective_from", "authority")


def _without_chapter_lines(parsed: DataFrame) -> DataFrame:
    """Drop the chapter headings that end an article's text, and articles left empty by that."""
    trim = lambda text: strip(F.regexp_replace(text, r"(?m)^#{2,3} 제\d+[장절].*$", ""))
    articles = F.transform("articles", lambda a: a.withField("text", trim(a["text"])))
    return parsed.withColumn("articles", F.filter(articles, lambda a: a["text"] != ""))


@query("parse_statutes_lead", """
SELECT 'LAW:' || doc_id || ':' || lang AS doc_id, '본문' AS article_no, sha256(trim(text)) AS text_hash
FROM documents WHERE trim(text) <> ''""")
def parse_statutes_lead(spark, folder):
    """Statutes without article headings: the text before the supplement is one article."""
    key = F.col("doc_id").cast("string")
    head = F.concat(F.lit("법령ID: "), key, F.lit("\n법령구분: '"), "lang", F.lit("'"))
    body = F.concat(F.lit("\n# 제목 줄\n\n"), "text", F.lit("\n\n## 부칙\n제1조(시행일) 이 법은 공포한 날부터 시행한다.\n"))
    parsed = M.accepted(P.parse_statutes(_file(spark, folder, F.concat(F.lit("/law/"), key), head, body)))
    return parsed.select("doc_id", F.explode("articles").alias("a")).select(
        "doc_id", F.col("a.article_no").alias("article_no"), F.sha2(F.col("a.text"), 256).alias("text_hash")
    )


@query("parse_ordinances", f"""
WITH {_LINES}, kept AS (SELECT * FROM l WHERE trim(line) <> '')
SELECT 'ORD:' || source || ':' || doc_id AS doc_id, CASE lang WHEN 'en' THEN '광역' WHEN 'de' THEN '교육청' ELSE '기초' END AS gov_level,
  CASE WHEN lang NOT IN ('en', 'de') THEN lang END AS locality,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, '제' || (i + 1) || '조' AS article_no,
  '조제목' || (i + 1) AS article_title, CAST(NULL AS VARCHAR) AS chapter_path, sha256('①(1) ' || trim(line)) AS text_hash FROM kept""")
def parse_ordinances(spark, folder):
    """Headings are off by one and each text restates its own label, as in the flawed sources."""
    def render(line, n, i):
        own = F.concat(F.lit("제"), n, F.lit("조(조제목"), n, F.lit(") "))
        twice = F.when(i % 3 == 0, F.concat(own, own)).otherwise(own)
        text = F.when(strip(line) == "", "").otherwise(F.concat(twice, F.lit("① <개정 2020.1.1>"), line))
        return F.concat(F.lit("##### 제"), (i + 2).cast("string"), F.lit("조 (밀림)\n"), text, F.lit("\n"))

    key = F.col("doc_id").cast("string")
    area = F.when(F.col("lang") == "en", "_본청").when(F.col("lang") == "de", "_교육청").otherwise(F.col("lang"))
    head = F.concat(F.lit("자치법규ID: "), key, F.lit("\n자치법규명: 조례 "), key, F.lit("\n지자체구분:\n  광역: "), "source", F.lit("\n  기초: "), area)
    body = F.concat(F.lit("##### 제0조 (목적)\n제1장 총칙\n"), _numbered(render))
    parsed = M.accepted(P.parse_ordinances(_file(spark, folder, F.concat(F.lit("/ord/"), key), head, body)))
    return _exploded(parsed, "doc_id", "gov_level", "locality")


@query("parse_rules", f"""
WITH {_LINES}, named AS (
  SELECT doc_id, source, i, line, '제' || (i % 3 + 1) || '조' AS label, row_number() OVER (PARTITION BY doc_id, i % 3 ORDER BY i) AS nth FROM l)
SELECT 'ADMRULE:' || doc_id AS doc_id, source AS jurisdiction, CAST(i AS INTEGER) AS pos,
  label || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS article_no, '조' || (i + 1) AS article_title,
  '제' || (i // 4 + 1) || '장 장이름' AS chapter_path,
  sha256(CASE WHEN trim(line) = '' THEN '조' || (i + 1) ELSE trim(line) END) AS text_hash FROM named""")
def parse_rules(spark, folder):
    """Inline articles whose labels repeat, under chapters that carry forward."""
    def render(line, n, i):
        chapter = F.when(i % 4 == 0, F.concat(F.lit("제"), (F.floor(i / 4) + 1).cast("string"), F.lit("장  장이름\n"))).otherwise("")
        label = F.concat(F.lit("제"), (i % 3 + 1).cast("string"), F.lit("조(조"), n, F.lit(") "))
        return F.concat(chapter, label, line)

    key = F.col("doc_id").cast("string")
    head = F.concat(F.lit("행정규칙ID: "), key, F.lit("\n행정규칙명: 고시 "), key, F.lit("\n소관부처명: "), "source", F.lit("\n시행일자: 2023-03-01"))
    parsed = M.accepted(P.parse_rules(_file(spark, folder, F.concat(F.lit("/r/"), key, F.lit("/본문.md")), head, _numbered(render))))
    # The chapter line that precedes the next article is part of this one's text in the source.
    trim = lambda text: strip(F.regexp_replace(text, r"(?m)^제\d+장  장이름$", ""))
    articles = F.transform("articles", lambda a: a.withField("text", F.coalesce(F.nullif(trim(a["text"]), F.lit("")), a["title"])))
    return _exploded(parsed.withColumn("articles", articles), "doc_id", "jurisdiction")


@query("parse_cases", f"""
WITH {_LINES}, kept AS (SELECT * FROM l WHERE trim(line) <> '')
SELECT 'PREC:' || doc_id AS doc_id, '사건 ' || doc_id AS title, '2019다' || doc_id AS case_no,
  CASE WHEN doc_id % 3 = 0 THEN '2020-05-07' WHEN doc_id % 3 = 1 THEN '2020-05-01' END AS effective_from,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, '절 ' || (i + 1) AS article_no,
  CAST(NULL AS VARCHAR) AS article_title, CAST(NULL AS VARCHAR) AS chapter_path, sha256('[당사자] ' || trim(line)) AS text_hash FROM kept""")
def parse_cases(spark, folder):
    """Sections with masked names; the date comes from the head, the file name, or nowhere."""
    def render(line, n, i):
        text = F.when(strip(line) == "", "").otherwise(F.concat(F.lit("○○○  "), line))
        return F.concat(F.lit("## 절 "), n, F.lit("\n"), text, F.lit("\n"))

    key = F.col("doc_id").cast("string")
    third = F.pmod("doc_id", F.lit(3))
    day = F.when(third == 0, "2020-05-07").otherwise("0000-00-00")
    name = F.when(third == 1, "2020-05-01").otherwise("0000-00-00")
    head = F.concat(F.lit("판례일련번호: "), key, F.lit("\n사건번호: 2019다"), key, F.lit("\n사건명: 사건 "), key, F.lit("\n법원명: 대법원\n선고일자: "), day)
    path = F.concat(F.lit("/p/대법원_"), name, F.lit("_2019다"), key, F.lit(".md"))
    parsed = M.accepted(P.parse_cases(_file(spark, folder, path, head, F.concat(F.lit("# 사건\n머리말\n"), _numbered(render)))))
    return _exploded(parsed, "doc_id", "title", "case_no", "effective_from")


@query("parse_rejects", """
SELECT '/law/' || doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'no readable head' ELSE 'law id or kind missing' END AS reject_reason
FROM documents WHERE doc_id % 4 <> 2 AND doc_id % 4 <> 3""")
def parse_rejects(spark, folder):
    """Files that cannot become documents are listed with the reason, not lost."""
    key = F.col("doc_id").cast("string")
    kind = F.pmod("doc_id", F.lit(4))
    head = F.when(kind == 0, "- not\n- a mapping").when(kind == 1, "법령ID: 5").otherwise(F.concat(F.lit("법령ID: "), key, F.lit("\n법령구분: 법률")))
    return M.rejected(P.parse_statutes(_file(spark, folder, F.concat(F.lit("/law/"), key), head, F.col("text"))))


_INCLUDE, _DENY = ["src1", "en"], ["src12", "de"]
_FATES_SQL = """
fates AS (SELECT doc_id AS k, '/r/' || source || ' ' || lang || '/' || doc_id || '.md' AS path, source || ' ' || lang AS scope,
  CASE WHEN contains(source, 'src1') THEN 'src1' WHEN contains(source || ' ' || lang, 'en') THEN 'en' END AS matched,
  CASE WHEN contains(source, 'src12') THEN 'src12' WHEN contains(source || ' ' || lang, 'de') THEN 'de' END AS denied FROM documents),
judged AS (SELECT *, CASE WHEN matched IS NULL THEN 'skipped' WHEN denied IS NOT NULL THEN 'denied' WHEN k % 17 = 0 THEN 'rejected'
  WHEN k = max(CASE WHEN matched IS NOT NULL AND denied IS NULL AND k % 17 <> 0 THEN k END) OVER (PARTITION BY k // 3) THEN 'kept' ELSE 'dropped' END AS outcome FROM fates)"""


def _sub_corpus(spark, folder):
    """Rules in folders by source and language; three neighbours are revisions of one rule, some have no head."""
    k = F.col("doc_id")
    head = F.concat(F.lit("---\n행정규칙ID: r"), F.floor(k / 3).cast("string"), F.lit("\n행정규칙명: 고시\n행정규칙일련번호: "), k.cast("string"), F.lit("\n---\n"))
    path = F.concat(F.lit("/r/"), "source", F.lit(" "), "lang", F.lit("/"), k.cast("string"), F.lit(".md"))
    files = spread(table(spark, folder, "documents"), "doc_id").select(
        path.alias("path"), F.concat(F.when(k % 17 != 0, head).otherwise(""), F.lit("제1조(목적) "), "text").alias("content"),
    )
    return rules_sub_corpus(files, _INCLUDE, _DENY)


@query("sub_corpus", f"""WITH {_FATES_SQL}
SELECT path, scope, CASE WHEN outcome IN ('kept', 'dropped') THEN 'ADMRULE:r' || k // 3 END AS doc_id, outcome,
  CASE outcome WHEN 'skipped' THEN NULL WHEN 'denied' THEN denied WHEN 'rejected' THEN 'no readable head' ELSE matched END AS term FROM judged""")
def sub_corpus(spark, folder):
    return _sub_corpus(spark, folder).files


@query("sub_corpus_documents", f"""WITH {_FATES_SQL}
SELECT 'ADMRULE:r' || k // 3 AS doc_id, path, CAST(k AS VARCHAR) AS serial FROM judged WHERE outcome = 'kept'""")
def sub_corpus_documents(spark, folder):
    return _sub_corpus(spark, folder).docs.select("doc_id", "path", "serial")


@query("sub_corpus_counts", f"""WITH {_FATES_SQL}
SELECT o AS outcome, count(j.k) AS files FROM unnest(['kept', 'dropped', 'denied', 'rejected', 'skipped']) t(o) LEFT JOIN judged j ON j.outcome = o GROUP BY o""")
def sub_corpus_counts(spark, folder):
    """Counts that were observed while the outcomes were written."""
    return spark.createDataFrame(list(_sub_corpus(spark, folder).counts.items()), "outcome string, files long")
