"""Markdown files with a YAML head: reading, splitting, and heading spans."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.arrays import running
from docketry.functions.binding import let
from docketry.functions.text import strip, unix_lines

ARTICLE_TYPE = "struct<article_no:string,title:string,text:string,chapter_path:string,kind:string,amendments:array<string>>"
ATTACHMENT_TYPE = (
    "array<struct<`별표번호`:string,`별표가지번호`:string,`별표구분`:string,`제목`:string,`파일링크`:string,`PDF링크`:string>>"
)
DOCUMENT_COLUMNS = (
    "doc_id", "doc_type", "title", "jurisdiction", "law_kind", "effective_from", "source_url",
    "trust_grade", "articles", "attachments", "authority", "case_no", "gov_level", "locality",
    "serial", "meta", "path", "reject_reason",
)


def read_files(spark: SparkSession, root: str, name: str = "*.md", recursive: bool = True) -> DataFrame:
    """One row per file: ``path`` and ``content``."""
    reader = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", name)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return reader.load(root).select(path.alias("path"), unix_lines(F.col("value")).alias("content"))


def _flatten(value, full_datetime: bool):
    """YAML value with every scalar turned into text, so no later step re-types it."""
    if value is None:
        return None
    if isinstance(value, dict):
        return {str(k): _flatten(v, full_datetime) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_flatten(v, full_datetime) for v in value]
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value) if full_datetime else value.isoformat()[:10]
    return str(value)


_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class _WrittenDates(_Loader):
    """Loader that leaves dates as they are written."""


_WrittenDates.add_constructor("tag:yaml.org,2002:timestamp", lambda loader, node: loader.construct_scalar(node))


def _head_to_json(head: str | None, text_dates: bool, full_datetime: bool) -> str | None:
    if head is None:
        return None
    try:
        value = yaml.load(head, Loader=_WrittenDates if text_dates else _Loader)
    except (yaml.YAMLError, ValueError):
        return None
    if value is None:
        value = {}
    return json.dumps(_flatten(value, full_datetime), ensure_ascii=False) if isinstance(value, dict) else None


def head_json(head: Column, text_dates: bool = False, full_datetime: bool = False) -> Column:
    """YAML head as a JSON object of text leaves; null when it is not a mapping.

    ``text_dates`` leaves dates exactly as written, so ``0000-00-00`` survives.
    """

    @F.pandas_udf("string")
    def convert(heads: pd.Series) -> pd.Series:
        return heads.map(lambda h: _head_to_json(h, text_dates, full_datetime))

    return convert(head)


def split_head(df: DataFrame, loose: bool = False, byte_order_mark: bool = False, **head_options) -> DataFrame:
    """Add ``meta`` (VARIANT), ``body`` and ``has_head``; ``loose`` allows spaces after a fence."""
    mark = "\\x{feff}?" if byte_order_mark else ""
    pattern = rf"(?sU)^{mark}---\s*\n(.*?)\n---\s*\n?" if loose else rf"(?s)^{mark}---\n(.*?)\n---\n?"
    parts = let(
        lambda c: F.when(c.rlike(pattern), F.struct(
            F.regexp_extract(c, pattern, 1).alias("head"), F.regexp_extract(c, pattern + "(.*)$", 2).alias("body"),
        )),
        c=F.col("content"),
    )
    return (
        df.withColumn("_parts", parts)
        .withColumn("has_head", F.col("_parts").isNotNull())
        .withColumn("body", F.col("_parts.body"))
        .withColumn("meta", F.try_parse_json(head_json(F.col("_parts.head"), **head_options)))
        .drop("_parts", "content")
    )


def field(name: str, kind: str = "string") -> Column:
    """Value of a head key, null when absent or of another shape."""
    return F.try_variant_get("meta", f"$['{name}']", kind)


def scalar(name: str) -> Column:
    """Trimmed text of a head key; blank and absent are null."""
    value = strip(field(name))
    return F.when(value != "", value)


def list_of(name: str) -> Column:
    """Head key as a list of non-blank strings: a scalar counts as a list of one."""
    many = F.transform(field(name, "array<string>"), strip)
    one = F.array(scalar(name))
    return F.filter(F.coalesce(many, one), lambda v: v.isNotNull() & (v != ""))


def attachments() -> Column:
    return F.coalesce(field("첨부파일", ATTACHMENT_TYPE), F.array().cast(ATTACHMENT_TYPE))


def spans(body: Column, pattern: str) -> Column:
    """Headings found by ``pattern`` and the text that follows each one.

    Array of ``label`` (group 1), ``rest`` (group 2), ``match``, ``start`` (0-based
    offset) and ``text`` (up to the next heading). Runs inside the row: the body is
    cut by the same pattern that lists the headings, so nothing is exploded.
    """
    kind = "array<struct<label:string,rest:string,match:string,start:int,text:string>>"
    empty = F.array().cast(kind)

    def walk(whole: Column, label: Column, rest: Column, pieces: Column) -> Column:
        lengths = F.transform(whole, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        return let(lambda ends: F.transform(whole, lambda m, i: F.struct(
            F.get(label, i).alias("label"), F.get(rest, i).alias("rest"), m.alias("match"),
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(pieces, i + 1).alias("text"),
        )), ends=running(lengths, lambda x, y: x + y))

    def cut(b: Column) -> Column:
        found = lambda group: F.regexp_extract_all(b, F.lit(pattern), F.lit(group))
        return let(walk, whole=found(0), label=found(1), rest=found(2), pieces=F.split(b, pattern, -1))

    return let(lambda b: F.when(b.rlike(pattern), cut(b)).otherwise(empty), b=body)


def sections(body: Column, pattern: str) -> Column:
    """As :func:`spans`, but only ``label`` and ``text``: two passes over the body instead of five."""
    def cut(b: Column) -> Column:
        return let(
            lambda labels, pieces: F.transform(labels, lambda label, i: F.struct(label.alias("label"), F.get(pieces, i + 1).alias("text"))),
            labels=F.regexp_extract_all(b, F.lit(pattern), F.lit(1)), pieces=F.split(b, pattern, -1),
        )

    return let(cut, b=body)


def article(no: Column, title: Column, text: Column, chapter: Column | None = None,
            amendments: Column | None = None) -> Column:
    missing = F.lit(None).cast("string")
    return F.struct(
        no.alias("article_no"), title.alias("title"), text.alias("text"),
        (missing if chapter is None else chapter).alias("chapter_path"),
        missing.alias("kind"),
        (F.lit(None).cast("array<string>") if amendments is None else amendments).alias("amendments"),
    )


def as_document(df: DataFrame) -> DataFrame:
    """Bring a parsed frame to the common document columns, adding the missing ones."""
    kinds = {"articles": f"array<{ARTICLE_TYPE}>", "attachments": ATTACHMENT_TYPE, "meta": "variant"}
    columns = []
    for name in DOCUMENT_COLUMNS:
        kind = kinds.get(name, "string")
        value = F.col(name) if name in df.columns else F.lit(None)
        columns.append((value if name == "meta" and name in df.columns else value.cast(kind)).alias(name))
    return df.select(*columns)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull()).select("path", "reject_reason")
