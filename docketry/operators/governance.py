"""Chunk validation and the governance report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import strip
from docketry.settings import CHUNK_KINDS, DOC_TYPES, TRUST_GRADES

# What every chunk must carry.
HEADER_FIELDS = {
    "law": ("title", "article_no", "effective_from"),
    "ordinance": ("title", "article_no", "effective_from"),
    "admrule": ("title", "article_no", "effective_from"),
    "precedent": ("jurisdiction", "article_no", "effective_from"),
}
FILTER_FIELDS = ("doc_type", "jurisdiction", "law_kind", "effective_from")
MAY_BE_UNDATED = ("precedent",)
PAYLOAD_FIELDS = (
    "doc_type", "jurisdiction", "law_kind", "effective_from",
    "doc_id", "parent_id", "article_no", "part_idx",
    "title", "trust_grade", "source_url", "license", "kind",
)


def _blank(col: Column) -> Column:
    return strip(F.coalesce(col.cast("string"), F.lit(""))) == ""


def chunk_errors(payload_fields: list[str]) -> Column:
    """Array of error texts for a chunk row with ``text``, ``doc_id`` and ``payload``."""
    field = lambda name: F.col(f"payload.{name}") if name in payload_fields else F.lit(None).cast("string")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", 3)
    line1 = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    line2 = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    doc_type = field("doc_type")
    known_type = F.coalesce(doc_type.isin(*DOC_TYPES), F.lit(False))

    checks: list[Column] = [F.when(_blank(F.col("text")), "empty or missing 'text'")]
    checks += [F.lit(f"payload missing required key '{k}'") for k in PAYLOAD_FIELDS if k not in payload_fields]
    for key in FILTER_FIELDS:
        if key not in payload_fields:
            checks.append(F.lit(f"payload filter key '{key}' is missing"))
            continue
        exempt = F.coalesce(doc_type.isin(*MAY_BE_UNDATED), F.lit(False)) if key == "effective_from" else F.lit(False)
        checks.append(F.when(~exempt & _blank(field(key)), f"payload filter key '{key}' is empty/None"))
    for name, allowed in (("doc_type", DOC_TYPES), ("kind", CHUNK_KINDS), ("trust_grade", TRUST_GRADES)):
        bad = ~F.coalesce(field(name).isin(*allowed), F.lit(False))
        checks.append(F.when(bad, F.concat(F.lit(f"invalid {name} "), F.coalesce(field(name), F.lit("None")))))
    parent, owner = field("parent_id"), F.col("doc_id")
    checks.append(F.when(
        ~_blank(parent) & ~_blank(owner) & (parent != owner),
        F.concat(F.lit("parent_id "), parent, F.lit(" != doc_id "), owner),
    ))
    checks.append(F.when(_blank(line1), "missing L1 인용헤더 (first line empty)"))
    for name in ("title", "jurisdiction", "article_no", "effective_from"):
        types = [t for t, names in HEADER_FIELDS.items() if name in names]
        value = strip(field(name).cast("string"))
        lost = known_type & doc_type.isin(*types) & ~_blank(line1) & ~_blank(value) & ~F.contains(line1, value)
        checks.append(F.when(lost, F.concat(F.lit(f"L1 missing required field '{name}': "), value, F.lit(" not in L1 header"))))
    checks.append(F.when(_blank(line2), "missing L2 맥락헤더 (second line empty)"))
    return F.array_compact(F.array(*checks))


def validate(chunks: DataFrame) -> DataFrame:
    """Add ``errors`` (empty when the chunk is sound)."""
    return chunks.withColumn("errors", chunk_errors(chunks.schema["payload"].dataType.fieldNames()))


def by_type(validated: DataFrame) -> DataFrame:
    """Chunks checked and chunks at fault, per document type."""
    return validated.groupBy(F.coalesce("payload.doc_type", F.lit("?")).alias("doc_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") > 0).alias("n_bad")
    )


def by_error(validated: DataFrame) -> DataFrame:
    """How often each error class occurs; the class is the text before the first colon."""
    return validated.select(F.explode("errors").alias("error")).groupBy(
        F.substring_index("error", ":", 1).alias("error_class")
    ).agg(F.count(F.lit(1)).alias("n"))


def faults(validated: DataFrame) -> DataFrame:
    """All faulty chunks with their errors (the detail page of the report)."""
    return validated.where(F.size("errors") > 0).select("chunk_id", "errors")
