"""Identifiers. Every id is a pure function of the record, so re-runs agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import drop_whitespace, nfc, strip
from docketry.settings import DOC_PREFIX, POINT_NAMESPACE


def doc_id(doc_type: str, *parts: Column) -> Column:
    """``PREFIX:part:part``; null when any part is missing or blank."""
    if doc_type not in DOC_PREFIX:
        raise ValueError(f"unknown doc_type {doc_type!r}")
    if not parts:
        raise ValueError("a doc_id needs at least one part")
    cleaned = [strip(p.cast("string")) for p in parts]
    complete = cleaned[0] != ""
    for part in cleaned[1:]:
        complete = complete & (part != "")
    return F.when(complete, F.concat_ws(":", F.lit(DOC_PREFIX[doc_type]), *cleaned))


def chunk_id(doc: Column, article_no: Column, part: Column) -> Column:
    return F.concat_ws("#", strip(doc), strip(article_no), part.cast("string"))


def parent_of_chunk(chunk: Column) -> Column:
    """Everything before the first ``#``."""
    return F.substring_index(chunk, "#", 1)


def owner_of_hit(doc: Column, parent: Column, chunk: Column, fallback: Column) -> Column:
    """First usable id of a hit: doc, parent, chunk prefix, hit id."""
    text = lambda col: F.nullif(col.cast("string"), F.lit(""))
    return F.coalesce(text(doc), text(parent), parent_of_chunk(text(chunk)), fallback.cast("string"), F.lit(""))


def point_id(chunk: Column) -> Column:
    """Name-based UUID (version 5) of a chunk id, computed from its SHA-1."""
    space = F.unhex(F.lit(POINT_NAMESPACE.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(chunk, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


# --- article labels ---------------------------------------------------------

_LABEL = r"(?U)제?\s*(\d+)\s*조(?:\s*의\s*(\d+))?"
_BARE = r"(?U)^\s*(\d+)\s*(?:의\s*(\d+))?\s*$"


def article_key(label: Column) -> Column:
    """Comparable article number: ``제 4 조의 2`` → ``4의2``, ``17`` → ``17``."""

    def pick(pattern: str) -> Column:
        base = F.regexp_extract(label, pattern, 1)
        branch = F.regexp_extract(label, pattern, 2)
        return F.when(branch != "", F.concat(base, F.lit("의"), branch)).otherwise(base)

    return F.when(label.rlike(_LABEL), pick(_LABEL)).when(label.rlike(_BARE), pick(_BARE))


def registry_article(key: Column) -> Column:
    """Six-digit registry form of an article key: ``4의2`` → ``000402``.

    Widths are minimums: longer numbers keep all their digits.
    """
    def widen(digits: Column, width: int) -> Column:
        bare = F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0"))
        return F.when(F.length(bare) >= width, bare).otherwise(F.lpad(bare, width, "0"))

    base = F.split(key, "의", 2)[0]
    branch = F.coalesce(F.get(F.split(key, "의", 2), F.lit(1)), F.lit("0"))
    return F.when(
        F.coalesce(key, F.lit("")) != "", F.concat(widen(base, 4), widen(branch, 2))
    )


def stored_article(label: Column) -> Column:
    """``4``, ``4조`` or ``제4조`` → ``제4조``; blank stays blank."""
    value = strip(F.coalesce(label, F.lit("")))
    core = F.when(value.endswith("조"), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    return F.when((value == "") | value.startswith("제"), value).otherwise(
        F.concat(F.lit("제"), core, F.lit("조"))
    )


def mentions_article(text: Column, key: Column) -> Column:
    """Whether ``text`` holds the article, without ``제3조`` matching ``제3조의2``."""
    base = F.concat(F.lit("제"), key, F.lit("조"))
    branch = F.concat(
        F.lit("제"), F.split(key, "의", 2)[0], F.lit("조의"), F.get(F.split(key, "의", 2), F.lit(1))
    )
    # Strike every branch form out, then look for the plain label in what is left.
    plain = F.contains(F.regexp_replace(text, r"(?U)조의(?=\d)", "\x00"), base)
    return F.when(key.contains("의"), F.contains(text, branch)).otherwise(plain)


def attachment_label(kind: Column, number: Column, branch: Column) -> Column:
    """``{kind}{number}`` plus ``-{branch}`` unless the branch is empty or ``00``."""
    tail = F.when((branch != "") & (branch != "00"), F.concat(F.lit("-"), branch)).otherwise(F.lit(""))
    return F.concat(kind, number, tail)


def case_key(case_no: Column) -> Column:
    """Case number with composition fixed and all whitespace gone."""
    return drop_whitespace(nfc(F.coalesce(case_no, F.lit(""))))
