"""Metadata and point-in-time filters as one pushed-down predicate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.dates import in_force_strict, require_iso
from docketry.functions.text import drop_whitespace, nfc
from docketry.settings import FILTER_KEYS


def metadata_filter(
    wanted: Mapping[str, Any] | None, as_of: str | None = None
) -> Column | None:
    """AND of per-column membership tests and the strict date rule.

    A scalar means equality, a list, tuple or set means any-of. Values compare as
    text and null never matches. Bad input fails here, before any job starts.
    """
    tests: list[Column] = []
    for key, value in (wanted or {}).items():
        if key not in FILTER_KEYS:
            raise ValueError(f"cannot filter on {key!r}; allowed: {sorted(FILTER_KEYS)}")
        if value is None:
            raise ValueError(f"filter value for {key!r} must not be None")
        if isinstance(value, (list, tuple, set)):
            members = sorted({str(v) for v in value if v is not None and str(v) != ""})
            if not members:
                raise ValueError(f"filter list for {key!r} is empty")
        else:
            if str(value) == "":
                raise ValueError(f"filter value for {key!r} must not be empty")
            members = [str(value)]
        tests.append(F.col(key).cast("string").isin(members))
    if as_of is not None:
        tests.append(in_force_strict(F.col("effective_from"), require_iso(as_of)))
    if not tests:
        return None
    return reduce(lambda a, b: a & b, tests)


def drop_metadata_only(df: DataFrame, grade: str = "trust_grade") -> DataFrame:
    """Full-index rule: grade B goes, an unknown grade stays."""
    return df.where(~F.col(grade).eqNullSafe("B"))


def keep_full_text(df: DataFrame, grade: str = "trust_grade") -> DataFrame:
    """Sub-corpus rule: only grade A stays, an unknown grade goes."""
    return df.where(F.col(grade) == "A")


def drop_corpus(df: DataFrame, prefix: str = "ORD:", key: str = "doc_id") -> DataFrame:
    return df.where(~F.coalesce(F.col(key), F.lit("")).startswith(prefix))


def first_keyword(title: Column, keywords: Iterable[str]) -> Column:
    """First keyword (in list order) contained in ``title``, else null."""
    return F.coalesce(*[F.when(F.contains(title, F.lit(k)), F.lit(k)) for k in keywords if k], F.lit(None).cast("string"))


def keyword_decision(title: Column, include: Iterable[str], deny: Iterable[str]) -> Column:
    """Struct of the include keyword that matched, the deny keyword, and the verdict."""
    hit, denied = first_keyword(title, include), first_keyword(title, deny)
    return F.struct(
        hit.alias("matched"),
        denied.alias("denied"),
        (hit.isNotNull() & denied.isNull()).alias("keep"),
    )


def laws_cited(reference: Column, names: Iterable[str], aliases: Mapping[str, str] | None = None) -> Column:
    """Sorted canonical names of the listed laws that ``reference`` cites.

    Whitespace is ignored. A name directly after another Hangul syllable does not
    count, except after ``구`` (the marker for a superseded version).
    """
    canonical = {n.strip(): n.strip() for n in names if n.strip()}
    canonical.update({a.strip(): c.strip() for a, c in (aliases or {}).items() if a.strip() and c.strip()})
    text = drop_whitespace(nfc(F.coalesce(reference, F.lit(""))))
    found = [
        F.when(text.rlike(r"(?:(?<=구)|(?<![가-힣]))\Q" + term + r"\E"), F.lit(name))
        for term, name in canonical.items()
    ]
    if not found:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


# Endings of a statute name.
LAW_NAME_ENDINGS = ("법", "법률", "령", "규칙")
_ARTICLE = r"(?U)제\s?\d+\s?조"


def looks_like_citation(query: Column) -> Column:
    """An article number anywhere, or a word that ends like a statute name."""
    tokens = F.transform(F.split(query, r"(?U)\s+"), lambda t: F.regexp_replace(t, "[^0-9A-Za-z가-힣]", ""))
    endings = "(?:" + "|".join(LAW_NAME_ENDINGS) + ")$"
    named = F.exists(tokens, lambda t: (F.length(t) >= 2) & t.rlike(endings))
    return F.coalesce(query.rlike(_ARTICLE) | named, F.lit(False))
