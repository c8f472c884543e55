"""Text clean-up as column expressions.

Everything runs in the JVM except Unicode composition (NFC), for which Spark has
no built-in. The Arrow function behind :func:`nfc` only receives the values that
can change under NFC; the rest are passed as nulls.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docketry.functions.binding import let

# Characters counted as whitespace when trimming.
WHITESPACE = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WS_NO_SPACE = _WS.replace(r"\x1c-\x20", r"\x1c-\x1f")
_LINE_WS = r"[\t\x20\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_LINE_BREAKS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Line breaks but "\n", and spaces but blank, tab and U+00A0.
_ODD_SPACES = r"[\x0b\x0c\r\x1c-\x1f\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The patterns of the two clean-up passes. The parser pass and the
# embedding pass use different mask glyphs and different note keywords.
AMENDMENT_NOTE = r"[<＜]\s*(?:개정|신설|전문개정|본조신설|본항신설|단서신설|제목개정)[^>＞]*[>＞]"
ORDINANCE_NOTE = r"<(?:개정|신설|전문개정|본조신설|본조개정)[^>]*>"
PARTY_MASK = r"[○ㅇ]{2,}"
# One range that holds every mask glyph is tried first: five classes at each character take three times as long.
CASE_MASK = r"(?=[\x{d7}\x{2299}-\x{2715}])(?:[○◯⊙]{2,}|[△▲]{2,}|[□■]{3,}|[☆★]{2,}|[×✕]{3,})"
PARTY_TOKEN = "[당사자]"
CIRCLED = [chr(0x2460 + i) for i in range(20)]


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    trimmed = strip(col)
    return F.when(trimmed != "", trimmed)


def squeeze(col: Column) -> Column:
    """Whitespace runs become one space; ends trimmed."""
    uneven = f"{_WS}{{2,}}|{_WS_NO_SPACE}"
    return strip(_step(col, lambda x: x.rlike(uneven), lambda x: F.regexp_replace(x, _WS + "+", " ")))


def drop_whitespace(col: Column) -> Column:
    return F.regexp_replace(col, _WS + "+", "")


def unix_lines(col: Column) -> Column:
    """Carriage returns become line feeds, as a text-mode read would do."""
    return F.regexp_replace(col, "\r\n?", "\n")


@lru_cache(maxsize=1)
def _composition_sensitive() -> str:
    """Character class of every code point NFC may change or attach to a neighbour."""
    changed = [
        cp
        for cp in range(0x80, 0x110000)
        if not 0xAC00 <= cp <= 0xD7A3
        and not 0xD800 <= cp <= 0xDFFF
        and unicodedata.normalize("NFC", chr(cp)) != chr(cp)
    ]
    ranges: list[list[int]] = []
    for cp in changed:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    body = "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)
    return f"[\\p{{M}}\\x{{1100}}-\\x{{11ff}}{body}]"


# Ranges whose members NFC never changes and never joins to a neighbour: Latin
# letters, common punctuation and symbols, Hangul and Han. A text made of these alone
# needs no closer look. Of a nested class the ranges before the inner one are tried first.
_PLAIN = (
    r"[\x{0}-\x{2ff}\x{ac00}-\x{d7a3}[\x{2010}-\x{2027}\x{2030}-\x{205e}\x{2460}-\x{24ff}\x{2500}-\x{27ff}"
    r"\x{3000}-\x{3029}\x{3131}-\x{318e}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}]]"
)


def _may_change(col: Column) -> Column:
    # A run of one positive class takes a few nanoseconds a character, a search for a negated
    # class or for the hundreds of ranges about a microsecond: only what is not plain meets those.
    rest = F.regexp_replace(col, f"{_PLAIN}++", "")
    return ~col.rlike(rf"\A{_PLAIN}*+\z") & rest.rlike(_composition_sensitive())


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(ArrayType(StringType()))
def _compose_each(values: pd.Series) -> pd.Series:
    return values.map(
        lambda vs: None if vs is None else [None if v is None else unicodedata.normalize("NFC", v) for v in vs]
    )


def nfc(col: Column) -> Column:
    """Unicode NFC."""
    return F.coalesce(_compose(F.when(_may_change(col), col)), col)


def nfc_each(col: Column) -> Column:
    """NFC of every string of an array (usable where a lambda could not call Python)."""
    return F.coalesce(_compose_each(F.when(F.exists(col, _may_change), col)), col)


def _holds(col: Column, *parts: str) -> Column:
    """Whether any of the literal ``parts`` occurs: a byte search, far cheaper than a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(p)) for p in parts])


def _step(col: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` only to values that need it."""
    return let(lambda x: F.when(needed(x), change(x)).otherwise(x), x=col)


def _each_numeral(col: Column, form: Callable[[int, str], str]) -> Column:
    def change(x: Column, first: int, last: int) -> Column:
        for n in range(first, last + 1):
            x = F.replace(x, F.lit(CIRCLED[n - 1]), F.lit(form(n, CIRCLED[n - 1])))
        return x

    # Few texts count beyond five: one look spares them fifteen passes.
    for first, last in ((1, 5), (6, 20)):
        glyphs = f"[{CIRCLED[first - 1]}-{CIRCLED[last - 1]}]"
        col = _step(col, lambda x, glyphs=glyphs: x.rlike(glyphs), lambda x, first=first, last=last: change(x, first, last))
    return col


def plain_numerals(col: Column) -> Column:
    """Circled numerals become ``(n)``."""
    return _each_numeral(col, lambda n, glyph: f"({n})")


def annotate_numerals(col: Column) -> Column:
    """Circled numerals keep their glyph and gain a plain copy: ``①`` → ``①(1) ``."""
    return _each_numeral(col, lambda n, glyph: f"{glyph}({n}) ")


def amendments_in(col: Column) -> Column:
    """Amendment notes in order of appearance."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(col, F.lit("(?U)" + AMENDMENT_NOTE), F.lit(0))
    return F.when(_holds(col, "<", "＜"), found).otherwise(none)


def _no_triple_breaks(col: Column) -> Column:
    return _step(col, lambda x: _holds(x, "\n\n\n"), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_body(col: Column) -> Column:
    """Body text as it is embedded: composed, notes and masks removed, spacing tidied."""
    return let(lambda x: let(lambda odd: _tidied(x, odd), odd=x.rlike(_ODD_SPACES)), x=nfc(F.coalesce(col, F.lit(""))))


def _tidied(text: Column, odd: Column) -> Column:
    """``text`` without notes, masks and loose spacing; ``odd`` says whether it has any of ``_ODD_SPACES`` (no step adds one)."""
    out = plain_numerals(text)
    out = _step(out, lambda x: _holds(x, "<", "＜"), lambda x: F.regexp_replace(x, "(?U)" + AMENDMENT_NOTE, ""))
    out = _step(out, lambda x: _holds(x, "○", "ㅇ"), lambda x: F.regexp_replace(x, PARTY_MASK, PARTY_TOKEN))
    out = _step(out, lambda x: odd, lambda x: F.regexp_replace(x, _LINE_BREAKS, "\n"))
    out = _step(out, lambda x: _holds(x, "  ", "\t", "\xa0"), lambda x: F.regexp_replace(x, r"[ \t\x{a0}]+", " "))
    out = _step(
        out, lambda x: odd | _holds(x, " \n", "\n "), lambda x: F.regexp_replace(x, rf"(?md)^{_LINE_WS}+|{_LINE_WS}+$", "")
    )
    return strip(_no_triple_breaks(out))


def clean_ordinance(col: Column) -> Column:
    """Parser-side clean-up of an (already composed) ordinance article."""
    out = _step(col, lambda x: _holds(x, "<"), lambda x: F.regexp_replace(x, ORDINANCE_NOTE, ""))
    out = annotate_numerals(out)
    out = _step(out, lambda x: _holds(x, "  ", "\t"), lambda x: F.regexp_replace(x, r"[ \t]+", " "))
    return strip(_no_triple_breaks(F.replace(out, F.lit(" \n"), F.lit("\n"))))


def clean_case(col: Column) -> Column:
    """Parser-side clean-up of an (already composed) court section."""
    out = F.regexp_replace(col, CASE_MASK, PARTY_TOKEN)
    return strip(F.regexp_replace(out, r"[ \t]{2,}", " "))


def shorten(col: Column, limit: int, marker: str) -> Column:
    """Display form of a long text: the first ``limit`` characters and a marker."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit(marker))).otherwise(col)


def content_hash(col: Column) -> Column:
    """SHA-256 of the composed, trimmed text: the key of the embedding cache."""
    return F.sha2(strip(nfc(F.coalesce(col, F.lit("")))), 256)


TOKEN = r"\S+"


def count_tokens(col: Column) -> Column:
    """Number of runs without ASCII whitespace, the default size measure of a chunk."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(TOKEN))


def words(col: Column) -> Column:
    """Lower-cased letter/digit runs with diacritics folded, in order."""
    folded = F.translate(F.lower(col), _FOLD_FROM, _FOLD_TO)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def _latin_folds() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics, and their base letters."""
    pairs = []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch == ch.lower() and base != ch and base.isascii():
            pairs.append((ch, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLD_FROM, _FOLD_TO = _latin_folds()
