import hashlib
import time
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from docketry.functions import dates, ids
from docketry.functions import text as T
from docketry.functions.vectors import dot, norm, unit
from docketry.operators.filters import keyword_decision, laws_cited, looks_like_citation, metadata_filter
from docketry.operators.lexical import prefix_terms
from docketry.operators.verification import public_url
from docketry.plans.search import expand
from docketry.sources.parsers import bare_title

A = F.col("a")


def test_clean_body_follows_its_order(one):
    raw = "① 가 <개정 2016. 1. 22.>\t 나\r\n\n\n\n　○○○ 다 ㅇㅇ  \n＜신설 2020＞ ⑳ 라"
    assert one(T.clean_body(A), a=raw) == "(1) 가 나\n\n[당사자] 다 [당사자]\n(20) 라"
    assert one(T.clean_body(A), a=None) == ""


def test_clean_body_knows_every_space(spark):
    blanks = [f"a{c}\n{c}b" for c in "\t\xa0\x1f\u1680\u2000\u2003\u200a\u202f\u205f\u3000"]
    breaks = [f"a{c}b" for c in ("\x0b", "\x0c", "\r", "\r\n", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")]
    rows = spark.createDataFrame([(v,) for v in blanks + breaks], "a string").select("a", T.clean_body(A).alias("b"))
    assert [r.a for r in rows.collect() if r.b != "a\nb"] == []


def test_plain_text_is_passed_over_quickly(spark):
    """Telling that NFC changes nothing takes about as long as one search for an absent letter."""
    long = spark.range(0, 16, 1, 4).select(F.repeat(F.lit("wort das und die nicht, ○ "), 40_000).alias("a")).cache()
    long.count()

    def seconds(test):
        def once():
            began = time.perf_counter()
            assert long.where(test).count() == 0
            return time.perf_counter() - began

        return min(once() for _ in range(3))

    assert seconds(T._may_change(A)) < 2 * seconds(A.rlike("[\u0416]"))


def test_composition(one):
    for value in ("été", "한", "豈", "Å", "plain", "한글"):
        assert one(T.nfc(A), a=value) == unicodedata.normalize("NFC", value)


def test_double_numerals_trap(one):
    """Ordinance text is annotated by the parser and plain-numbered by the chunker."""
    assert one(T.clean_body(T.clean_ordinance(A)), a="① 내용") == "(1)(1) 내용"


def test_parser_and_chunker_masks_differ(one):
    assert one(T.clean_case(A), a="△△ ㅇㅇ ××") == "[당사자] ㅇㅇ ××"
    assert one(T.clean_body(A), a="△△ ㅇㅇ ××") == "△△ [당사자] ××"


def test_amendments_in_order(one):
    assert one(T.amendments_in(A), a="<개정 2016> 가 <별표> ＜ 신설 2020＞") == ["<개정 2016>", "＜ 신설 2020＞"]


def test_content_hash_ignores_padding_and_composition(one):
    want = hashlib.sha256("été".encode()).hexdigest()
    assert one(T.content_hash(A), a=" \nété　") == want


def test_ids(one):
    assert one(ids.doc_id("law", A, F.lit(" 법률 ")), a=" 014565") == "LAW:014565:법률"
    assert one(ids.doc_id("admrule", A), a="  ") is None
    assert one(ids.parent_of_chunk(A), a="ADMRULE:5#제1조#2#0") == "ADMRULE:5"
    space = uuid.UUID("6c61776b-6f74-5151-6472-616e74707473")
    for name in ("LAW:014565:법률#제4조#0", "x"):
        assert one(ids.point_id(A), a=name) == str(uuid.uuid5(space, name))
    with pytest.raises(ValueError):
        ids.doc_id("novel", A)
    with pytest.raises(ValueError):
        ids.doc_id("law")


@pytest.mark.parametrize("label, key, registry", [
    ("제17조", "17", "001700"), ("제 4 조 의 2", "4의2", "000402"), ("17", "17", "001700"), (" 17의 2 ", "17의2", "001702"),
    ("제12345조", "12345", "1234500"), ("부칙", None, None), ("", None, None), ("3조제2항", "3", "000300"),
])
def test_article_labels(one, label, key, registry):
    assert one(ids.article_key(A), a=label) == key
    assert one(ids.registry_article(ids.article_key(A)), a=label) == registry


def test_article_mentions_respect_branches(one):
    test = lambda key: ids.mentions_article(A, F.lit(key))
    assert one(test("3"), a="제3조의2 만 있다") is False
    assert one(test("3"), a="제3조의2 와 제3조") is True
    assert one(test("3"), a="제3조의 내용") is True
    assert one(test("3의2"), a="제3조의2") is True
    assert one(test("3의2"), a="제3의2조") is False


def test_stored_article_and_attachment_labels(one):
    assert [one(ids.stored_article(A), a=v) for v in ("4", "4조", "제4조", " ")] == ["제4조", "제4조", "제4조", ""]
    label = lambda branch: ids.attachment_label(F.lit("별표"), F.lit("1"), F.lit(branch))
    assert one(label(""), a="") == "별표1" and one(label("00"), a="") == "별표1" and one(label("02"), a="") == "별표1-02"


def test_four_date_rules_differ_on_undated_rows(one):
    day = "2024-01-01"
    rules = {
        "strict": dates.in_force_strict(A, day), "lenient": dates.in_force_lenient(A, day),
        "listed": dates.in_force_listed(A, day), "known": dates.in_force_if_known(A, F.lit(day)),
    }
    table = {
        None: (False, True, False, True), "": (False, True, False, True), "2023-12-31": (True, True, True, True),
        "2024-01-02": (False, False, False, False), "20231231": (False, True, True, True), "2023-12-31T09": (False, True, True, None),
    }
    for value, want in table.items():
        got = [one(rule, a=value) for rule in rules.values()]
        for g, w in zip(got, want):
            assert w is None or g == w, (value, got, want)


def test_date_checks():
    assert dates.require_iso(" 2024-01-01 ") == "2024-01-01"
    for bad in ("2024-1-1", "", "2024-01-01T00"):
        with pytest.raises(ValueError):
            dates.require_iso(bad)
    assert dates.optional_calendar_date("2024-02-29T10:00") == "2024-02-29" and dates.optional_calendar_date(" ") is None
    with pytest.raises(ValueError):
        dates.optional_calendar_date("2023-02-29")


def test_registry_dates_and_status(one):
    assert one(dates.registry_date(A), a="2024.07.03") == "2024-07-03" and one(dates.registry_date(A), a="2024") == "2024"
    assert one(dates.registry_date(A), a="  ") is None
    assert [one(dates.force_status(A, "2024-01-01"), a=v) for v in (None, "2024-01-02", "2024-01-01")] == ["미상", "시행예정", "현행"]


def test_filter_rejects_bad_input(spark):
    for bad in ({"title": "x"}, {"doc_type": None}, {"doc_type": ""}, {"doc_type": []}, {"doc_type": [None, ""]}):
        with pytest.raises(ValueError):
            metadata_filter(bad)
    with pytest.raises(ValueError):
        metadata_filter({}, "2024")
    assert metadata_filter(None) is None and metadata_filter({}) is None


def test_titles_queries_and_links(one):
    assert [one(bare_title(A), a=v) for v in ("((목적))", "（정의）", "(가) 나", "( )", None, "((")] == ["목적", "정의", "(가) 나", None, None, "(("]
    assert one(prefix_terms(A), a="민법 제4조의 내용? 알려줘 a 사기!!") == ["민법", "제4조의", "사기"]
    assert one(expand(A), a="월급 못 받아 집주인 월급") == "월급 못 받아 집주인 월급 임금 임대인"
    assert one(expand(A), a="임금과 월급") == "임금과 월급"
    cites = {"민법 제4조": True, "제 4 조": True, "도로교통법 속도": True, "방법 알려줘": True, "보증금": False, "법": False}
    for value, want in cites.items():
        assert one(looks_like_citation(A), a=value) is want
    assert one(public_url(A), a="/x?a=1&OC=k&b=2") == "https://www.law.go.kr/x?a=1&b=2"
    assert one(public_url(A), a="") is None


def test_law_names_stop_at_word_starts(one):
    rule = laws_cited(A, ["의료법", "약사법"], {"舊약사법": "약사법"})
    assert one(rule, a="국민의료법") == []
    assert one(rule, a="구 의 료\n법, 의료법 시행령") == ["의료법"]
    assert one(rule, a="舊약사법, 의료법") == ["약사법", "의료법"]


def test_deny_wins_over_include(one):
    choice = keyword_decision(A, ["의료", "약"], ["수의"])
    assert one(choice, a="수의 의료 고시").asDict() == {"matched": "의료", "denied": "수의", "keep": False}
    assert one(choice, a="약품 고시").keep is True and one(choice, a="도로").matched is None


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>").select(
        unit(F.col("v")).alias("u"), unit(F.col("z")).alias("z"), norm(F.col("v")).alias("n"), dot(F.col("v"), F.col("v")).alias("d")
    ).first()
    assert row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0] and row.n == 5.0 and row.d == 25.0
