from pyspark.sql import functions as F

from docketry.sources import markdown as M
from docketry.sources import parsers as P


def files(spark, *items):
    return spark.createDataFrame(list(items), "path string, content string")


def head(**kv):
    lines = []
    for k, v in kv.items():
        if isinstance(v, list):
            lines.append(f"{k}:" + (" []" if not v else ""))
            lines += [f"- {x}" for x in v]
        elif isinstance(v, dict):
            lines.append(f"{k}:")
            lines += [f"  {a}: {b}" for a, b in v.items()]
        else:
            lines.append(f"{k}: {v}")
    return "---\n" + "\n".join(lines) + "\n---\n"


STATUTE_HEAD = head(제목="가로수법", 법령MST=2535, 법령ID="'011463'", 법령구분="법률", 소관부처=["산림청", "환경부"],
                    공포일자="2024-01-30", 시행일자="2024-07-03", 출처="https://example.org/a", 첨부파일=[])


def statute(spark, body, head_text=STATUTE_HEAD):
    return P.parse_statutes(files(spark, ("/law/가로수법/법률.md", head_text + body))).first()


def arts(row):
    return [(a.article_no, a.title, a.text, a.chapter_path) for a in row.articles]


def test_statute_headings_chapters_and_sections(spark):
    row = statute(spark, "\n# 가로수법\n\n## 제1장 총칙 <개정 2018.3.27>\n\n##### 제1조 (목적)\n이 법은\n둘째 줄\n\n"
                         "### 제1절 정의\n##### 제2조 ((정의))\n뜻\n##### 제3조의2\n가지\n"
                         "## 제2장 보칙\n##### 제4조\n끝\n##### 제5조 (빈)\n\n")
    assert row.doc_id == "LAW:011463:법률" and row.trust_grade == "A" and row.effective_from == "2024-07-03"
    assert row.authority == "산림청" and row.jurisdiction == "국가" and row.title == "가로수법"
    got = arts(row)
    assert [a[0] for a in got] == ["제1조", "제2조", "제3조의2", "제4조"]
    assert [a[1] for a in got] == ["목적", "정의", None, None]
    assert got[0][3] == "제1장 총칙" and got[1][3] == "제1장 총칙 > 제1절 정의"
    assert got[2][3] == "제1장 총칙 > 제1절 정의"
    # A new chapter ends the section before it.
    assert got[3][3] == "제2장 보칙"
    assert got[0][2].startswith("이 법은\n둘째 줄")


def test_statute_without_headings_keeps_lead_text_before_supplement(spark):
    row = statute(spark, "# 폐지법\n\n이 법은 폐지한다.\n\n## 부칙\n제1조(시행일) 공포한 날부터\n")
    assert arts(row) == [("본문", None, "이 법은 폐지한다.", None)]


def test_statute_inline_articles(spark):
    row = statute(spark, "# 짧은법\n제1조(목적) 이 법은 목적\n제2조(정의)\n뜻은 이렇다\n")
    assert arts(row) == [("제1조", "목적", "이 법은 목적", None), ("제2조", "정의", "뜻은 이렇다", None)]


def test_statute_grade_b_and_rejects(spark):
    assert statute(spark, "# 제목만\n").trust_grade == "B"
    rows = P.parse_statutes(files(
        spark, ("/a/x.md", "no head"), ("/a/y.md", head(제목="이름만") + "본문"), ("/a/z.md", "---\n[1, 2\n---\n본문"),
    ))
    assert M.accepted(rows).count() == 0
    reasons = {r.path: r.reject_reason for r in M.rejected(rows).collect()}
    assert reasons["/a/x.md"] == "no readable head" and reasons["/a/y.md"] == "law id or kind missing"
    assert reasons["/a/z.md"] == "no readable head"


def ordinance(spark, body, **over):
    values = dict(자치법규ID=77, 자치법규명="공원 조례", 자치법규종류="조례", 지자체기관명="여수시",
                  지자체구분={"광역": "전라남도", "기초": "여수시"}, 시행일자="2024-01-04", 출처="https://example.org/o")
    values.update(over)
    values = {k: v for k, v in values.items() if v is not None}
    return P.parse_ordinances(files(spark, ("/o/본문.md", head(**values) + body))).first()


def test_ordinance_notes_numerals_and_level(spark):
    row = ordinance(spark, "##### 제1조 (목적)\n① 첫째 <개정 2020.1.1>  둘째\n")
    assert row.doc_id == "ORD:전라남도:77" and row.gov_level == "기초" and row.locality == "여수시"
    a = row.articles[0]
    # The glyph stays and gains a plain copy; the later header pass replaces the glyph again.
    assert a.text == "①(1) 첫째 둘째" and a.amendments == ["<개정 2020.1.1>"]


def test_ordinance_restated_label_wins_and_phantom_is_dropped(spark):
    row = ordinance(spark, "##### 제0조 (목적)\n제1장 총칙\n\n##### 제1조 (정의)\n제1조(목적) 제1조(목적) 참 본문\n\n"
                           "##### 제2조 (기타)\n제3조의 2(정의) 뜻\n")
    assert [(a.article_no, a.title, a.text) for a in row.articles] == [
        ("제1조", "목적", "참 본문"), ("제3조의2", "정의", "뜻"),
    ]


def test_ordinance_levels_inline_and_rejects(spark):
    assert ordinance(spark, "본문은 첨부파일", 지자체구분={"광역": "서울특별시", "기초": "_본청"}).gov_level == "광역"
    edu = ordinance(spark, "x", 지자체구분={"광역": "서울특별시", "기초": "_교육청"})
    assert edu.gov_level == "교육청" and edu.locality is None and edu.trust_grade == "B"
    inline = ordinance(spark, "제1조(목적) 내용\n제2조(정의) 뜻\n")
    assert [a.text for a in inline.articles] == ["제1조(목적) 내용", "제2조(정의) 뜻"]
    assert ordinance(spark, "x", 자치법규ID=None).reject_reason == "id, name or region missing"


def rule(spark, body, path="/r/부처/고시/본문.md", **over):
    values = dict(행정규칙ID=5, 행정규칙일련번호=100, 행정규칙명="점검 고시", 행정규칙종류="고시", 소관부처명="산림청",
                  발령일자="2023-02-01", 시행일자="2023-03-01", 출처="https://example.org/r")
    values.update(over)
    values = {k: v for k, v in values.items() if v is not None}
    return path, "﻿" + head(**values) + body


def test_rule_articles_chapters_duplicates_and_empty_text(spark):
    row = P.parse_rules(files(spark, rule(
        spark, "제1장 총칙\n제1조(목적) 내용\n제2장\n제2조(생략)\n부칙\n제1조(시행일) 오늘\n제1조 또\n"))).first()
    assert [(a.article_no, a.title, a.chapter_path) for a in row.articles] == [
        ("제1조", "목적", "제1장 총칙"), ("제2조", "생략", "제2장 제2조(생략)"), ("제1조#2", "시행일", "제2장 제2조(생략)"),
        ("제1조#3", None, "제2장 제2조(생략)"),
    ]
    assert row.articles[1].text == "부칙"
    only = P.parse_rules(files(spark, rule(spark, "제5조(생략)"))).first()
    assert only.articles[0].text == "생략"


def test_rule_whole_body_and_label_only(spark):
    assert P.parse_rules(files(spark, rule(spark, "1. 번호 목록\n2. 표"))).first().articles[0].article_no == "전문"
    short = P.parse_rules(files(spark, rule(spark, "없음"))).first()
    assert [(a.article_no, a.text) for a in short.articles] == [("전문", "없음")]  # a short body is a body
    for body in ("", " \n ", '<img id="1"></img>\n<IMG id="2">'):
        row = P.parse_rules(files(spark, rule(spark, body))).first()
        assert row.trust_grade == "B" and row.articles == []


def test_rule_latest_revision_wins(spark):
    parsed = P.parse_rules(files(
        spark, rule(spark, "오래된 판본 본문", "/a/본문.md", 행정규칙일련번호="2,100"),
        rule(spark, "새 판본", "/b/본문.md", 행정규칙일련번호="2,200"),
        rule(spark, "더 긴 본문이 있는 같은 판본", "/c/본문.md", 행정규칙일련번호="2,200"),
        rule(spark, "다른 규칙 본문", "/d/본문.md", 행정규칙ID=6, 행정규칙명=None, 소관부처명=None, 시행일자=None),
    ))
    got = {r.doc_id: r for r in P.canonical_rules(parsed).collect()}
    assert got["ADMRULE:5"].path == "/c/본문.md"
    other = got["ADMRULE:6"]
    assert other.title == "d" and other.jurisdiction == "행정규칙" and other.effective_from == "2023-02-01"


def case(spark, body, path="/p/대법원_2020-05-01_2019다1.md", **over):
    values = dict(판례일련번호=42, 사건번호="2019다1", 사건명="손해배상", 법원명="대법원", 사건종류="민사", 선고일자="2020-05-07")
    values.update(over)
    values = {k: v for k, v in values.items() if v is not None}
    return path, head(**values) + body


def test_case_sections_masks_and_dates(spark):
    rows = P.parse_cases(files(
        spark,
        case(spark, "# 손해배상\n머리말\n## 판시사항\n원고 ○○○ 과  피고 △△\n## 빈 절\n\n## 판결요지\n요지\n"),
        case(spark, "본문 없음", 판례일련번호=43, 선고일자="''"),
        case(spark, "## 가\n나", "/p/대법원_0000-00-00_x.md", 판례일련번호=44, 선고일자="0000-00-00", 사건명=None, 법원명=None),
        ("/p/README.md", head(판례일련번호=9) + "## 가\n나"),
        ("/p/bad.md", "머리 없음"),
    ))
    got = {r.doc_id: r for r in M.accepted(rows).collect()}
    assert set(got) == {"PREC:42", "PREC:43", "PREC:44"}
    first = got["PREC:42"]
    assert [(a.article_no, a.text) for a in first.articles] == [("판시사항", "원고 [당사자] 과 피고 [당사자]"), ("판결요지", "요지")]
    assert first.effective_from == "2020-05-07" and first.case_no == "2019다1"
    assert got["PREC:43"].effective_from == "2020-05-01" and got["PREC:43"].trust_grade == "B"
    bare = got["PREC:44"]
    assert bare.effective_from is None and bare.title == "2019다1" and bare.jurisdiction == "법원미상"


def test_files_are_read_whole_with_plain_paths(spark, tmp_path):
    folder = tmp_path / "가로수법"
    folder.mkdir()
    (folder / "법률.md").write_text(STATUTE_HEAD.replace("\n", "\r\n") + "##### 제1조 (목적)\r\n본문\r\n", encoding="utf-8")
    row = P.parse_statutes(M.read_files(spark, str(tmp_path))).first()
    assert row.path.endswith("/가로수법/법률.md") and row.articles[0].text == "본문"


def test_sections_are_spans_without_offsets(spark):
    bodies = ["", "no heading", "## 주문\n기각\n## 이유\n\n## 끝", "머리\n##  【이 유】  \n가\r\n## \u3000나\u3000\n다", "## 가", None]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    shown = rows.select(
        M.sections(F.col("body"), P.CASE_SECTION).alias("got"), M.spans(F.col("body"), P.CASE_SECTION + "()").alias("spans"),
    ).collect()
    assert [[(s.label, s.text) for s in r.got or []] for r in shown] == [[(s.label, s.text) for s in r.spans or []] for r in shown]
    assert [len(r.got or []) for r in shown] == [0, 0, 3, 2, 1, 0]
