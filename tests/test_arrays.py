"""Array helpers against plain loops, and long documents in the parsers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docketry.functions.arrays import last_at_or_before, occurrences, running
from docketry.sources import markdown as M
from docketry.sources import parsers as P


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 9, 100])
def test_running_values_ranks_and_lookups(spark, size):
    rng = random.Random(size)
    numbers = [rng.randint(-9, 9) for _ in range(size)]
    words = [rng.choice(["a", "b", "", "가", None]) for _ in range(size)]
    starts = sorted(rng.sample(range(300), size))
    row = spark.createDataFrame([(numbers, words, [(s,) for s in starts])], "n array<int>, w array<string>, m array<struct<start:int>>").select(
        running(F.col("n"), lambda x, y: x + y).alias("total"), running(F.col("n"), F.greatest).alias("top"), occurrences(F.col("w")).alias("nth"),
        F.transform(F.sequence(F.lit(0), F.lit(300)), lambda p: last_at_or_before(F.col("m"), p)["start"]).alias("found"),
    ).first()
    assert row.total == [sum(numbers[:i + 1]) for i in range(size)]
    assert row.top == [max(numbers[:i + 1]) for i in range(size)]
    assert row.nth == [words[:i + 1].count(words[i]) for i in range(size)]
    assert row.found == [max([s for s in starts if s <= p], default=None) for p in range(301)]


def test_a_statute_and_a_rule_of_ten_thousand_headings(spark):
    n = 10_000
    law = "".join(f"## 제{i // 10 + 1}장 장\n" * (i % 10 == 0) + f"##### 제{i + 1}조 (제목)\n글 {i}\n" for i in range(n))
    rule = "".join(f"제{i // 10 + 1}장 장\n" * (i % 10 == 0) + f"제{i % 50 + 1}조(제목) 글 {i}\n" for i in range(n))
    files = lambda head, body: spark.createDataFrame([("/x/y", f"---\n{head}\n---\n{body}")], "path string, content string")
    began = time.time()
    a = M.accepted(P.parse_statutes(files("법령ID: 1\n법령구분: 법률", law))).first().articles
    b = M.accepted(P.parse_rules(files("행정규칙ID: 1\n행정규칙명: 고시", rule))).first().articles
    assert time.time() - began < 20  # start-up of Python workers included
    assert [x.article_no for x in a] == [f"제{i + 1}조" for i in range(n)]
    assert [x.chapter_path for x in a] == [f"제{i // 10 + 1}장 장" for i in range(n)]
    assert [x.article_no for x in b] == [f"제{i % 50 + 1}조" + f"#{i // 50 + 1}" * (i >= 50) for i in range(n)]
    assert [x.chapter_path for x in b] == [f"제{i // 10 + 1}장 장" for i in range(n)]
