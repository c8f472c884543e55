"""A stored word index against the index that a search builds for itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import posting_store
from docketry.operators.lexical import bm25_top, build_index
from docketry.plans.search import Corpus, indexed, search
from docketry.settings import Settings


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    word = lambda: "w" + "abcdefgh"[int(rng.zipf(1.6)) % 8] + str(int(rng.zipf(1.4)) % 90)
    data = [(f"k{i:03}", " ".join(word() for _ in range(3)) if i % 4 else None, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(400)]
    data += [("k400", None, None), ("k401", "", " \t"), ("k402", "법률 제1조", "민법과 상법, 그리고 형법")]
    data += [("rare", "zebra zebra", "zebra wa1")]
    return spark.createDataFrame(data, "k string, title string, text string").repartition(3, "k")


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["wa1 wb2 wb2", "zebra", "wc", "민법 형법", "nothing here", "", "wa wb wc wd we wf wg wh", "zebra wa"]
    return spark.createDataFrame(list(enumerate(asked)), "q long, ask string")


def listed(df):
    return sorted(map(tuple, df.collect()))


def built(rows, queries, n):
    return listed(bm25_top(build_index(rows, "k", "title", "text"), queries, "q", "ask", n))


def test_a_stored_index_gives_the_same_rows(spark, rows, queries, tmp_path):
    store = posting_store.create(rows, str(tmp_path / "ix"), "k", "title", "text")
    for n in (1, 7, 1000):
        assert listed(posting_store.top(store, queries, "q", "ask", n)) == built(rows, queries, n)


def test_appended_segments_count_as_one_index(spark, rows, queries, tmp_path):
    path = str(tmp_path / "ix")
    first, rest = rows.where("k < 'k2'"), rows.where("not (k < 'k2')")
    base = posting_store.create(first, path, "k", "title", "text")
    later = posting_store.append(base, rest, "title", "text")
    assert posting_store.open_store(spark, path) == later and posting_store.open_store(spark, path, 0) == base
    assert listed(posting_store.top(later, queries, "q", "ask", 9)) == built(rows, queries, 9)
    assert listed(posting_store.top(base, queries, "q", "ask", 9)) == built(first, queries, 9)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        posting_store.append(base, rest, "title", "text")  # another writer took the version
    with pytest.raises(FileNotFoundError):
        posting_store.open_store(spark, path, 5)


def test_restricted_rows_count_as_if_only_they_were_indexed(spark, rows, queries, tmp_path):
    store = posting_store.create(rows, str(tmp_path / "ix"), "k", "title", "text")
    some = rows.where("k like '%3'")
    assert listed(posting_store.top(store, queries, "q", "ask", 9, among=some.select("k"))) == built(some, queries, 9)


def test_blocks_are_left_out_by_their_bound(spark, tmp_path):
    """Short rows with the word often fill the first places; long rows with it once cannot."""
    data = [(i, None, "alpha alpha alpha" if i < 20 else "alpha " + "other " * 200) for i in range(3000)]
    rows = spark.createDataFrame(data, "k long, title string, text string").coalesce(1)
    asked = spark.createDataFrame([(0, "alpha")], "q long, ask string")
    store = posting_store.create(rows, str(tmp_path / "ix"), "k", "title", "text")
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    assert listed(posting_store.top(store, asked, "q", "ask", 5, seen=seen)) == built(rows, asked, 5)
    assert seen[0].value == 12 and seen[1].value >= 10


def test_terms_beyond_the_bound_are_searched_in_pieces(spark, rows, queries, tmp_path):
    store = posting_store.create(rows, str(tmp_path / "ix"), "k", "title", "text")
    assert listed(posting_store.top(store, queries, "q", "ask", 9, limit=150)) == built(rows, queries, 9)


def test_an_empty_index_and_no_terms(spark, rows, queries, tmp_path):
    store = posting_store.create(rows.limit(0), str(tmp_path / "none"), "k", "title", "text")
    assert listed(posting_store.top(store, queries, "q", "ask", 3)) == []
    full = posting_store.create(rows, str(tmp_path / "full"), "k", "title", "text")
    assert listed(posting_store.top(full, queries.where("ask = ''"), "q", "ask", 3)) == []


def test_search_opens_the_index_and_expands_everyday_words(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", [1.0, 0.0], "law", "임금법", "임금 지급"), ("b", [0.0, 1.0], "law", "다른법", "해고")], "chunk_id string, vector array<double>, doc_type string, heading string, text string",
    )
    corpus = indexed(Corpus(rows), str(tmp_path / "ix"))
    assert indexed(Corpus(rows), str(tmp_path / "ix")).index == corpus.index
    asked = spark.createDataFrame([(1, "월급법", [0.0, 1.0])], "query_id int, text string, vector array<double>")
    plain = search(corpus, asked, 1, hybrid=True).select("chunk_id").collect()
    wide = search(corpus, asked, 1, hybrid=True, settings=Settings(expand_queries=True)).select("chunk_id").collect()
    assert (plain[0][0], wide[0][0]) == ("b", "a")
