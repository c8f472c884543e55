"""Documents embedded as a stream: folders of any layout, blank texts, runs that follow each other."""

import os

import duckdb
import numpy as np

import __spark_entry__ as contract
from docketry.operators.embedding import hashing_embedder
from docketry.streaming import jobs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_table_in_folders_with_blank_texts_is_embedded_whole(spark, tmp_path):
    texts = ["one text", "", "   ", "one text", " one text ", "another\n\ntext"] * 4
    rows = [(k, text, "en", "src", len(text)) for k, text in enumerate(texts)]
    for copy in range(2):
        spark.createDataFrame([(k + 100 * copy, f"{t}{copy}" if t.strip() else t, *rest) for k, t, *rest in rows], DOCS) \
            .write.parquet(f"{tmp_path}/documents.parquet/copy={copy}")
    name = "incremental_embed_stream"
    got = sorted((r.content_hash, r.dim) for r in contract.queries()[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*/*.parquet'")
    assert got == sorted(con.execute(contract.oracle_sql()[name]).fetchall()) and len(got) == 7


def test_folder_names_are_columns_of_a_stream(spark, tmp_path):
    spark.range(20).selectExpr("id n", "id % 3 slice").write.partitionBy("slice").parquet(f"{tmp_path}/t.parquet")
    got = jobs.collected(jobs.file_stream(spark, str(tmp_path), "t.parquet"), lambda s: s, "folder-names")
    assert sorted((r.n, r.slice) for r in got.collect()) == [(n, n % 3) for n in range(20)]


def run(spark, rows, path, state, embedder=None):
    stream = jobs.arriving(spark.createDataFrame(rows, "chunk_id string, text string, content_hash string, slice int"), "slice")
    jobs.embed_incrementally(stream, f"{path}/done", embedder or hashing_embedder(4), f"{path}/{state}", 4).awaitTermination()
    return sorted((r.content_hash, r.vector) for r in jobs.existing_vectors(spark, f"{path}/done").collect())


def test_blank_and_missing_texts_have_the_zero_vector_and_never_reach_the_model(spark, tmp_path):
    def strict(texts):
        assert all(t.strip() for t in texts)
        return np.ones((len(texts), 4))

    rows = [("a", "x", "h1", 0), ("b", " \n", "h2", 0), ("c", None, "h3", 0), (None, "y", "h4", 0), ("d", "", "h2", 1)]
    assert run(spark, rows, tmp_path, "one", strict) == [("h1", [1.0] * 4), ("h2", [0.0] * 4), ("h3", [0.0] * 4), ("h4", [1.0] * 4)]


def test_a_second_run_embeds_only_what_is_new_and_keeps_what_is_there(spark, tmp_path):
    def never(texts):
        raise AssertionError("embedded again")

    files = lambda: {(d, f): os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(f"{tmp_path}/done") for f in names if f.endswith(".parquet")}
    first = run(spark, [("a", "x", "h1", 0), ("b", "y", "h2", 1)], tmp_path, "one")
    before = files()
    assert run(spark, [("a", "x", "h1", 0), ("b", "y", "h2", 1)], tmp_path, "two", never) == first
    assert before.items() <= files().items()
    assert [h for h, _ in run(spark, [("c", "z", "h3", 0), ("d", "x", "h1", 1)], tmp_path, "three")] == ["h1", "h2", "h3"]
