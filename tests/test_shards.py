"""What one task of a stored-index search holds at most."""

from docketry.operators import posting_store


def test_a_shard_has_few_rows_at_every_size():
    assert 1 << (posting_store.BLOCK_BITS + posting_store.SHARD_BITS) <= 4_096


def test_tasks_of_the_whole_index_grow_in_number_with_the_documents(spark, tmp_path, monkeypatch):
    from docketry.catalog import load_all, whole

    monkeypatch.setattr(whole, "INDEX_ROWS", 2)
    rows = [(i, "one two two", "en", "src1", 11) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = load_all()["lexical_index"].run(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 10
    got = {(r.doc, r.word): r.freq for r in out.collect()}
    assert all(got[i, "two"] == 2.0 and got[i, "one"] == 1.0 for i in range(20))
