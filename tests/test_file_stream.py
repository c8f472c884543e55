"""Tables as streams: one file or a folder of files."""

from docketry.streaming import jobs


def test_a_table_streams_alike_as_a_file_and_as_a_folder(spark, tmp_path):
    rows = spark.range(50).withColumnRenamed("id", "n")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "t.parquet"))
    rows.toPandas().to_parquet(tmp_path / "t.parquet")
    for folder in (tmp_path / "many", tmp_path):
        stream = jobs.file_stream(spark, str(folder), "t.parquet")
        got = jobs.collected(stream, lambda s: s.where("n % 2 = 0"), "file-stream-test")
        assert sorted(r.n for r in got.collect()) == list(range(0, 50, 2))
