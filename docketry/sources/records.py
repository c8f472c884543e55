"""JSON-lines and Parquet tables: three read modes, keyed and atomic writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

CORRUPT = "_corrupt_record"


def _schema(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_lenient(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows that parse; blank and malformed lines are skipped."""
    return spark.read.schema(_schema(schema)).option("mode", "DROPMALFORMED").json(path)


def read_strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All rows; the first malformed line fails the job."""
    return spark.read.schema(_schema(schema)).option("mode", "FAILFAST").json(path)


def read_counting(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All rows; a malformed line becomes a row whose text is in ``_corrupt_record``."""
    wide = StructType(list(_schema(schema).fields)).add(CORRUPT, StringType())
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows in a stated order (a sample for a quick check)."""
    return df.orderBy(order).limit(n)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_audit(df: DataFrame, path: str) -> None:
    """CSV with a header line, for people to read."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def append_cache(fresh: DataFrame, path: str, sequence: int) -> None:
    """Add lines to the embedding cache; later sequences win when it is read."""
    fresh.select("content_hash", "vector", F.lit(sequence).cast("long").alias("seq")).write.mode("append").parquet(path)
