"""Records, counters, compressed text, rendered pages and vectors written to a folder, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(rows: DataFrame, path: str, compress: bool = False) -> None:
    """One JSON object a line; null fields are kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip" if compress else "none").json(path)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_counters(rows: DataFrame, by: list[str], path: str) -> None:
    """Counts by ``by`` as one JSON file: an aggregate, so rows of any number are one line a group."""
    rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_lines(rows: DataFrame, path: str, text: str = "text", compress: bool = True) -> None:
    """One text a line, line feeds as ``\\n`` and backslashes doubled, so that any text can be read again; null texts are left out."""
    escaped = F.replace(F.replace(F.replace(F.col(text), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    rows.filter(F.col(text).isNotNull()).select(escaped.alias("value")).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def read_escaped(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_lines`` wrote."""
    parts = F.split("value", r"\\\\", -1)  # doubled backslashes first, so an escaped one is no escape
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return spark.read.text(path).select(F.array_join(plain, "\\").alias("text"))


def write_pages(rows: DataFrame, path: str, key: str = "page_id", html: str = "html") -> None:
    """A folder with one file for each page: for looking at, not for millions."""
    rows.filter(F.col(html).isNotNull()).select(F.col(key).alias("key"), F.col(html).alias("value")).repartition("key").write.mode("overwrite").partitionBy("key").option("lineSep", "\n").text(path)


def write_vectors(rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """Vectors by key in single precision; a null vector marks a skipped row."""
    rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, skipped: bool = False) -> DataFrame:
    """The vectors, or the keys of the ``skipped`` rows."""
    rows = spark.read.schema("vec_id long, embedding array<float>").parquet(path)
    return rows.filter("embedding IS NULL").select("vec_id") if skipped else rows.filter("embedding IS NOT NULL")
