"""Content-addressed snapshots as tables, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "content_sha256 string, body binary"


def put(spark: SparkSession, path: str, bodies: DataFrame) -> DataFrame:
    """Append the bodies (column body) that the store does not hold; gives content_sha256 of all that were put.

    Content addressing makes this idempotent: equal bodies are one object, and a second put adds nothing.
    """
    new = bodies.select(F.sha2("body", 256).alias("content_sha256"), F.col("body").cast("binary").alias("body")).dropDuplicates(["content_sha256"])
    spark.createDataFrame([], OBJECTS).write.mode("append").parquet(path)
    held = spark.read.schema(OBJECTS).parquet(path)
    new.join(held.select("content_sha256"), "content_sha256", "left_anti").write.mode("append").parquet(path)
    return new.select("content_sha256")


def read(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Objects of the store, of all or some ids; a body that does not match its name raises."""
    rows = spark.read.schema(OBJECTS).parquet(path)
    if ids is not None:
        rows = rows.join(ids.select("content_sha256").distinct(), "content_sha256", "left_semi")
    return rows.select("content_sha256", F.when(F.sha2("body", 256) != F.col("content_sha256"), F.raise_error(F.lit("a stored object is corrupt")).cast("binary")).otherwise(F.col("body")).alias("body"))


def publish(df: DataFrame, path: str, pos: str | None = None) -> None:
    """Write JSON lines to a new folder, nulls kept, in order of pos; an existing folder is never touched."""
    ordered = df.orderBy(pos) if pos else df
    ordered.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def report(spark: SparkSession, output: str, path: str) -> DataFrame:
    """The completion marker of an output folder: files, lines and a SHA-256 of each file's bytes; written last."""
    files = spark.read.format("binaryFile").load(f"{output}/part-*").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("output_sha256"), "length")
    lines = spark.read.text(output).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    files.join(lines, "file", "left").select("file", F.coalesce("lines", F.lit(0)).alias("lines"), "length", "output_sha256").write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
