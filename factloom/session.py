"""Sessions, table access, size-checked broadcasts and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[1])
#: Bytes of values up to which a side is broadcast; it is measured first, and a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Rows that a Python worker gets at once, where the session has Spark's default: documents can be long.
BATCH_ROWS = 1000


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI semantics and UTC."""
    builder = SparkSession.builder.appName("factloom")
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started, and bound their batches."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(col, kind: T.DataType):
    """Bytes of a value's contents."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(col, F.lit(0).cast("long"), lambda total, x: total + _bytes(x, kind.elementType)) if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.size(col) * 8
        return F.coalesce(each, F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(col[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its values are measured to take at most so many bytes, else as it is.

    The measure is one sum over all rows, added up where they are; df should be cheap to read, like a written table.
    """
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0))
    found = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if found <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: that of spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster there is no folder that could be taken.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found
