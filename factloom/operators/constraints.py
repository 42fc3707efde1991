"""Integrity rules as queries: each gives its violations, and the rows that break none give nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dangling(rows: DataFrame, ref: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference meets no target; null references are not dangling."""
    return rows.where(F.col(ref).isNotNull()).join(target.select(F.col(key).alias(ref)), ref, "left_anti")


def unreferenced(target: DataFrame, key: str, rows: DataFrame, ref: str) -> DataFrame:
    """Targets that no row refers to."""
    return target.join(rows.select(F.col(ref).alias(key)), key, "left_anti")


def repeated(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of several rows with their number."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(rows: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """key, rule for each rule that a row breaks, in one pass over the rows; a condition that is null is broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return rows.select(*key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def key_sets(rows: DataFrame, keys: Column, required: Sequence[str]) -> DataFrame:
    """rows with missing and unknown: the required keys that are not there, and those there that are not required."""
    need = F.array(*map(F.lit, required))
    return rows.withColumn("missing", F.array_except(need, keys)).withColumn("unknown", F.array_except(keys, need))


def same_order(left: DataFrame, right: DataFrame, pos: str, key: str) -> DataFrame:
    """Places at which the two sides do not hold the same key; none: equal membership and order."""
    both = left.select(pos, F.col(key).alias("a")).join(right.select(pos, F.col(key).alias("b")), pos, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))
