"""Wide rows to candidate facts, acceptance with reasons, and one decision per fact slot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFLICT = "Conflicting source values for the same claim slot"
SITE_CONFLICT = "Conflicting verified websites for one company"
DUPLICATE = "Duplicate proposals for one field"


def json_scalar(col: Column, kind: T.DataType) -> Column:
    """A scalar as canonical JSON text: strings quoted, numbers and booleans as they are, null as null."""
    if isinstance(kind, T.StringType):
        text = F.to_json(F.array(col))
        return F.when(col.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))
    return col.cast("string")


def type_name(kind: T.DataType) -> str:
    """The JSON kind of a type: 1 and 1.0, or 1 and '1', are different values."""
    if isinstance(kind, T.StringType):
        return "str"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "float" if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else "int"


def unpivot(df: DataFrame, keys: Sequence[str], fields: Mapping[str, str], drop_missing: bool = False) -> DataFrame:
    """One row per key and field: keys, pos, field, value_json, value_type. fields: field name -> column.

    Values keep their type by name, so columns of any scalar types go together. drop_missing leaves out null and ''.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    structs = [F.struct(F.lit(k).alias("pos"), F.lit(field).alias("field"), json_scalar(F.col(c), kinds[c]).alias("value_json"), F.lit(type_name(kinds[c])).alias("value_type")) for k, (field, c) in enumerate(fields.items())]
    out = df.select(*keys, F.inline(F.array(*structs)))
    return out.where("value_json is not null and value_json <> '\"\"'") if drop_missing else out


def unpivot_paths(df: DataFrame, keys: Sequence[str], records: str, paths: Mapping[str, str], carry: Mapping[str, str] | None = None) -> DataFrame:
    """Array of nested records x field paths: keys, record, carried columns, field, amount; missing and null amounts are skipped.

    paths: field name -> dotted path inside a record; carry: column -> dotted path of a value to keep beside each amount.
    """
    carry = carry or {}
    rows = df.select(*keys, F.posexplode(records).alias("record", "r")).select(*keys, "record", *(F.col(f"r.{p}").alias(c) for c, p in carry.items()), "r")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"r.{p}").cast("double").alias("amount")) for f, p in paths.items()]
    return rows.select(*keys, "record", *carry, F.inline(F.array(*cells))).where("amount is not null")


def check(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """df with reason (of the first rule that fails) and accepted. rules: (reason, condition to hold); null fails."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules]
    return df.withColumn("reason", F.coalesce(*failed, F.lit(None).cast("string"))).withColumn("accepted", F.col("reason").isNull())


def unique_decisions(df: DataFrame, slot: Sequence[str], order: str) -> DataFrame:
    """One decision per slot from df (slot, order, accepted, reason, value_json, value_type).

    Accepted decisions that agree in value and type give the first of them; if they differ, the slot is rejected as
    ambiguous. Rejected decisions count only where the slot has no accepted one; the first is kept.
    """
    key = F.when(F.col("accepted"), F.struct("value_type", "value_json"))
    first = lambda on: F.min_by(F.struct("value_json", "value_type", "reason"), F.when(on, F.col(order)))
    low, high = F.min(key), F.max(key)
    grouped = df.groupBy(*slot).agg(low.alias("low"), high.alias("high"), first(F.col("accepted")).alias("yes"), first(~F.col("accepted")).alias("no"), F.min(F.when(F.col("accepted"), F.col(order))).alias("yes_at"), F.min(order).alias("any_at"))
    clash = F.col("low").isNotNull() & (F.col("low") != F.col("high"))
    ok = F.col("low").isNotNull() & ~clash
    return grouped.select(
        *slot, F.coalesce("yes_at", "any_at").alias(order), ok.alias("accepted"), F.when(ok, F.col("yes.value_json")).alias("value_json"), F.when(ok, F.col("yes.value_type")).alias("value_type"),
        F.when(clash, F.lit("ambiguous")).when(ok, "available").otherwise("failed").alias("availability"), F.when(clash, F.lit(CONFLICT)).when(~ok, F.col("no.reason")).alias("reason"),
    )


def one_site(df: DataFrame, key: Sequence[str], host: Column, strength: Column, value: str) -> DataFrame:
    """One accepted site per key: different hosts (www. aside) are ambiguous, else the strongest proof's value stays."""
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    grouped = df.select(*key, F.col(value).alias("v"), bare.alias("h"), strength.alias("s")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.min("h") != F.max("h")).alias("clash"), F.min_by("v", F.struct("s", "v")).alias("v"))
    return grouped.select(*key, F.when(~F.col("clash"), F.col("v")).alias(value), F.when(F.col("clash"), "ambiguous").otherwise("available").alias("availability"), F.when(F.col("clash"), SITE_CONFLICT).alias("reason"), F.col("n").alias("proposals"))


def reject_repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df with reason and accepted: all proposals of a key that has several are rejected."""
    counts = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return check(df.withColumn("_n", counts), [(DUPLICATE, F.col("_n") == 1)]).drop("_n")
