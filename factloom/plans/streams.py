"""Streaming queries over the fixture tables, run over what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.registry import registrar
from factloom.session import table
from factloom.streaming import refresh

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1 and event_type <> 'error'")
def q_stream_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = refresh.last_event_stream(_stream(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])
    return refresh.alive(refresh.run_to_table(last, "complete", "last-event"), F.col("event_type") != "error")


@query("""
with d as (select user_id % 20 || '' as slot, event_id as seq, event_type <> 'error' as ok, floor(value / 34) as v from events),
s as (select *, max(case when ok then seq end) over (partition by slot order by seq rows between unbounded preceding and 1 preceding) as held_at from d),
p as (select s.*, h.v as held from s left join d h on h.slot = s.slot and h.seq = s.held_at)
select slot, seq, case when not ok and held_at is null then 'unavailable' when not ok then 'stale' when held_at is null then 'new' when held = v then 'confirmed' else 'changed' end as outcome from p
""")
def q_stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions of twenty slots: errors are failed observations, the value's third is the fact."""
    e = _stream(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    null = F.lit(None).cast("string")
    decisions = e.select(
        (F.col("user_id") % 20).cast("string").alias("slot"), F.col("event_id").alias("seq"), ok.alias("accepted"), F.lit(False).alias("withdrawn"), null.alias("availability"), F.when(~ok, "source failed").alias("reason"),
        F.floor(F.col("value") / 34).cast("string").alias("value_json"), F.lit("int").alias("value_type"), F.concat(F.lit("e"), F.col("event_id")).alias("evidence_id"), F.lpad(F.col("event_id").cast("string"), 19, "0").alias("retrieved_at"), F.lit("2026").alias("observed_at"),
    )
    return refresh.run_to_table(refresh.refresh_stream(decisions), "append", "refresh").select("slot", "seq", "outcome")


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n from events group by 1, 2")
def q_stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over the event time."""
    e = _stream(spark, sf_dir, "events")
    hourly = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
    return refresh.run_to_table(hourly, "complete", "hourly")
