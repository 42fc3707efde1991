"""Refresh of published claims: a full outer merge in which failure or age never erases supported values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OLDER = "older_source_cannot_replace_newer_support"
STALE = "stale_after_failed_observation"
ABSENT = "absent_in_frozen_row"


def outcome(prior_available: Column, decided: Column, accepted: Column, withdrawn: Column, older: Column, same: Column) -> Column:
    """What a slot comes to: the seven outcomes of a decision, or carried without one."""
    return (
        F.when(~decided, "carried")
        .when(~accepted & prior_available & withdrawn, "withdrawn")
        .when(~accepted & prior_available, "stale")
        .when(~accepted, "unavailable")
        .when(prior_available & older, "older")
        .when(prior_available & same, "confirmed")
        .when(prior_available, "changed")
        .otherwise("new")
    )


def merge(previous: DataFrame, decisions: DataFrame, observed_at: str, key: list[str]) -> DataFrame:
    """One row per slot with both sides and the outcome; claims(), history() and changes() project it.

    previous: key, value_json, value_type, availability, reason, evidence_ids array<string>, retrieved_at (of the newest
    evidence), first_observed_at, last_observed_at. decisions: key, accepted, withdrawn, availability, reason,
    value_json, value_type, evidence_id, retrieved_at. Keys are unique on either side (see repeated()). Equal times are
    not older. A value is the same only if its type is as well.
    """
    no = F.lit(False)
    p, d = previous.select(*key, F.struct(*(c for c in previous.columns if c not in key)).alias("p")), decisions.select(*key, F.struct(*(c for c in decisions.columns if c not in key)).alias("d"))
    both = p.join(d, key, "full")
    available = F.coalesce(F.col("p.availability") == "available", no)
    accepted = F.coalesce(F.col("d.accepted"), no)
    older = F.coalesce(F.col("d.retrieved_at") < F.col("p.retrieved_at"), no)
    same = F.coalesce((F.col("d.value_json") == F.col("p.value_json")) & (F.col("d.value_type") == F.col("p.value_type")), no)
    return both.withColumn("outcome", outcome(available, F.col("d").isNotNull(), accepted, F.coalesce(F.col("d.withdrawn"), no), older, same)).withColumn("observed_at", F.lit(observed_at))


def claims(merged: DataFrame, key: list[str]) -> DataFrame:
    """The claims after the merge, one per slot."""
    o, new = F.col("outcome"), F.col("outcome").isin("new", "confirmed", "changed")
    kept = o.isin("carried", "stale", "older")
    ids = F.when(o == "confirmed", F.array_union("p.evidence_ids", F.array("d.evidence_id"))).when(new, F.array("d.evidence_id")).when(kept, F.col("p.evidence_ids")).otherwise(F.array().cast("array<string>"))
    lost = F.coalesce("d.availability", F.when(F.col("d.reason") == ABSENT, "not_available").otherwise("failed"))
    pick = lambda c: F.when(new, F.col(f"d.{c}")).when(kept, F.col(f"p.{c}"))
    return merged.select(
        *key, "outcome", pick("value_json").alias("value_json"), pick("value_type").alias("value_type"),
        F.when(new, "available").when(kept, F.col("p.availability")).when(o == "withdrawn", "not_available").otherwise(lost).alias("availability"),
        F.when(kept, F.col("p.reason")).when(~new, F.col("d.reason")).alias("reason"), ids.alias("evidence_ids"),
        F.when(o == "stale", STALE).alias("freshness"), F.when(o == "stale", F.col("d.reason")).when(o == "older", OLDER).alias("current_attempt_reason"),
        F.when(o == "confirmed", F.col("p.first_observed_at")).when(new, F.col("observed_at")).when(kept, F.col("p.first_observed_at")).alias("first_observed_at"),
        F.when(new, F.col("observed_at")).when(kept, F.col("p.last_observed_at")).alias("last_observed_at"),
    )


def history(merged: DataFrame, key: list[str]) -> DataFrame:
    """Prior claims that a change or a withdrawal superseded."""
    return merged.where(F.col("outcome").isin("changed", "withdrawn")).select(*key, "p.value_json", "p.value_type", "p.evidence_ids", "p.first_observed_at", "p.last_observed_at")


def changes(merged: DataFrame, key: list[str]) -> DataFrame:
    """A row for each changed value and each lost support."""
    lost = F.col("outcome") == "withdrawn"
    none = F.array().cast("array<string>")
    rows = merged.where(F.col("outcome").isin("changed", "withdrawn"))
    return rows.select(*key, F.when(lost, "current_support_lost").otherwise("value_changed").alias("kind"), F.col("p.value_json").alias("old_value"), F.when(~lost, F.col("d.value_json")).alias("new_value"), F.col("p.evidence_ids").alias("old_evidence_ids"), F.when(lost, none).otherwise(F.array("d.evidence_id")).alias("new_evidence_ids"), "observed_at")


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand in several rows; a merge needs none on either side."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_observations(previous: DataFrame, decisions: DataFrame, key: list[str], posting: Column) -> DataFrame:
    """Synthetic rejections for available prior slots that the current decisions leave out; postings are withdrawn."""
    gone = previous.where("availability = 'available'").join(decisions.select(*key), key, "left_anti")
    null = lambda t: F.lit(None).cast(t)
    return gone.select(*key, F.lit(False).alias("accepted"), posting.alias("withdrawn"), null("string").alias("availability"), F.lit("not observed in the current run").alias("reason"), null("string").alias("value_json"), null("string").alias("value_type"), null("string").alias("evidence_id"), null("timestamp_ntz").alias("retrieved_at"))
