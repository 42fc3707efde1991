"""Structural rules of published envelopes as one table of violations, and the check of prior claims before reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.dates import timestamp
from factloom.operators.constraints import dangling, repeated, violations

# States of a claim and kinds of a change.
STATES = ("available", "not_available", "failed", "ambiguous", "blocked", "not_applicable")
KINDS = ("value_changed", "current_support_lost")


def envelope_violations(subjects: DataFrame, claims: DataFrame, evidence: DataFrame, changes: DataFrame, runs: DataFrame) -> DataFrame:
    """(subject, rule) for every rule that is broken; sound envelopes give nothing.

    subjects: subject. claims: subject, field, claim_id, value_json, availability, reason, evidence_ids. evidence:
    subject, id, source_url, retrieved_at, content_sha256, claim_span. changes: subject, claim_id, kind, old_value,
    new_value, observed_at. runs: subject, started_at, completed_at, terminal_status.
    """
    key = ["subject"]
    available = F.col("availability") == "available"
    some = F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0
    of_claims = violations(claims, key, [
        ("claim: known state", F.col("availability").isin(*STATES)), ("claim: has a field", F.length("field") > 0), ("claim: available if and only if it has a value", available == F.col("value_json").isNotNull()), ("claim: available if and only if it has evidence", available == some),
        ("claim: a reason unless available", available | F.col("reason").isNotNull()), ("claim: evidence ids differ", F.size(F.array_distinct(F.coalesce("evidence_ids", F.array().cast("array<string>")))) == F.size(F.coalesce("evidence_ids", F.array().cast("array<string>")))),
    ])
    of_evidence = violations(evidence, key, [
        ("evidence: https source", F.col("source_url").rlike(r"^https://[^@\s]+$")), ("evidence: time with an offset", timestamp(F.col("retrieved_at")).isNotNull()), ("evidence: content digest", F.col("content_sha256").rlike("^[0-9a-f]{64}$")), ("evidence: literal span", F.length("claim_span") > 0),
    ])
    of_changes = violations(changes, key, [
        ("change: known kind", F.col("kind").isin(*KINDS)), ("change: time with an offset", timestamp(F.col("observed_at")).isNotNull()), ("change: a lost value has no successor", (F.col("kind") != "current_support_lost") | F.col("new_value").isNull()), ("change: values differ", ~F.col("old_value").eqNullSafe(F.col("new_value"))),
    ])
    of_runs = violations(runs, key, [("run: known end", F.col("terminal_status").isin("completed", "failed")), ("run: times in order", timestamp(F.col("started_at")) <= timestamp(F.col("completed_at")))])
    cited = claims.select("subject", F.explode("evidence_ids").alias("id"))
    named = lambda df, rule: df.select("subject", F.lit(rule).alias("rule"))
    pair = lambda df, c: df.withColumn("_k", F.struct("subject", c))
    parts = [
        of_claims, of_evidence, of_changes, of_runs,
        named(dangling(pair(cited, "id"), "_k", pair(evidence, "id"), "_k"), "claim: evidence exists"), named(pair(evidence, "id").join(pair(cited, "id").select("_k"), "_k", "left_anti"), "evidence: is cited"),
        named(repeated(claims, ["subject", "claim_id"]), "claim: one per slot"), named(repeated(evidence, ["subject", "id"]), "evidence: one per id"), named(repeated(runs, key), "run: one per subject"),
        named(subjects.join(runs.select("subject"), "subject", "left_anti"), "subject: has a terminal row"), named(runs.join(subjects.select("subject"), "subject", "left_anti"), "run: of an input subject"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def unverified(previous: DataFrame, derived: DataFrame, key: list[str]) -> DataFrame:
    """Available prior claims that the stored bytes do not give again with the same type and value."""
    again = derived.select(*key, "value_json", "value_type").distinct()
    return previous.where("availability = 'available'").join(again, [*key, "value_json", "value_type"], "left_anti")


def refuse(rows: DataFrame, message: str) -> None:
    """Raise if there is any row; one action with a limit of one."""
    if first := rows.take(1):
        raise ValueError(f"{message}: {first[0].asDict()}")
