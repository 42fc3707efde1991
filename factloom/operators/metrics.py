"""Aggregates of the evaluation: nearest-rank percentiles, recall mixtures, planner scores, module states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity of module states, the gravest first.
SEVERITY = ("blocked", "failed", "ambiguous", "not_available", "not_applicable")


def nearest_rank(value: str, q: float) -> Column:
    """The element number ceil(n * q) in order, an observed value."""
    return F.expr(f"percentile_disc({q}) within group (order by {value})").cast("double")


def upper_median(value: str) -> Column:
    """The element number n // 2 + 1 in order, the upper of two middle ones: the first rank just above a half.

    Counts by value are merged, so no list of all values is built; exact up to some 10**11 rows.
    """
    return F.expr(f"percentile_disc(0.500000000001) within group (order by {value})").cast("double")


def planner_scores(observations: DataFrame, route: str, gains: str, facts: str, requests: str, novelty: Column) -> DataFrame:
    """route, attempts, gains, unique_facts, requests, expected, cost, priority: (gains + 1) / (attempts + 2) per request.

    novelty: an aggregate of the route's rows, the number of families that it could still add.
    """
    out = observations.groupBy(route).agg(F.count(F.lit(1)).alias("attempts"), F.sum(gains).cast("long").alias("gains"), F.sum(facts).cast("long").alias("unique_facts"), F.sum(requests).cast("long").alias("requests"), novelty.cast("long").alias("novelty"))
    out = out.withColumn("expected", (F.col("gains") + 1) / (F.col("attempts") + 2)).withColumn("cost", F.greatest(F.lit(1.0), F.col("requests") / F.col("attempts")))
    return out.withColumn("priority", F.col("novelty") * F.col("expected") / F.col("cost"))


def family_metric(rows: DataFrame, family: str, company: str, positive: Column, covered: Column, matched: Column) -> DataFrame:
    """Recall of companies and of claims per family, and their mixture 0.7 / 0.3; null where nothing can be measured."""
    g = rows.groupBy(family).agg(
        F.count_distinct(F.when(positive, F.col(company))).alias("positive_companies"), F.count_distinct(F.when(positive & covered, F.col(company))).alias("covered_companies"),
        F.count_if(positive).alias("checked_claims"), F.count_if(positive & matched).alias("matched_claims"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    g = g.withColumn("company_recall", ratio("covered_companies", "positive_companies")).withColumn("claim_recall", ratio("matched_claims", "checked_claims"))
    return g.withColumn("mixture", 0.7 * F.col("company_recall") + 0.3 * F.col("claim_recall")).withColumn("state", F.when(F.col("mixture").isNull(), "not_measured").otherwise("measured"))


def stage_counts(rows: DataFrame, stages: Sequence[tuple[str, Column]], key: Sequence[str] = (), other: str = "none") -> DataFrame:
    """How many rows stop at each stage: the first condition that holds names it."""
    stage = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in stages), F.lit(other))
    return rows.groupBy(*key, stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def compare_accounts(expected: DataFrame, published: DataFrame, key: Sequence[str], field: str, value: str) -> DataFrame:
    """Per field: expected, correct, missing, unsupported slots and coverage. Conflicting expected slots count nowhere."""
    e = expected.groupBy(*key, field).agg(F.min(value).alias("e"), F.max(value).alias("_top")).where(F.col("e").eqNullSafe(F.col("_top"))).drop("_top")
    clash = expected.groupBy(*key, field).agg(F.min(value).alias("a"), F.max(value).alias("b")).where("a <> b").select(*key, field)
    both = e.join(published.select(*key, field, F.col(value).alias("p")).join(clash, [*key, field], "left_anti"), [*key, field], "full")
    out = both.groupBy(field).agg(F.count("e").alias("expected"), F.count_if(F.col("e") == F.col("p")).alias("correct"), F.count_if(F.col("e").isNotNull() & ~F.col("e").eqNullSafe(F.col("p"))).alias("missing"), F.count_if(F.col("p").isNotNull() & ~F.col("e").eqNullSafe(F.col("p"))).alias("unsupported"))
    return out.withColumn("coverage", F.when(F.col("expected") > 0, F.col("correct") / F.col("expected")))


def module_state(rows: DataFrame, key: Sequence[str], availability: Column) -> DataFrame:
    """complete if any row is available, else the gravest state there is."""
    rank = F.coalesce(*(F.when(availability == s, F.lit(k)) for k, s in enumerate(SEVERITY)), F.lit(len(SEVERITY)))
    names = F.array(*map(F.lit, SEVERITY), F.lit("not_applicable"))
    return rows.groupBy(*key).agg(F.max(availability == "available").alias("any"), F.min(rank).alias("worst")).select(*key, F.when(F.col("any"), "complete").otherwise(F.element_at(names, F.col("worst") + 1)).alias("state"))


def latest(rows: DataFrame, key: Sequence[str], value: str, time: str, fallback: str) -> DataFrame:
    """The value of the newest time of each key, else the fallback; equal times: the greatest value."""
    return rows.groupBy(*key).agg(F.coalesce(F.max_by(value, F.struct(time, value)), F.lit(fallback)).alias("latest"))


def first_value(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The value that is first by the order columns."""
    return rows.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias("first"))


def flags(rows: DataFrame, key: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    """For each test whether any row of the key passes, and the number of tests passed."""
    g = rows.groupBy(*key).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in tests.items()))
    total = F.lit(0)
    for n in tests:
        total = total + F.col(n).cast("int")
    return g.withColumn("areas", total)


def best_per_key(rows: DataFrame, key: Sequence[str], excluded: str, start: str) -> DataFrame:
    """The first row of each key by place, but one that is not excluded before any that is."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(excluded, start)).alias("r")).select(*key, "r.*")


def supported_fields(rows: DataFrame, key: Sequence[str], field: str, ok: Column) -> DataFrame:
    """The sorted distinct fields of the rows that pass, joined by commas (fields are a bounded catalogue)."""
    return rows.groupBy(*key).agg(F.concat_ws(",", F.sort_array(F.collect_set(F.when(ok, F.col(field))))).alias("fields"))


def totals(rows: DataFrame, key: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per key and over all (nulls in key), from partial sums: shard reports to one total."""
    return rows.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums)).unionByName(rows.agg(*(F.sum(c).alias(c) for c in sums)), allowMissingColumns=True)
