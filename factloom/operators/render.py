"""Published shapes: public names, confidence, module blocks, cited summaries, result pages."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Official scopes, public field names, families of facts.
OFFICIAL = ("frozen_registry", "official_entity", "entity_accounts", "group_accounts", "registered_subunit", "registered_role_snapshot")
PUBLIC = {"verified_website": "official_website"}
FAMILIES = ("people", "financials_history", "operating_locations", "business_products", "website_owned_profiles", "jobs_dated_activity")


def public_name(field: Column) -> Column:
    """The field's name at the public boundary; ids are not changed by it."""
    return F.coalesce(*(F.when(field == k, F.lit(v)) for k, v in PUBLIC.items()), field)


def internal_name(field: Column) -> Column:
    return F.coalesce(*(F.when(field == v, F.lit(k)) for k, v in PUBLIC.items()), field)


def confidence(field: Column, scope: Column, availability: Column, value: Column) -> Column:
    """Fixed confidence of a claim by its kind; 0 unless it is available."""
    timed = F.coalesce(F.get_json_object(value, "$.published_at").contains("T"), F.lit(False))
    return (
        F.when(availability != "available", 0.0).when(scope.isin(*OFFICIAL), 1.0).when((field == "verified_website") & (scope == "registry_declared_host_name_gate"), 0.9)
        .when(field == "verified_website", 0.99).when(field == "dated_news", F.when(timed, 0.9).otherwise(0.8)).when(scope == "nav_verified_employer", 0.99).otherwise(0.9)
    )


def opportunities(covered: DataFrame, subjects: DataFrame, key: str, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """A row for each subject and family: covered or unknown. covered: key, family."""
    every = subjects.select(key, F.explode(F.array(*map(F.lit, families))).alias("family"))
    return every.join(covered.select(key, "family").distinct().withColumn("c", F.lit(True)), [key, "family"], "left").select(key, "family", F.when(F.col("c"), "covered").otherwise("unknown").alias("status"))


def display(value: Column) -> Column:
    """A value for people: strings without quotes, objects as their values in a row."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    parts = F.concat_ws(", ", F.map_values(F.from_json(value, "map<string,string>")))
    return F.when(value.startswith("{"), parts).otherwise(text)


def envelopes(claims: DataFrame, subjects: DataFrame, key: str, pos: str) -> DataFrame:
    """One JSON text per subject in input order, also for subjects without a claim; claims stand by field and id."""
    rest = [c for c in claims.columns if c != key]
    grouped = claims.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("claims"))  # a subject's claims: a bounded catalogue
    out = subjects.select(pos, key).join(grouped, key, "left")
    body = F.struct(F.col(key), F.coalesce("claims", F.from_json(F.lit("[]"), grouped.schema["claims"].dataType)).alias("claims"), F.when(F.col("claims").isNull(), "failed").otherwise("completed").alias("terminal_status"))
    return out.select(pos, key, F.to_json(body, {"ignoreNullFields": "false"}).alias("envelope"))


def summary(claims: list[dict]) -> list[str]:
    """Cited sentences of a subject's available claims; the number in brackets is the claim's place."""
    return [f"{c['field'].replace('_', ' ').capitalize()}: {c['shown']} [{k}]" for k, c in enumerate(claims, 1) if c.get("availability") == "available"]


PAGE = "path string, body string"


def pages(claims: DataFrame, key: str) -> DataFrame:
    """(path, body): a page per subject with its cited claims, all text escaped. claims: key, field, shown, availability."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for subject, rows in f[["k", "c"]].itertuples(index=False):
                items = "".join(f"<li>{html.escape(s)}</li>" for s in summary(json.loads(rows)))
                out.append((f"{subject}.html", f'<!doctype html><meta charset="utf-8"><title>{html.escape(subject)}</title><ul>{items}</ul>'))
            yield pd.DataFrame(out, columns=["path", "body"])

    grouped = claims.groupBy(F.col(key).cast("string").alias("k")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("field", "shown", "availability")))).alias("c"))
    return grouped.mapInPandas(run, PAGE)
