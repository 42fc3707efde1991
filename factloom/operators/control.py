"""Run control: coverage by family and route, funnels, paired outcomes, shard reports, worker messages, settings."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.stats import interval, mcnemar_p
from factloom.operators.render import FAMILIES
from factloom.operators.windows import in_input_order
from factloom.session import small

#: Fields that are leads and no verified coverage, and the families that a source can serve.
LEADS = ("declared_website", "registered_activity", "social_profile")
ROUTES = {
    "brreg_roles": ("people",),
    "brreg_accounts": ("financials_history",),
    "brreg_subunits": ("operating_locations",),
    "nav_jobs": ("business_products", "jobs_dated_activity"),
    "company_owned": ("business_products", "website_owned_profiles", "jobs_dated_activity"),
}
#: The counters of a website route.
FUNNEL = ("candidate_domains", "candidate_pages_retrieved", "candidate_identity_rejections")
#: Fixed value: byte cap of an aggregate output.
AGGREGATE_BYTES = 128 << 20


def covered_families(claims: DataFrame, key: str) -> DataFrame:
    """(key, family) of the families that available claims cover; leads cover none, a registered role covers people."""
    family = F.coalesce("family", F.when(F.col("field").startswith("registered_role:"), "people"))
    return claims.where((F.col("availability") == "available") & ~F.col("field").isin(*LEADS)).select(key, family.alias("family")).where("family is not null").distinct()


def route_gaps(subjects: DataFrame, covered: DataFrame, attempts: DataFrame, key: str, order: str, routes: Mapping[str, Sequence[str]] = ROUTES, families: Sequence[str] = FAMILIES) -> DataFrame:
    """(key, family, availability, reason) for each family that nothing covers: what the last attempt that can serve it says.

    attempts: key, source, availability, reason and the order column. A family that no attempt could serve was not scheduled.
    """
    serves = F.create_map(*(x for s, f in routes.items() for x in (F.lit(s), F.array(*map(F.lit, f)))))
    last = attempts.select("*", F.explode(F.try_element_at(serves, F.col("source"))).alias("family")).groupBy(key, "family").agg(F.max_by(F.struct("availability", "reason"), order).alias("a"))
    open_ = subjects.select(key, F.explode(F.array(*map(F.lit, families))).alias("family")).join(covered.select(key, "family").distinct(), [key, "family"], "left_anti")
    said = F.when(F.col("a").isNull(), "failed").otherwise(F.coalesce("a.availability", F.lit("not_available")))
    why = F.when(F.col("a").isNull(), "Route not scheduled").otherwise(F.coalesce("a.reason", F.lit("No supported fact in checked source")))
    return open_.join(last, [key, "family"], "left").select(key, "family", said.alias("availability"), why.alias("reason"))


def funnel(attempts: DataFrame, by: Sequence[str] = (), counters: Sequence[str] = FUNNEL) -> DataFrame:
    """Sums of a route's counters, how many companies were attempted, and how many had no candidate and no page."""
    none = lambda c: F.count_if(F.coalesce(c, F.lit(0)) == 0)
    return attempts.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters), F.count(F.lit(1)).alias("companies_attempted"), none(counters[0]).alias("companies_with_no_candidate"), none(counters[1]).alias("companies_with_no_acquired_page"))


def paired_summary(pairs: DataFrame, by: Sequence[str], families: int = 2) -> DataFrame:
    """Of control and challenger outcomes of the same companies: totals, gains, losses, p-value and the interval of the gain.

    The interval, in percentage points, is simultaneous over so many families: each of the two exact marginals has its
    share of the error, and the worst ends are taken.
    """
    a, b = F.col("control"), F.col("challenger")
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("control_covered"), F.count_if(b).alias("challenger_covered"), F.count_if(~a & b).alias("gains"), F.count_if(a & ~b).alias("losses"))
    alpha = F.lit(0.05 / (2 * families))
    g = g.withColumn("_g", interval("gains", "n", alpha)).withColumn("_l", interval("losses", "n", alpha))
    points = lambda c: 100.0 * c
    return g.select(*by, "n", "control_covered", "challenger_covered", "gains", "losses", (F.col("gains") - F.col("losses")).alias("net"), points((F.col("gains") - F.col("losses")) / F.col("n")).alias("gain_pp"), mcnemar_p("gains", "losses").alias("p"), points(F.col("_g.low") - F.col("_l.high")).alias("low_pp"), points(F.col("_g.high") - F.col("_l.low")).alias("high_pp"))


def outcomes(positives: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, family, covered) for every labelled positive: whether the run observed that family for the company."""
    seen = observed.select(key, "family").distinct().withColumn("_seen", F.lit(True))
    return positives.select(key, "family").distinct().join(seen, [key, "family"], "left").select(key, "family", F.coalesce("_seen", F.lit(False)).alias("covered"))


def merged_reports(reports: DataFrame, expected: int, sums: Sequence[str]) -> DataFrame:
    """One total from the shards' reports: sums, shards, which of the expected ones are missing, and the status.

    reports: shard (from 0), failed_companies and the columns to sum. The status is completed only if all shards have
    reported, each once, and no company failed.
    """
    total = reports.agg(F.count(F.lit(1)).alias("shards"), F.collect_set("shard").alias("_seen"), F.coalesce(F.sum("failed_companies"), F.lit(0)).alias("failed_companies"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))  # shard numbers: one for each hundred companies
    missing = F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(expected - 1)), F.transform("_seen", lambda x: x.cast("int"))))
    sound = (F.size(missing) == 0) & (F.col("shards") == expected) & (F.col("failed_companies") == 0)
    return total.withColumn("missing", F.concat_ws(",", missing)).withColumn("status", F.when(sound, "completed").otherwise("failed")).drop("_seen")


def aggregate(shards: DataFrame, inputs: DataFrame, key: str, pos: str, value: str, most: int = AGGREGATE_BYTES) -> DataFrame:
    """The shards' output lines in input order, a line for each input; beyond the byte cap, or if a line is missing, it raises."""
    size = shards.agg(F.coalesce(F.sum(F.octet_length(value)), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the aggregate has {size} bytes; the cap is {most}")
    rows = in_input_order(shards.select(key, value), inputs, key, pos)
    lost = F.when(F.col("failed"), F.raise_error(F.concat(F.lit("no shard has a row for "), F.col(key).cast("string"))))
    return rows.select(pos, key, F.coalesce(lost.cast("string"), value).alias(value)).orderBy(pos)


def last_messages(messages: DataFrame, key: str, order: str) -> DataFrame:
    """The message that stands for each company: its last terminal one, else its last checkpoint, which was interrupted.

    messages: key, kind (checkpoint or terminal), body and the order column. Repeated messages change nothing.
    """
    rank = F.struct((F.col("kind") == "terminal").alias("t"), order)
    last = messages.where(F.col("kind").isin("checkpoint", "terminal")).groupBy(key).agg(F.max_by(F.struct("kind", "body"), rank).alias("m"))
    return last.select(key, F.when(F.col("m.kind") == "terminal", "completed").otherwise("interrupted").alias("status"), F.col("m.body").alias("body"))


def module_records(claims: DataFrame, evidence: DataFrame, key: str, fields: Mapping[str, tuple[str, str]], order: str) -> DataFrame:
    """A record for each company and public field: the first available claim with its evidence, else an absent one.

    claims: key, field, value_json, availability, reason, evidence_ids and the order column. evidence: key, id,
    source_class, source_url, retrieved_at, content_sha256. fields: public field -> (claim's field, source class).
    """
    names = F.create_map(*(x for public, (own, _) in fields.items() for x in (F.lit(own), F.lit(public))))
    classes = F.create_map(*(x for public, (_, kind) in fields.items() for x in (F.lit(public), F.lit(kind))))
    own = claims.withColumn("record", F.try_element_at(names, F.col("field"))).where("record is not null")
    ok = F.col("availability") == "available"
    chosen = own.groupBy(key, "record").agg(F.min_by(F.struct("value_json", "availability", "reason", "evidence_ids"), F.struct((~ok).alias("late"), order)).alias("c"))
    every = claims.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, fields))).alias("record")).join(chosen, [key, "record"], "left")
    every = every.withColumn("id", F.when(F.col("c.availability") == "available", F.try_element_at("c.evidence_ids", F.lit(1))))
    out = every.join(evidence.select(key, "id", "source_class", "source_url", "retrieved_at", "content_sha256"), [key, "id"], "left")
    found = F.col("c.availability") == "available"
    state = F.coalesce("c.availability", F.lit("not_available"))
    return out.select(
        key, F.col("record").alias("field"), state.alias("availability"), F.coalesce("source_class", F.element_at(classes, F.col("record"))).alias("source_class"), "source_url", "retrieved_at", F.when(found, F.col("c.value_json")).alias("value_json"),
        F.when(~F.coalesce(found, F.lit(False)), F.coalesce("c.reason", F.lit("No supported claim"))).alias("reason"), "content_sha256", F.when(found, F.col("c.evidence_ids")).alias("evidence_ids"),
    )


def anchors(registry: DataFrame, entities: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """(key, name, website, email, source) of each company: its frozen registry row, else its fetched entity.

    registry, entities: key, name, website, email. A company without either, or with a blank name, raises.
    """
    own = registry.select(key, F.struct("name", "website", "email", F.lit("frozen_registry").alias("source")).alias("r"))
    live = entities.select(key, F.struct("name", "website", "email", F.lit("brreg_entity").alias("source")).alias("e"))
    side = small(subjects.select(key).distinct())
    found = subjects.select(key).join(own.join(side, key, "left_semi"), key, "left").join(live.join(side, key, "left_semi"), key, "left").select(key, F.coalesce("r", "e").alias("a"))
    bad = F.coalesce(F.trim("a.name"), F.lit("")) == ""
    name = F.when(bad, F.raise_error(F.concat(F.lit("no legal name for "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("a.name"))
    return found.select(key, name.alias("name"), F.coalesce("a.website", F.lit("")).alias("website"), "a.email", "a.source")


@dataclass(frozen=True)
class Setting:
    """A setting: what it must be, in words, and the test; official: only needed in official mode."""

    name: str
    must: str
    test: Callable[[object], bool]
    needed: bool = True
    official: bool = False


def _whole(least: int) -> Callable[[object], bool]:
    return lambda v: type(v) is int and v >= least


def _number(test: Callable[[float], bool]) -> Callable[[object], bool]:
    return lambda v: type(v) in (int, float) and math.isfinite(v) and test(v)


def _text(v: object) -> bool:
    return isinstance(v, str) and bool(v.strip())


def _one_of(*values: object) -> Callable[[object], bool]:
    return lambda v: any(v == x and type(v) is type(x) for x in values)


#: Versions of the contract that a run may name.
CONTRACTS = ("local-v1",)
#: The settings of a run.
SETTINGS = (
    Setting("contract_version", "the known contract", lambda v: v in CONTRACTS),
    Setting("mode", "local or official", _one_of("local", "official")),
    *(Setting(n, "an integer from 1 on", _whole(1)) for n in ("sample_size", "wall_time_seconds", "request_budget", "workers", "per_host_concurrency", "request_timeout_seconds", "max_response_bytes", "max_pdf_bytes")),
    Setting("max_retries", "an integer from 0 on", _whole(0)),
    Setting("third_party_cost_usd", "a number from 0 on", _number(lambda v: v >= 0)),
    Setting("finalization_reserve_fraction", "between 0 and 1", _number(lambda v: 0 < v < 1)),
    Setting("network_enabled", "true or false", _one_of(True, False)),
    Setting("enabled_sources", "a list of different sources", lambda v: isinstance(v, list) and bool(v) and all(isinstance(s, str) for s in v) and len(set(v)) == len(v)),
    Setting("settings_origin", "who set the budget", _text),
    *(Setting(n, "an integer from 1 on", _whole(1), needed=False) for n in ("max_total_bytes", "max_pages_per_company", "max_html_bytes")),
    Setting("allow_registry_redirects", "true or false", _one_of(True, False), needed=False),
    Setting("min_host_interval_seconds", "a number from 0 on", _number(lambda v: v >= 0), needed=False),
    Setting("routing_policy", "fixed or adaptive", _one_of("fixed", "adaptive"), needed=False),
    Setting("wire_schema_confirmed", "true", _one_of(True), official=True),
    *(Setting(n, "a text", _text, official=True) for n in ("organizer_settings_receipt", "cutoff")),
    *(Setting(n, "a number above 0", _number(lambda v: v > 0), official=True) for n in ("cpu_limit", "memory_limit_bytes")),
)


def setting_faults(config: object, sources: Mapping[str, Mapping[str, object]]) -> list[str]:
    """What is wrong with a run's settings, in order of SETTINGS, then rules across settings; sources: id -> status, network."""
    if not isinstance(config, dict):
        return ["settings must be an object"]
    official = config.get("mode") == "official"
    known = [s for s in SETTINGS if official or not s.official]
    faults = []
    for s in known:
        if s.name not in config:
            faults += [f"{s.name} is missing"] if s.needed else []
        elif not s.test(config[s.name]):
            faults.append(f"{s.name} must be {s.must}")
    faults += [f"{name} is unknown" for name in sorted(config.keys() - {s.name for s in known})]
    sound = {s.name for s in known if s.name in config and s.test(config[s.name])}
    for a, b, said in (("per_host_concurrency", "workers", "at most"), ("max_response_bytes", "max_html_bytes", "at most")):
        if {a, b} <= sound and config[a] > config[b]:
            faults.append(f"{a} must be {said} {b}")
    for s in config["enabled_sources"] if "enabled_sources" in sound else ():
        entry = sources.get(s, {})
        if entry.get("status") != "enabled":
            faults.append(f"source {s} is not activated")
        elif entry.get("network") and config.get("network_enabled") is not True:
            faults.append(f"source {s} needs the network")
    return faults

