"""Candidates, decisions, claims and their refresh over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import claims, constraints, envelope, refresh
from factloom.plans.registry import registrar
from factloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

CUSTOMER_FIELDS = {"legal_name": "c_name", "nation": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment"}


def customer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.unpivot(table(spark, sf_dir, "customer"), ["c_custkey"], CUSTOMER_FIELDS)


@query("""
select c_custkey, pos, field, value_json, value_type from (
  select c_custkey, 0::int as pos, 'legal_name' as field, '"' || c_name || '"' as value_json, 'str' as value_type from customer
  union all select c_custkey, 1::int, 'nation', c_nationkey::varchar, 'int' from customer
  union all select c_custkey, 3::int, 'segment', '"' || c_mktsegment || '"', 'str' from customer)
""")
def q_unpivot_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_candidates(spark, sf_dir).where("field <> 'balance'")


@query("""
select s_suppkey, f as field, v as value_json from (
  select s_suppkey, 'name' as f, '"' || s_name || '"' as v from supplier
  union all select s_suppkey, 'nation', case when s_nationkey % 3 <> 0 then s_nationkey::varchar end from supplier
  union all select s_suppkey, 'note', case when s_suppkey % 4 = 0 then '""' else '"n"' end from supplier)
where v is not null and v <> '""'
""")
def q_present_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey")).alias("nation"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("n").alias("note"))
    return claims.unpivot(rows, ["s_suppkey"], {"name": "s_name", "nation": "nation", "note": "note"}, drop_missing=True).select("s_suppkey", "field", "value_json")


@query("""
select l_orderkey, l_linenumber::bigint - 1 as record, field, round(amount, 6) as amount from (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem) x,
  lateral (values ('total_assets', l_extendedprice), ('total_debt', case when l_quantity > 10 then l_quantity end), ('annual_result', 0 - l_tax)) t(field, amount)
where amount is not null
""")
def q_filing_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested filings x fields: the lines of an order as its filings, amounts that are missing are skipped."""
    lines = table(spark, sf_dir, "lineitem")
    filing = F.struct("l_linenumber", F.struct(F.col("l_extendedprice").alias("total")).alias("assets"), F.struct(F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("total")).alias("debt"), (0 - F.col("l_tax")).alias("result"))
    filings = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(filing)).alias("filings"))  # an order's lines: few
    out = claims.unpivot_paths(filings, ["l_orderkey"], "filings", {"total_assets": "assets.total", "total_debt": "debt.total", "annual_result": "result"}, {"n": "l_linenumber"})
    return out.select("l_orderkey", (F.col("n") - 1).cast("long").alias("record"), "field", F.round("amount", 6).alias("amount"))


CHECK_RULES = "case when s_suppkey % 7 = 0 then 'wrong subject' when s_suppkey % 5 = 0 then 'blank value' when s_acctbal < 0 then 'negative value' end"


@query(f"select s_suppkey, {CHECK_RULES} as reason, ({CHECK_RULES}) is null as accepted from supplier")
def q_check_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    rules = [("wrong subject", F.col("s_suppkey") % 7 != 0), ("blank value", F.col("s_suppkey") % 5 != 0), ("negative value", F.col("s_acctbal") >= 0)]
    return claims.check(rows, rules).select("s_suppkey", "reason", "accepted")


def _line_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_quantity") > 3).alias("accepted"), F.when(F.col("l_quantity") <= 3, "too few").alias("reason"), F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('"')).alias("value_json"), F.lit("str").alias("value_type"))


@query("""
with d as (select l_partkey, l_orderkey * 10 + l_linenumber as pos, l_quantity > 3 as accepted, '"' || l_returnflag || '"' as v from lineitem),
g as (select l_partkey, count(distinct case when accepted then v end) as kinds, min(case when accepted then pos end) as yes_at, min(pos) as any_at,
  min(case when accepted then v end) as v from d group by 1)
select l_partkey, coalesce(yes_at, any_at) as pos, kinds = 1 as accepted, case when kinds = 1 then v end as value_json, case when kinds = 1 then 'str' end as value_type,
  case when kinds > 1 then 'ambiguous' when kinds = 1 then 'available' else 'failed' end as availability,
  case when kinds > 1 then 'Conflicting source values for the same claim slot' when kinds = 0 then 'too few' end as reason from g
""")
def q_unique_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.unique_decisions(_line_decisions(spark, sf_dir), ["l_partkey"], "pos")


@query("""
with p as (select page_id % 40 as company, regexp_replace(regexp_extract(url, '://([^/]+)', 1), '^www\\.', '') as h, url, case when url like 'https:%' then 0 else 1 end as s from pages),
g as (select company, count(distinct h) as hosts, count(*) as n, min({'s': s, 'u': url}) as best from p group by 1)
select company, case when hosts = 1 then best['u'] end as url, case when hosts > 1 then 'ambiguous' else 'available' end as availability,
  case when hosts > 1 then 'Conflicting verified websites for one company' end as reason, n as proposals from g
""")
def q_one_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("company"), "url", F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    return claims.one_site(rows, ["company"], F.col("host"), F.when(F.col("url").startswith("https:"), 0).otherwise(1), "url")


@query("""
select o_custkey, o_orderkey, case when n > 1 then 'Duplicate proposals for one field' end as reason, n = 1 as accepted from (
  select *, count(*) over (partition by o_custkey, o_orderpriority) as n from orders)
""")
def q_repeated_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.reject_repeated(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderkey", "reason", "accepted")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Prior claims: orders up to 1995 and their price; decisions: three of four of them seen again, some changed, and new ones."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    prior = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("value_json"), F.lit("str").alias("value_type"), F.when(k % 11 == 0, "failed").otherwise("available").alias("availability"), F.when(k % 11 == 0, "earlier failure").alias("reason"), F.array(F.concat(F.lit("p"), k)).alias("evidence_ids"), F.col("o_orderdate").alias("retrieved_at"), F.lit("2020").alias("first_observed_at"), F.lit("2021").alias("last_observed_at"))
    bad = k % 5 == 0
    seen = o.where("o_orderkey % 4 <> 0").select("o_orderkey", (~bad).alias("accepted"), (k % 10 == 0).alias("withdrawn"), F.lit(None).cast("string").alias("availability"), F.when(bad, "absent_in_frozen_row").alias("reason"), F.when(k % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("value_json"), F.lit("str").alias("value_type"), F.concat(F.lit("d"), k).alias("evidence_id"), F.when(k % 13 == 0, F.col("o_orderdate") - F.expr("interval 1 day")).otherwise(F.col("o_orderdate")).alias("retrieved_at"))
    return prior, seen


_MERGE = """
with p as (select o_orderkey as k, o_orderstatus as v, o_orderkey % 11 <> 0 as avail, o_orderdate as t from orders where o_orderkey % 3 <> 0),
d as (select o_orderkey as k, o_orderkey % 5 <> 0 as ok, o_orderkey % 10 = 0 as gone, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as v,
  case when o_orderkey % 13 = 0 then o_orderdate - interval 1 day else o_orderdate end as t from orders where o_orderkey % 4 <> 0),
m as (select coalesce(p.k, d.k) as o_orderkey, p.v as pv, d.v as dv, p.avail,
  case when d.k is null then 'carried' when not d.ok and p.avail and d.gone then 'withdrawn' when not d.ok and p.avail then 'stale' when not d.ok then 'unavailable'
  when p.avail and d.t < p.t then 'older' when p.avail and p.v = d.v then 'confirmed' when p.avail then 'changed' else 'new' end as outcome
  from p full join d on p.k = d.k)
"""


@query(
    _MERGE
    + """
select o_orderkey, outcome, case when outcome in ('new', 'confirmed', 'changed') then dv when outcome in ('carried', 'stale', 'older') then pv end as value_json,
  case when outcome in ('new', 'confirmed', 'changed') then 'available' when outcome = 'carried' then case when avail then 'available' else 'failed' end when outcome in ('stale', 'older') then 'available' else 'not_available' end as availability,
  case when outcome = 'carried' and not avail then 'earlier failure' when outcome in ('withdrawn', 'unavailable') then 'absent_in_frozen_row' end as reason,
  case when outcome = 'confirmed' then 'p' || o_orderkey || ',d' || o_orderkey when outcome in ('new', 'changed') then 'd' || o_orderkey when outcome in ('carried', 'stale', 'older') then 'p' || o_orderkey else '' end as evidence,
  case when outcome = 'stale' then 'stale_after_failed_observation' end as freshness,
  case when outcome = 'stale' then 'absent_in_frozen_row' when outcome = 'older' then 'older_source_cannot_replace_newer_support' end as current_attempt_reason,
  case when outcome in ('confirmed', 'carried', 'stale', 'older') then '2020' when outcome in ('new', 'changed') then '2026' end as first_observed_at,
  case when outcome in ('new', 'confirmed', 'changed') then '2026' when outcome in ('carried', 'stale', 'older') then '2021' end as last_observed_at from m
"""
)
def q_refresh_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["o_orderkey"]
    out = refresh.claims(refresh.merge(*_snapshots(spark, sf_dir), "2026", key), key)
    return out.withColumn("evidence", F.concat_ws(",", "evidence_ids")).drop("evidence_ids", "value_type")


@query(
    _MERGE
    + """
select o_orderkey, case when outcome = 'withdrawn' then 'current_support_lost' else 'value_changed' end as kind, pv as old_value, case when outcome = 'changed' then dv end as new_value,
  'p' || o_orderkey as old_evidence, case when outcome = 'changed' then 'd' || o_orderkey else '' end as new_evidence, '2026' as observed_at from m where outcome in ('changed', 'withdrawn')
"""
)
def q_refresh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["o_orderkey"]
    out = refresh.changes(refresh.merge(*_snapshots(spark, sf_dir), "2026", key), key)
    return out.select("o_orderkey", "kind", "old_value", "new_value", F.concat_ws(",", "old_evidence_ids").alias("old_evidence"), F.concat_ws(",", "new_evidence_ids").alias("new_evidence"), "observed_at")


@query(_MERGE + "select o_orderkey, pv as value_json, 'str' as value_type, '2020' as first_observed_at, '2021' as last_observed_at from m where outcome in ('changed', 'withdrawn')")
def q_refresh_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["o_orderkey"]
    return refresh.history(refresh.merge(*_snapshots(spark, sf_dir), "2026", key), key).drop("evidence_ids")


@query(_MERGE + "select outcome, count(*) as n from m group by 1")
def q_refresh_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.merge(*_snapshots(spark, sf_dir), "2026", ["o_orderkey"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""
select o_orderkey, o_orderkey % 6 = 1 as withdrawn, 'not observed in the current run' as reason from orders
where o_orderkey % 3 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 4 = 0
""")
def q_missing_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, seen = _snapshots(spark, sf_dir)
    return refresh.missing_observations(prior, seen, ["o_orderkey"], F.col("o_orderkey") % 6 == 1).select("o_orderkey", "withdrawn", "reason")


@query("""
select 'part' as side, l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 50 <> 0)
union all select 'supplier', l_orderkey, l_linenumber from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 20 <> 0)
""")
def q_dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts, suppliers = table(spark, sf_dir, "part").where("p_partkey % 50 <> 0"), table(spark, sf_dir, "supplier").where("s_suppkey % 20 <> 0")
    a = constraints.dangling(lines, "l_partkey", parts, "p_partkey").select(F.lit("part").alias("side"), "l_orderkey", "l_linenumber")
    return a.unionAll(constraints.dangling(lines, "l_suppkey", suppliers, "s_suppkey").select(F.lit("supplier").alias("side"), "l_orderkey", "l_linenumber"))


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def q_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.unreferenced(table(spark, sf_dir, "part"), "p_partkey", table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_partkey").select("p_partkey")


@query("select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2 having count(*) > 1")
def q_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.repeated(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


_FAULTS = {
    0: ["subject: has a terminal row"], 1: ["evidence: https source"], 2: ["claim: available if and only if it has evidence", "evidence: is cited"], 3: ["claim: evidence exists", "evidence: is cited"],
    4: ["run: times in order"], 5: ["claim: a reason unless available"],
}


@query("select c_custkey::varchar as subject, unnest(case c_custkey % 7 " + " ".join(f"when {k} then {v!r}" for k, v in _FAULTS.items()) + " else [] end) as rule from customer")
def q_envelope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope for each customer with a claim that is available and one that failed; six of seven have a planted fault."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("subject"), "c_name", (F.col("c_custkey") % 7).alias("fault"))
    fault = lambda k, bad, good: F.when(F.col("fault") == k, bad).otherwise(good)
    text = lambda x: F.lit(x).cast("string")
    none = F.array().cast("array<string>")
    claim = lambda field, value, state, reason, ids: F.struct(F.lit(field).alias("field"), F.sha2(F.concat("subject", F.lit(field)), 256).alias("claim_id"), value.alias("value_json"), F.lit(state).alias("availability"), reason.alias("reason"), ids.alias("evidence_ids"))
    ids = F.when(F.col("fault") == 2, none).otherwise(F.array(fault(3, F.lit("e9"), F.lit("e1"))))
    both = F.array(claim("legal_name", F.to_json(F.array("c_name")), "available", text(None), ids), claim("staff", text(None), "failed", fault(5, text(None), text("no answer")), none))
    claims_ = c.select("subject", "c_name", "fault", F.inline(both)).select("subject", "field", "claim_id", "value_json", "availability", "reason", "evidence_ids")
    at = text("2026-01-02T00:00:00Z")
    evidence = c.select("subject", F.lit("e1").alias("id"), fault(1, text("http://a.no/"), text("https://a.no/")).alias("source_url"), at.alias("retrieved_at"), F.sha2("c_name", 256).alias("content_sha256"), F.col("c_name").alias("claim_span"))
    changes = spark.createDataFrame([], "subject string, claim_id string, kind string, old_value string, new_value string, observed_at string")
    runs = c.where("fault <> 0").select("subject", at.alias("started_at"), fault(4, text("2026-01-01T00:00:00Z"), text("2026-01-03T00:00:00Z")).alias("completed_at"), F.lit("completed").alias("terminal_status"))
    return envelope.envelope_violations(c.select("subject"), claims_, evidence, changes, runs)


@query("""
select event_id, case when list_contains(json_keys(props), 'k') then '' else 'k' end as missing, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') as unknown from events
""")
def q_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    out = constraints.key_sets(rows, F.json_object_keys("props"), ["k"])
    return out.select("event_id", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", F.sort_array("unknown")).alias("unknown"))


@query("""
with a as (select row_number() over (order by c_custkey) as pos, c_custkey from customer), b as (select row_number() over (order by c_custkey) as pos, c_custkey from customer where c_custkey <> 10)
select coalesce(a.pos, b.pos) as pos, coalesce(a.c_custkey, -1) as a, coalesce(b.c_custkey, -1) as b from a full join b on a.pos = b.pos where a.c_custkey is distinct from b.c_custkey
""")
def q_same_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "customer").select("c_custkey")
    number = lambda df: df.withColumn("pos", F.row_number().over(Window.orderBy("c_custkey")).cast("long"))
    return constraints.same_order(number(rows), number(rows.where("c_custkey <> 10")), "pos", "c_custkey").fillna(-1)


@query("""
select c_custkey, sha256('["' || c_custkey || '","legal_name","frozen_registry",null,null]') as claim_id, sha256('["' || c_custkey || '","legal_name","frozen_registry","' || c_nationkey || '",null]') as item_claim_id from customer
""")
def q_claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.functions.jsonx import claim_id

    subject = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", claim_id(subject, F.lit("legal_name"), F.lit("frozen_registry")).alias("claim_id"), claim_id(subject, F.lit("legal_name"), F.lit("frozen_registry"), F.col("c_nationkey").cast("string")).alias("item_claim_id"))


@query("""
select c_custkey, count(*) as claims, count(*) filter (where v is not null and v <> '""') as available, sha256(string_agg(field || '=' || coalesce(v, ''), ';' order by field)) as content from (
  select c_custkey, 'legal_name' as field, '"' || c_name || '"' as v from customer union all select c_custkey, 'nation', c_nationkey::varchar from customer
  union all select c_custkey, 'segment', '"' || c_mktsegment || '"' from customer) group by 1
""")
def q_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows to envelopes: candidates, reasons, one decision per slot, a digest of each company's claims."""
    rows = customer_candidates(spark, sf_dir).where("field <> 'balance'")
    checked = claims.check(rows, [("absent_in_frozen_row", F.col("value_json").isNotNull()), ("blank value", F.col("value_json") != '""')])
    decided = claims.unique_decisions(checked, ["c_custkey", "field"], "pos")
    line = F.concat("field", F.lit("="), F.coalesce("value_json", F.lit("")))
    out = decided.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("claims"), F.count_if("accepted").alias("available"), F.sort_array(F.collect_list(F.struct("field", line.alias("line")))).alias("lines"))  # a company's fields: few
    return out.select("c_custkey", "claims", "available", F.sha2(F.concat_ws(";", F.col("lines.line")), 256).alias("content"))
