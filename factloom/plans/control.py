"""Run control over the fixture tables: coverage, gaps, funnels, paired summaries, shard reports, messages, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import control
from factloom.plans.registry import registrar
from factloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_FIELD = "case o_orderkey % 5 when 0 then 'declared_website' when 1 then 'registered_role:board' when 2 then 'dated_news' when 3 then 'annual_net_profit' else 'legal_name' end"
_FAMILY = "case o_orderkey % 5 when 2 then 'jobs_dated_activity' when 3 then 'financials_history' when 0 then 'website_owned_profiles' end"
_COVERED = f"""select distinct o_custkey, coalesce(family, case when field like 'registered_role:%' then 'people' end) as family
from (select o_custkey, {_FIELD} as field, {_FAMILY} as family, o_orderstatus = 'F' as available from orders) where available and field not in ('declared_website', 'registered_activity', 'social_profile') and coalesce(family, case when field like 'registered_role:%' then 'people' end) is not null"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", F.expr(_FIELD).alias("field"), F.expr(_FAMILY).alias("family"), F.when(F.col("o_orderstatus") == "F", "available").otherwise("failed").alias("availability"))


@query(_COVERED)
def q_covered_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.covered_families(_claims(spark, sf_dir), "o_custkey")


_SOURCE = "case o_orderkey % 4 when 0 then 'brreg_roles' when 1 then 'nav_jobs' when 2 then 'company_owned' else 'other' end"


@query(f"""
with c as ({_COVERED}), f(family) as (values ('people'), ('financials_history'), ('operating_locations'), ('business_products'), ('website_owned_profiles'), ('jobs_dated_activity')),
r(source, family) as (values ('brreg_roles', 'people'), ('brreg_accounts', 'financials_history'), ('brreg_subunits', 'operating_locations'), ('nav_jobs', 'business_products'), ('nav_jobs', 'jobs_dated_activity'), ('company_owned', 'business_products'), ('company_owned', 'website_owned_profiles'), ('company_owned', 'jobs_dated_activity')),
a as (select o_custkey, family, max(o_orderkey) as k from (select *, {_SOURCE} as source from orders) join r using (source) group by 1, 2)
select c_custkey as o_custkey, f.family, case when a.k is null then 'failed' when k % 3 = 0 then 'not_available' else 'blocked' end as availability,
  case when a.k is null then 'Route not scheduled' when k % 3 = 0 then 'No supported fact in checked source' else 'reason ' || k % 7 end as reason
from customer cross join f left join a on a.o_custkey = c_custkey and a.family = f.family where not exists (select 1 from c where c.o_custkey = c_custkey and c.family = f.family)
""")
def q_route_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("o_orderkey") % 3 != 0
    attempts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(_SOURCE).alias("source"), F.when(some, "blocked").alias("availability"), F.when(some, F.concat(F.lit("reason "), (F.col("o_orderkey") % 7).cast("string"))).alias("reason"))
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return control.route_gaps(subjects, control.covered_families(_claims(spark, sf_dir), "o_custkey"), attempts, "o_custkey", "o_orderkey")


@query("""
select event_type, sum(event_id % 4)::bigint as candidate_domains, sum(event_id % 3)::bigint as candidate_pages_retrieved, sum(event_id % 2)::bigint as candidate_identity_rejections,
  count(*) as companies_attempted, count(*) filter (where event_id % 4 = 0) as companies_with_no_candidate, count(*) filter (where event_id % 3 = 0) as companies_with_no_acquired_page from events group by 1
""")
def q_website_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", (e % 4).alias("candidate_domains"), (e % 3).alias("candidate_pages_retrieved"), (e % 2).alias("candidate_identity_rejections"))
    return control.funnel(rows, ["event_type"])


@query("""
select doc_id % 4 as family, count(*) as n, count(*) filter (where quality = 1) as control_covered, count(*) filter (where toxic = 0) as challenger_covered, count(*) filter (where quality <> 1 and toxic = 0) as gains, count(*) filter (where quality = 1 and toxic <> 0) as losses,
  count(*) filter (where quality <> 1 and toxic = 0) - count(*) filter (where quality = 1 and toxic <> 0) as net, round(100.0 * (count(*) filter (where quality <> 1 and toxic = 0) - count(*) filter (where quality = 1 and toxic <> 0)) / count(*), 9)::double as gain_pp from labels group by 1
""")
def q_paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and net gain; the interval is held against its definition in the tests."""
    pairs = table(spark, sf_dir, "labels").select((F.col("doc_id") % 4).alias("family"), (F.col("quality") == 1).alias("control"), (F.col("toxic") == 0).alias("challenger"))
    return control.paired_summary(pairs, ["family"]).select("family", "n", "control_covered", "challenger_covered", "gains", "losses", "net", F.round("gain_pp", 9).alias("gain_pp"))


@query("select c_custkey, family, exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority[1] = n) as covered from customer, (values ('people', '1', 2), ('business_products', '2', 3)) f(family, n, m) where c_custkey % m = 0")
def q_family_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    positives = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("people").alias("family")).unionAll(c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("business_products").alias("family")))
    digit = F.substring("o_orderpriority", 1, 1)
    seen = o.select(F.col("o_custkey").alias("c_custkey"), F.when(digit == "1", "people").when(digit == "2", "business_products").alias("family")).where("family is not null")
    return control.outcomes(positives, seen, "c_custkey")


@query("""
with s as (select (c_custkey - 1) // 100 as shard, count(*) as n, sum((c_acctbal < -990)::int) as f from customer where c_custkey > 0 group by 1)
select count(*) as shards, sum(f)::bigint as failed_companies, sum(n)::bigint as companies, '' as missing, case when sum(f) = 0 then 'completed' else 'failed' end as status from s
""")
def q_merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey > 0")
    reports = c.groupBy(F.expr("cast((c_custkey - 1) div 100 as int)").alias("shard")).agg(F.count(F.lit(1)).alias("companies"), F.sum((F.col("c_acctbal") < -990).cast("long")).alias("failed_companies"))
    expected = reports.agg(F.max("shard")).first()[0] + 1
    return control.merged_reports(reports, expected, ["companies"])


@query("select c_custkey as pos, c_custkey, c_name as line from customer")
def q_aggregate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return control.aggregate(c.select("c_custkey", F.col("c_name").alias("line")), c.select(F.col("c_custkey").alias("pos"), "c_custkey"), "c_custkey", "pos", "line")


@query("""
with m as (select user_id, event_id, case when event_type = 'purchase' then 'terminal' else 'checkpoint' end as kind from events where event_type <> 'error'),
l as (select user_id, max({'t': kind = 'terminal', 'e': event_id}) as b from m group by 1)
select user_id, case when b['t'] then 'completed' else 'interrupted' end as status, b['e'] as body from l
""")
def q_last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "terminal").when(F.col("event_type") == "error", "noise").otherwise("checkpoint")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), F.col("event_id").alias("body"))
    return control.last_messages(rows, "user_id", "event_id")


@query("""
with c as (select o_custkey, o_orderkey, case o_orderkey % 3 when 0 then 'verified_website' when 1 then 'legal_name' else 'other' end as field, o_orderstatus = 'F' as ok from orders),
k as (select o_custkey, field, min({'l': not ok, 'o': o_orderkey}) as b from c where field <> 'other' group by 1, 2)
select s.o_custkey, f.field, case when k.b is null then 'not_available' when k.b['l'] then 'failed' else 'available' end as availability, case when not k.b['l'] then 'class ' || k.b['o'] % 2 else f.kind end as source_class,
  case when not k.b['l'] then k.b['o']::varchar end as value_json, case when k.b is null then 'No supported claim' when k.b['l'] then 'reason ' || k.b['o'] end as reason, case when not k.b['l'] then 'sha' || k.b['o'] end as content_sha256
from (select distinct o_custkey from orders) s cross join (values ('official_website', 'verified_website', 'company_owned'), ('registry_live', 'legal_name', 'frozen_registry')) f(field, own, kind) left join k on k.o_custkey = s.o_custkey and k.field = f.own
""")
def q_module_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, ok = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    field = F.when(k % 3 == 0, "verified_website").when(k % 3 == 1, "legal_name").otherwise("other")
    claims = o.select("o_custkey", "o_orderkey", field.alias("field"), k.cast("string").alias("value_json"), F.when(ok, "available").otherwise("failed").alias("availability"), F.concat(F.lit("reason "), k.cast("string")).alias("reason"), F.array(k.cast("string")).alias("evidence_ids"))
    evidence = o.select("o_custkey", k.cast("string").alias("id"), F.concat(F.lit("class "), (k % 2).cast("string")).alias("source_class"), F.lit("https://a.no/").alias("source_url"), F.lit("t").alias("retrieved_at"), F.concat(F.lit("sha"), k.cast("string")).alias("content_sha256"))
    fields = {"official_website": ("verified_website", "company_owned"), "registry_live": ("legal_name", "frozen_registry")}
    out = control.module_records(claims, evidence, "o_custkey", fields, "o_orderkey")
    return out.select("o_custkey", "field", "availability", "source_class", "value_json", "reason", "content_sha256")


@query("select c_custkey, case when c_custkey % 3 = 0 then n_name else c_name end as name, case when c_custkey % 3 = 0 then '' else 'www' || c_custkey end as website, case when c_custkey % 3 = 0 then 'brreg_entity' else 'frozen_registry' end as source from customer join nation on n_nationkey = c_nationkey")
def q_legal_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    registry = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("www"), F.col("c_custkey").cast("string")).alias("website"), F.lit(None).cast("string").alias("email"))
    entities = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("name"), F.lit(None).cast("string").alias("website"), F.lit("a@b.no").alias("email"))
    return control.anchors(registry, entities, c, "c_custkey").select("c_custkey", "name", "website", "source")
