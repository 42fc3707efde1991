"""Evaluation aggregates, samples and exact statistics over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.stats import interval, mcnemar_p
from factloom.operators import metrics, sample, windows
from factloom.plans.registry import registrar
from factloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query("""
select event_type, quantile_disc(value, 0.5)::double as p50, quantile_disc(value, 0.95)::double as p95, list_sort(list(value))[(count(*) // 2 + 1)::bigint]::double as upper_median
from events where value is not null group by 1
""")
def q_nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value is not null")
    return rows.groupBy("event_type").agg(metrics.nearest_rank("value", 0.5).alias("p50"), metrics.nearest_rank("value", 0.95).alias("p95"), metrics.upper_median("value").alias("upper_median"))


@query("""
with g as (select event_type, count(*) as attempts, sum((value > 50)::int)::bigint as gains, sum((value > 20)::int)::bigint as unique_facts, sum(1 + event_id % 3)::bigint as requests, count(distinct user_id % 6) as novelty from events group by 1)
select event_type, attempts, gains, unique_facts, requests, novelty, round((gains + 1) / (attempts + 2), 9) as expected, round(greatest(1.0, requests / attempts), 9) as cost,
  round(novelty * ((gains + 1) / (attempts + 2)) / greatest(1.0, requests / attempts), 9) as priority from g
""")
def q_planner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("value") > 50).cast("int").alias("g"), (F.col("value") > 20).cast("int").alias("f"), (1 + F.col("event_id") % 3).alias("r"))
    out = metrics.planner_scores(rows, "event_type", "g", "f", "r", F.count_distinct(F.col("user_id") % 6))
    return out.withColumns({c: F.round(c, 9) for c in ("expected", "cost", "priority")})


@query("""
with r as (select d.lang, d.doc_id, l.quality = 1 as pos, l.toxic = 0 as cov, d.n_chars > 1000 as hit from labels l join documents d using (doc_id)),
g as (select lang, count(distinct case when pos then doc_id end) as pc, count(distinct case when pos and cov then doc_id end) as cc, count(*) filter (where pos) as chk, count(*) filter (where pos and hit) as mat from r group by 1)
select lang, pc as positive_companies, cc as covered_companies, chk as checked_claims, mat as matched_claims, round(cc / nullif(pc, 0), 9) as company_recall, round(mat / nullif(chk, 0), 9) as claim_recall,
  round(0.7 * (cc / nullif(pc, 0)) + 0.3 * (mat / nullif(chk, 0)), 9) as mixture, case when pc = 0 or chk = 0 then 'not_measured' else 'measured' end as state from g
""")
def q_family_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = metrics.family_metric(rows, "lang", "doc_id", F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars") > 1000)
    return out.withColumns({c: F.round(c, 9) for c in ("company_recall", "claim_recall", "mixture")})


_STAGES = [("discovery", "event_type = 'error'"), ("acquisition", "value < 10"), ("extraction", "user_id % 7 = 0"), ("publication", "value > 90")]


@query("select event_type, case " + " ".join(f"when {c} then '{n}'" for n, c in _STAGES) + " else 'none' end as stage, count(*) as n from events group by 1, 2")
def q_failure_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stage_counts(table(spark, sf_dir, "events"), [(n, F.expr(c)) for n, c in _STAGES], ["event_type"])


@query("""
with x as (select l_orderkey, l_returnflag, min(l_quantity) as lo, max(l_quantity) as hi from lineitem where l_linenumber <= 2 group by 1, 2),
e as (select l_orderkey, l_returnflag, lo as e from x where lo = hi), p as (select l_orderkey, l_returnflag, min(l_quantity) as p from lineitem group by 1, 2),
q as (select p.* from p anti join (select * from x where lo <> hi) c using (l_orderkey, l_returnflag)),
b as (select coalesce(e.l_returnflag, q.l_returnflag) as l_returnflag, e.e, q.p from e full join q on e.l_orderkey = q.l_orderkey and e.l_returnflag = q.l_returnflag)
select l_returnflag, count(e) as expected, count(*) filter (where e = p) as correct, count(*) filter (where e is not null and e is distinct from p) as missing,
  count(*) filter (where p is not null and e is distinct from p) as unsupported, round(count(*) filter (where e = p) / nullif(count(e), 0), 9) as coverage from b group by 1
""")
def q_accounts_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    published = lines.groupBy("l_orderkey", "l_returnflag").agg(F.min("l_quantity").alias("l_quantity"))
    return metrics.compare_accounts(lines.where("l_linenumber <= 2"), published, ["l_orderkey"], "l_returnflag", "l_quantity").withColumn("coverage", F.round("coverage", 9))


_STATE = "case event_id % 6 when 0 then 'available' when 1 then 'blocked' when 2 then 'failed' when 3 then 'ambiguous' when 4 then 'not_available' else 'not_applicable' end"


@query(f"""
with s as (select user_id, {_STATE} as a from events), g as (select user_id, bool_or(a = 'available') as ok, min(case a when 'blocked' then 0 when 'failed' then 1 when 'ambiguous' then 2 when 'not_available' then 3 when 'not_applicable' then 4 else 5 end) as w from s group by 1)
select user_id, case when ok then 'complete' else ['blocked', 'failed', 'ambiguous', 'not_available', 'not_applicable', 'not_applicable'][w + 1] end as state from g
""")
def q_module_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.module_state(table(spark, sf_dir, "events"), ["user_id"], F.expr(_STATE))


@query("select user_id, coalesce(arg_max(event_type, {'t': ts, 'e': event_type}), 'never') as latest from events group by 1")
def q_latest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", "never")


@query("select l_orderkey, arg_min(l_partkey, {'s': l_shipmode, 'p': l_partkey}) as first from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem) group by 1")
def q_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("scope", F.concat("l_returnflag", "l_linestatus"))
    return metrics.first_value(rows, ["l_orderkey"], ["scope", "l_partkey"], "l_partkey")


@query("""
with g as (select user_id, bool_or(event_type = 'error') as errors, bool_or(value > 95) as high, bool_or(event_type = 'purchase') as buys from events group by 1)
select *, errors::int + high::int + buys::int as areas from g
""")
def q_area_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"errors": F.col("event_type") == "error", "high": F.col("value") > 95, "buys": F.col("event_type") == "purchase"}
    return metrics.flags(table(spark, sf_dir, "events"), ["user_id"], tests)


@query("""
select user_id, b['t'] as event_type, b['e'] as event_id from (select user_id, min({'x': value > 50, 'e': event_id, 't': event_type}) as b from events group by 1)
""")
def q_best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("value") > 50).alias("excluded"))
    return metrics.best_per_key(rows, ["user_id"], "excluded", "event_id").drop("excluded")


@query("select user_id, coalesce(string_agg(distinct event_type, ',' order by event_type) filter (where value > 30), '') as fields from events group by 1")
def q_supported_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.supported_fields(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("value") > 30)


@query("""
with r as (select o_orderstatus, 1::bigint as requests, o_orderkey % 5 as failed from orders)
select o_orderstatus, sum(requests)::bigint as requests, sum(failed)::bigint as failed from r group by 1 union all select null, sum(requests)::bigint, sum(failed)::bigint from r
""")
def q_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.lit(1).cast("long").alias("requests"), (F.col("o_orderkey") % 5).alias("failed"))
    return metrics.totals(rows, ["o_orderstatus"], ["requests", "failed"])


@query("""
select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers, count(*) filter (where l_discount = 0) as no_discount, sum(round(l_extendedprice * (1 - l_discount) * 100)::bigint)::bigint as cents
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2
""")
def q_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_discount") == 0).alias("no_discount"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")).alias("cents"))


_QUOTA = """
with s as (select c_mktsegment, c_nationkey % 3 as nat, count(*) as n from customer group by 1, 2),
q as (select *, (97 * n) // sum(n) over () as base, (97 * n) % sum(n) over () as rest from s),
r as (select *, 97 - sum(base) over () as spare, row_number() over (order by rest desc, c_mktsegment, nat) as k from q)
"""


@query(_QUOTA + "select c_mktsegment, nat, n, (base + (k <= spare)::int)::bigint as quota from r")
def q_stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("nat", F.col("c_nationkey") % 3)
    return sample.quotas(rows, ["c_mktsegment", "nat"], 97)


@query(_QUOTA + """
select c_custkey, digest from (select c_custkey, c_mktsegment, c_nationkey % 3 as nat, sha256('s:' || c_custkey) as digest, row_number() over (partition by c_mktsegment, c_nationkey % 3 order by sha256('s:' || c_custkey)) as rk from customer) c
join r using (c_mktsegment, nat) where rk <= base + (k <= spare)::int
""")
def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("nat", F.col("c_nationkey") % 3)
    return sample.stratified(rows, "c_custkey", ["c_mktsegment", "nat"], 97, "s").select("c_custkey", "digest")


@query("""
with c as (select c_custkey, c_mktsegment, sha256('t:' || c_custkey) as digest from customer),
q as (select *, (row_number() over (partition by c_mktsegment order by digest) - 0.5) / count(*) over (partition by c_mktsegment) as q from c),
a as (select *, row_number() over (order by q, digest) as spot from q)
select c_custkey, (case when spot <= 20 then 0 when spot <= 40 then 1 when spot <= 100 then 2 else -1 end)::int as part from a
""")
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return sample.split(rows, "c_custkey", ["c_mktsegment"], [20, 20, 60], "t").select("c_custkey", F.coalesce("part", F.lit(-1)).alias("part"))


@query("select c_custkey, case when n is null or n <= 0 then '0_unknown' when n < 10 then '1_9' when n < 50 then '10_49' else '50_plus' end as band from (select c_custkey, case when c_custkey % 5 <> 0 then c_custkey % 70 - 3 end as n from customer)")
def q_employee_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 70 - 3)
    return table(spark, sf_dir, "customer").select("c_custkey", sample.employee_band(n).alias("band"))


@query("""
with t as (select user_id % 8 as family, user_id, round((sum(event_id) % 997) / 997.0, 9) as p from events group by 1, 2),
s as (select *, (count(*) over (partition by family) - row_number() over (partition by family order by p) + 1) * p as step from t)
select family, user_id, round(least(1.0, max(step) over (partition by family order by p rows unbounded preceding)), 9) as adjusted from s
""")
def q_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("family"), "user_id").agg(F.round((F.sum("event_id") % 997) / 997.0, 9).alias("p"))
    return windows.holm(tests, "p", ["family"]).select("family", "user_id", F.round("adjusted", 9).alias("adjusted"))


@query("""
with d as (select doc_id % 5 as family, quality = 0 as a, toxic = 1 as b from labels), g as (select family, count(*) as n, count(*) filter (where not a and b) as gains, count(*) filter (where a and not b) as losses from d group by 1)
select family, gains, losses, gains - losses as net, round(100.0 * (gains - losses) / n, 9) as pp,
  round(least(1.0, 2 * (select sum(exp(lgamma(gains + losses + 1) - lgamma(k + 1) - lgamma(gains + losses - k + 1) - (gains + losses) * ln(2))) from (select unnest(range(0, least(gains, losses) + 1)) as k))), 6) as p from g
""")
def q_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("family"), (F.col("quality") == 0).alias("a"), (F.col("toxic") == 1).alias("b"))
    g = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a") & F.col("b")).alias("gains"), F.count_if(F.col("a") & ~F.col("b")).alias("losses"))
    net = F.col("gains") - F.col("losses")
    return g.select("family", "gains", "losses", net.alias("net"), F.round(100.0 * net / F.col("n"), 9).alias("pp"), F.round(mcnemar_p("gains", "losses"), 6).alias("p"))


_TAIL = "list_sum(list_transform(range({low}, {high}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"


@query(f"""
with recursive g as (select doc_id % 5 as family, count(*) filter (where toxic = 1) as k, count(*) as n from labels group by 1),
b as (select family, k, n, 0 as step, 0.0::double as a, 1.0::double as b, 0.0::double as c, 1.0::double as d from g
union all select family, k, n, step + 1, case when lower < 0.0025 then x else a end, case when lower < 0.0025 then b else x end, case when upper > 0.0025 then y else c end, case when upper > 0.0025 then d else y end
  from (select *, {_TAIL.format(low="k", high="n + 1", p="x")} as lower, {_TAIL.format(low="0", high="k + 1", p="y")} as upper from (select *, (a + b) / 2 as x, (c + d) / 2 as y from b where step < 50)))
select family, k, n, round(case when k = 0 then 0.0 else a end, 9)::double as low, round(case when k = n then 1.0 else d end, 9)::double as high from b where step = 50
""")
def q_clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).alias("family")).agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("family", "k", "n", interval("k", "n", F.lit(0.05 / 10)).alias("i")).select("family", "k", "n", F.round("i.low", 9).alias("low"), F.round("i.high", 9).alias("high"))
