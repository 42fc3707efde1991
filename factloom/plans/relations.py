"""Lookup, bridge, suffix and interval joins, set operations, rank-limited and ordered results over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import joins, windows
from factloom.plans.registry import registrar
from factloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

WANTED = "(select distinct o_custkey as c_custkey from orders where o_totalprice > 200000 union select -1)"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).union(spark.range(1).select((F.col("id") - 1).alias("c_custkey"))).distinct()


@query(f"select c_custkey, c_name, c_mktsegment from customer where c_custkey in (select c_custkey from {WANTED})")
def q_registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.lookup(_wanted(spark, sf_dir), table(spark, sf_dir, "customer"), "c_custkey")[0].select("c_custkey", "c_name", "c_mktsegment")


@query(f"select c_custkey from {WANTED} where c_custkey not in (select c_custkey from customer)")
def q_registry_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.lookup(_wanted(spark, sf_dir), table(spark, sf_dir, "customer"), "c_custkey")[1]


@query("""
select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1 and event_type <> 'error'
""")
def q_feed_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_event(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id", "event_type")


@query("select o_custkey, o_orderkey, k::int as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 3")
def q_top3_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) <= 200)")
def q_at_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.at_most(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], 200, "too many lines in an order")


@query("select l_partkey, min(l_orderkey * 10 + l_linenumber) as pos, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) as l_suppkey from lineitem group by 1")
def q_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")  # of rows at one place the SQL keeps the first it reads
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), *stored)
    return windows.first_seen(lines, ["l_partkey"], "pos", ["file", "row"])


@query("""
with e as (select *, row_number() over (partition by user_id, event_type order by event_id) as turn from events)
select user_id, event_id, turn::int as turn, row_number() over (partition by user_id order by turn, event_type, event_id)::int as place from e
""")
def q_round_robin_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.round_robin(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_type"), "event_id").select("user_id", "event_id", "turn", "place")


_PRIORITY = "case when p_type like '%BRASS%' then 0 when p_type like '%STEEL%' then 1 when p_type like '%TIN%' then 2 else 3 end"


@query(f"select p_partkey, {_PRIORITY} as priority, row_number() over (partition by p_brand order by {_PRIORITY}, p_partkey)::int as place from part")
def q_priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.by_priority(table(spark, sf_dir, "part"), ["p_brand"], F.expr(_PRIORITY), "p_partkey").select("p_partkey", "priority", "place")


@query("select c_custkey, sha256('development:' || c_custkey) as digest from customer order by 2 limit 100")
def q_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hash_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "development", 100)


@query("""
with y as (select o_custkey, year(o_orderdate)::int as y, round(sum(o_totalprice), 2) as total from orders group by 1, 2),
w as (select *, lag(total) over (partition by o_custkey order by y) as previous, row_number() over (partition by o_custkey order by y desc) as k from y)
select o_custkey, y, previous, total as current from w where k = 1 and previous is not null
""")
def q_revenue_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return windows.trend(yearly, ["o_custkey"], ["y"], "total")


@query("""
with c as (select p_brand, p_partkey, p_size, length(p_name)::int as len from part)
select p_brand, m['p'] as p_partkey, m['s'] as p_size, m['len'] as len from (select p_brand, min({'s': p_size, 'len': len, 'p': p_partkey}) as m from c group by 1)
""")
def q_smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.length("p_name").alias("len"))
    return windows.smallest(rows, ["p_brand"], ["p_size", "len", "p_partkey"])


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey)::int as round from lineitem")
def q_breadth_first_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rounds(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).drop("l_partkey")


@query("select c_custkey as pos, c_custkey, o.n, o.c is null as failed from customer left join (select o_custkey as c, count(*) as n from orders group by 1) o on o.c = c_custkey")
def q_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), "c_custkey")
    done = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return windows.in_input_order(done, inputs, "c_custkey", "pos")


_HOST = "regexp_extract(url, '://([^/:?#]+)', 1)"


@query(f"select page_id, {_HOST} as host from pages where {_HOST} = 'example.net' or {_HOST} like '%.example.net' or {_HOST} like '%.tionble.example.com' or {_HOST} = 'tionble.example.com'")
def q_domain_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"))
    domains = spark.createDataFrame([("example.net",), ("tionble.example.com",)], "domain string")
    return joins.suffix_join(rows, "host", domains, "domain")


@query("select o_orderkey from orders where o_orderdate <= timestamp '1996-06-01' and timestamp '1996-06-01' <= o_orderdate + interval 30 day")
def q_posting_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = F.expr("timestamp_ntz '1996-06-01 00:00:00'")
    return table(spark, sf_dir, "orders").where((F.col("o_orderdate") <= cutoff) & (cutoff <= F.col("o_orderdate") + F.expr("interval 30 days"))).select("o_orderkey")


@query("""
select n_nationkey, c_custkey, 'own' as via from customer join nation on c_nationkey = n_nationkey where n_nationkey % 4 = 0
union all select p.n_nationkey, c_custkey, 'bridge' from customer join nation c on c_nationkey = c.n_nationkey join nation p on p.n_nationkey = c.n_regionkey * 4
where p.n_nationkey % 4 = 0 and p.n_nationkey <> c.n_nationkey
""")
def q_employer_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    postings = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("org"))
    bridges = nation.select(F.col("n_nationkey").alias("child"), (F.col("n_regionkey") * 4).alias("parent"))
    return joins.bridge(postings, "org", bridges, "child", "parent", nation.where("n_nationkey % 4 = 0"), "n_nationkey").select("n_nationkey", "c_custkey", "via")


_GOLD = "select item_id, substr(text, 1, 40) as head from benchmark"
_STANDS = "length(head) = 40 and exists (select 1 from documents d where contains(d.text, head))"


def _heads(spark: SparkSession, sf_dir: str, gold: DataFrame) -> DataFrame:
    """The gold heads that stand anywhere in the whole texts."""
    return joins.windows_among(table(spark, sf_dir, "documents"), "text", gold, "head", 40)


@query(f"select item_id, head from ({_GOLD}) where {_STANDS}")
def q_gold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 40).alias("head"))
    return joins.gold_match(gold, _heads(spark, sf_dir, gold), ["head"]).select("item_id", "head")


@query(f"select item_id, head from ({_GOLD}) where not ({_STANDS})")
def q_gold_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 40).alias("head"))
    return joins.gold_match(gold, _heads(spark, sf_dir, gold), ["head"], matched=False).select("item_id", "head")


_INTERVALS = "(select conv_id, turn as s, turn + length(text) % 5 as e from conversations)"


@query(f"select a.conv_id, a.s as in_start, a.e as in_end, b.s as out_start, b.e as out_end from {_INTERVALS} a join {_INTERVALS} b on a.conv_id = b.conv_id where b.s < a.s and a.e < b.e")
def q_interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("s"), (F.col("turn") + F.length("text") % 5).alias("e"))
    return joins.containment(t, t, ["conv_id"], "s", "e")


@query("select doc_id, (quality = 1)::boolean as control, (toxic = 0)::boolean as challenger from labels")
def q_paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels")
    return joins.paired(t.select("doc_id", (F.col("quality") == 1).alias("outcome")), t.select("doc_id", (F.col("toxic") == 0).alias("outcome")), "doc_id")


@query("""
select n_nationkey as snapshot_id, n_name as name, a.n_name as anchor_name, r.n_name as robots_name from nation n left join nation a on a.n_nationkey = n.n_regionkey left join nation r on r.n_nationkey = n.n_nationkey - 20
""".replace("select n_nationkey", "select n.n_nationkey").replace("n_name as name", "n.n_name as name"))
def q_receipt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("snapshot_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("anchor_id"), (F.col("n_nationkey") - 20).alias("robots_id"))
    return joins.chain(receipts, ["anchor_id", "robots_id"]).select("snapshot_id", "name", F.col("anchor.name").alias("anchor_name"), F.col("robots.name").alias("robots_name"))


@query("select c_custkey, floor((c_custkey - 1) / 100)::bigint as shard from customer")
def q_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", joins.shard_of(F.col("c_custkey") - 1).alias("shard"))


@query("select 'overlap' as check, count(*) as n from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P') union all select 'only first', count(*) from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P')")
def q_cohort_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    return count(a.intersect(b), "overlap").unionAll(count(a.subtract(b), "only first"))


@query("""
select user_id, array_to_string(list_sort(list_filter(t, lambda x: x <> 'view')), ',') as others, len(t) = 1 and t[1] = 'view' as only_view, list_has_any(t, ['error', 'signup']) as overlaps
from (select user_id, list_sort(list(distinct event_type)) as t from events group by 1)
""")
def q_array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t"))  # event types: a bounded set
    view = F.array(F.lit("view"))
    return t.select("user_id", F.concat_ws(",", F.array_except("t", view)).alias("others"), (F.col("t") == view).alias("only_view"), F.arrays_overlap("t", F.array(F.lit("error"), F.lit("signup"))).alias("overlaps"))


@query("select l_orderkey, l_partkey from (select l_orderkey, l_partkey from lineitem where l_quantity > 10 except all select l_orderkey, l_partkey from lineitem where l_discount > 0.05)")
def q_expected_minus_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.where("l_quantity > 10").select("l_orderkey", "l_partkey").exceptAll(t.where("l_discount > 0.05").select("l_orderkey", "l_partkey"))


@query("""
select kind, key, name from (select 'customer' as kind, c_custkey as key, c_name as name, null::double as balance from customer where c_acctbal < 0
union all select 'supplier', s_suppkey, s_name, s_acctbal from supplier where s_suppkey % 2 = 0 and s_nationkey not in (select c_nationkey from customer where c_acctbal < -900))
""")
def q_gated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes unite by name, and a route counts only where a stronger one gave nothing."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    strong = c.where("c_acctbal < -900").select(F.col("c_nationkey").alias("s_nationkey"))
    weak = s.where("s_suppkey % 2 = 0").join(strong, "s_nationkey", "left_anti").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(weak, allowMissingColumns=True).drop("balance")
