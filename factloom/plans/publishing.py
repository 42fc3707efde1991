"""Published shapes, and extraction over the fixture pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import extract
from factloom.operators import claims, render
from factloom.plans.registry import registrar
from factloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query("select s_suppkey, case s_suppkey % 3 when 0 then 'official_website' when 1 then 'dated_news' else 'legal_name' end as field, case when s_suppkey % 5 = 0 then 0.0 when s_suppkey % 3 = 2 then 1.0 when s_suppkey % 3 = 0 then 0.9 when s_suppkey % 2 = 0 then 0.9 else 0.8 end::double as confidence from supplier")
def q_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 3 == 0, "verified_website").when(k % 3 == 1, "dated_news").otherwise("legal_name").alias("field"), F.when(k % 3 == 0, "registry_declared_host_name_gate").when(k % 3 == 1, "company_owned_html").otherwise("frozen_registry").alias("scope"), F.when(k % 5 == 0, "failed").otherwise("available").alias("a"), F.when(k % 2 == 0, '{"published_at":"2026-01-01T10:00:00Z"}').otherwise('{"published_at":"2026-01-01"}').alias("v"))
    return rows.select("s_suppkey", render.public_name(F.col("field")).alias("field"), render.confidence(F.col("field"), F.col("scope"), F.col("a"), F.col("v")).alias("confidence"))


@query("select c_custkey, family, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority[1] = n::varchar) then 'covered' else 'unknown' end as status from customer, (values ('people', 1), ('business_products', 2), ('jobs_dated_activity', 5)) f(family, n)")
def q_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = {"1": "people", "2": "business_products", "5": "jobs_dated_activity"}
    digit = F.substring("o_orderpriority", 1, 1)
    covered = table(spark, sf_dir, "orders").where(digit.isin(*families)).select(F.col("o_custkey").alias("c_custkey"), F.coalesce(*(F.when(digit == k, v) for k, v in families.items())).alias("family"))
    return render.opportunities(covered, table(spark, sf_dir, "customer"), "c_custkey", tuple(families.values()))


@query("""select c_custkey as pos, c_custkey, case when c_custkey % 4 = 0 then '{"c_custkey":' || c_custkey || ',"claims":[],"terminal_status":"failed"}' else '{"c_custkey":' || c_custkey || ',"claims":[{"field":"legal_name","value_json":"\\"' || c_name || '\\""},{"field":"nation","value_json":"' || c_nationkey || '"}],"terminal_status":"completed"}' end as envelope from customer""")
def q_envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = claims.unpivot(c.where("c_custkey % 4 <> 0"), ["c_custkey"], {"legal_name": "c_name", "nation": "c_nationkey"}).select("c_custkey", "field", "value_json")
    return render.envelopes(rows, c.select(F.col("c_custkey").alias("pos"), "c_custkey"), "c_custkey", "pos")


@query("select c_custkey, c_name as name, c_nationkey || ', ' || c_mktsegment as place from customer")
def q_display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    place = F.to_json(F.struct(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b")))
    return c.select("c_custkey", render.display(F.concat(F.lit('"'), "c_name", F.lit('"'))).alias("name"), render.display(place).alias("place"))


@query("select r_regionkey || '.html' as path, '<!doctype html><meta charset=\"utf-8\"><title>' || r_regionkey || '</title><ul><li>Legal name: ' || r_name || ' &amp; co [1]</li></ul>' as body from region")
def q_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.lit("legal_name").alias("field"), F.concat("r_name", F.lit(" & co")).alias("shown"), F.lit("available").alias("availability"))
    return render.pages(rows, "r_regionkey")


@query()
def q_page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route over the fixture pages, which hold no registry facts: golden pages are in the tests."""
    pages = table(spark, sf_dir, "pages").select(F.lpad(F.col("page_id").cast("string"), 9, "9").alias("subject"), F.lit("Example Pumps AS").alias("name"), F.regexp_replace("url", "^http:", "https:").alias("url"), F.try_parse_url("url", F.lit("HOST")).alias("registered"), "html")
    found = extract.extract(pages, "2026-01-01")
    return extract.audit(found, pages).select("subject", "route", "field", "accepted", "supported", "reason")
