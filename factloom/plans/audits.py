"""Audits of claims on planted bodies, with planted faults, over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import audits
from factloom.plans.registry import registrar
from factloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

#: Method, and what the fault planted in every third claim of it is.
_METHODS = [
    ("registry_row_v1", "the row does not say so"), ("official_accounts_v1", "the filing is another company's"), ("posting_employer_v1", "the posting is not active"), ("exact_identifier_jsonld_v1", "the object carries another number"),
    ("explicit_subject_html_v1", "the block has no number or another one"), ("registry_linked_business_statement_v1", "the statement quotes, doubts or asks"), ("social_profile_link_v1", "the handle does not hold the name"),
    ("registry_host_corroboration_v1", "the site is not the registered one"), ("career_role_link_v1", "the path is no career page's"), ("dated_article_datetime_v1", "the time does not stand in the span"), ("another_v9", "no auditor for the method"),
]


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, snapshots, subjects): a claim for each customer, the method by its key, every third with a fault, some bodies changed."""
    n = len(_METHODS)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("subject"), F.concat(F.lit("Firma "), F.col("c_custkey").cast("string"), F.lit(" AS")).alias("name"))
    c = c.withColumn("kind", F.col("c_custkey") % n).withColumn("bad", F.expr(f"(c_custkey div {n}) % 3 = 1")).withColumn("changed", F.expr(f"(c_custkey div {n}) % 5 = 2"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    subject, name, bad = F.col("subject"), F.col("name"), F.col("bad")
    # The next key's claim has another method, so no two claims of a method cite one body by this number, whatever the keys.
    other = F.when(bad, F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0")).otherwise(subject)
    pick = lambda good, wrong: F.when(bad, F.lit(wrong)).otherwise(F.lit(good))
    short = text("Firma ", F.col("c_custkey").cast("string"))
    block = text("<footer>Copyright ", name, ". Org.nr. ", other, "</footer>")
    sentence = text(short, pick(" leverer pumper.", " leverer ikke pumper."))
    link = text("https://www.facebook.com/", F.when(bad, F.lit("nabo")).otherwise(text("firma", F.col("c_custkey").cast("string"))))
    article = text("<article><h2>Nytt bygg</h2><time datetime=\"", pick("2026-01-02", "2026-01-03"), "\"></time></article>")
    cases = [  # body, span, locator, value_json
        (text('{"organisation_number":"', subject, '","name":"', F.when(bad, F.lit("X")).otherwise(name), '"}'), None, "$.name", text('"', name, '"')),
        (text('[{"virksomhet":{"organisasjonsnummer":"', other, '"},"valuta":"NOK","eiendeler":{"sumEiendeler":12.50}}]'), None, "$[0].eiendeler.sumEiendeler", F.lit("12.5")),
        (text('{"status":"', pick("ACTIVE", "INACTIVE"), '","employer":{"orgnr":"1","parent":"', subject, '"},"title":"Sveiser"}'), None, "$.title", F.lit('"Sveiser"')),
        (text('<script>{"@type":"Organization","taxID":"NO ', other, ' MVA","description":"Pumper"}</script>'), text('{"@type":"Organization","taxID":"NO ', other, ' MVA","description":"Pumper"}'), "$.description", F.lit('"Pumper"')),
        (text("<p>x</p>", block), block, "", F.lit('"operator"')),
        (text("<p>", sentence, "</p>"), text("<p>", sentence, "</p>"), "", text('"', sentence, '"')),
        (text("<a href=", link, ">f</a>"), link, "", text('"facebook.com/', F.when(bad, F.lit("nabo")).otherwise(text("firma", F.col("c_custkey").cast("string"))), '"')),
        (text("<h1>", name, "</h1>"), None, "", text('"https://www.firma', F.when(bad, F.lit("x")).otherwise(F.lit("")), F.col("c_custkey").cast("string"), '.no/"')),
        (text('<a href="', pick("/ledig/sveiser", "/om/oss"), '">Sveiser</a>'), None, "", text('"https://a.no', pick("/ledig/sveiser", "/om/oss"), '"')),
        (article, article, "", F.lit('{"headline":"Nytt bygg","published_at":"2026-01-02"}')),
        (F.lit("x"), None, "", F.lit("1")),
    ]
    choose = lambda k, kind: F.coalesce(*(F.when(F.col("kind") == i, x if isinstance(x := case[k], F.Column) else F.lit(x).cast(kind)) for i, case in enumerate(cases)))
    rows = c.withColumn("body", choose(0, "string")).withColumn("span", choose(1, "string")).withColumn("locator", choose(2, "string")).withColumn("value_json", choose(3, "string"))
    rows = rows.withColumn("method", F.element_at(F.array(*(F.lit(m) for m, _ in _METHODS)), (F.col("kind") + 1).cast("int"))).withColumn("content_sha256", F.sha2("body", 256))
    claims = rows.select(F.col("c_custkey").alias("claim_id"), "subject", "method", "value_json", "locator", "content_sha256", F.expr("instr(body, span) - 1").alias("span_start"), "span", F.lit("https://www.a.no/").alias("source_url"))
    stored = rows.where("c_custkey % 13 <> 0").groupBy("content_sha256").agg(F.first("body").alias("body"), F.bool_and("changed").alias("changed"))
    snapshots = stored.select("content_sha256", F.when(F.col("changed"), F.concat("body", F.lit(" "))).otherwise(F.col("body")).alias("body"))
    subjects = c.where("c_custkey % 17 <> 0").select("subject", "name", F.concat(F.lit("firma"), F.col("c_custkey").cast("string"), F.lit(".no")).alias("registered"))
    return claims, snapshots, subjects


_LABELS = "[" + ", ".join(f"'{m}'" for m, _ in _METHODS) + "]"
_FAULTS = "[" + ", ".join("'" + why.replace("'", "''") + "'" for _, why in _METHODS) + "]"
_N = len(_METHODS)
#: Bodies that several claims share are stored once; one of them is changed only if it is for all of them.
_AUDIT = f"""
with c as (select c_custkey as k, c_custkey % {_N} as kind, (c_custkey // {_N}) % 3 = 1 as bad, (c_custkey // {_N}) % 5 = 2 as changed, c_custkey % 13 <> 0 as kept, c_custkey % 17 <> 0 as known, case when c_custkey % {_N} in (8, 9) then ((c_custkey // {_N}) % 3 = 1)::varchar when c_custkey % {_N} = 10 then 'x' when c_custkey % {_N} = 6 and (c_custkey // {_N}) % 3 = 1 then 'nabo' else c_custkey::varchar end as body from customer),
b as (select kind, body, bool_or(kept) as stored, bool_and(changed) filter (where kept) as changed from c group by 1, 2)
select k as claim_id, ({_LABELS})[c.kind + 1] as method, case when not b.stored then 'the body is not stored' when b.changed then 'the stored body is not the cited one' when not known then 'no such company'
  when c.kind = {_N - 1} or bad then ({_FAULTS})[c.kind + 1] end as reason from c join b using (kind, body)
"""


@query(_AUDIT)
def q_audit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.audit(*_claims(spark, sf_dir)).select("claim_id", "method", "reason")


@query(f"select k % 7 as part, case when k % 4 = 0 then 'missed' when reason is null then 'supported' else 'unsupported' end as outcome, count(*) as n from (select claim_id as k, reason from ({_AUDIT})) group by 1, 2")
def q_audit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, snapshots, subjects = _claims(spark, sf_dir)
    audited = audits.audit(claims, snapshots, subjects)
    key = claims.select(F.col("claim_id").alias("k"), "claim_id")
    got = audits.recall(key, key.where("k % 4 <> 0"), audited, ["k"])
    return got.groupBy((F.col("k") % 7).alias("part"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""
select o_custkey, case when count(*) > 3 then 'too many hops' when bool_or(o_orderkey % 5 = 0) then 'a move is not permanent' when bool_or(o_orderkey % 7 = 0) then 'a target is not secure' end as reason from orders group by 1
""")
def q_redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    hop = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    at = lambda k: F.concat(F.lit("//a.no/"), k.cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", hop.alias("hop"))
    scheme = F.when(F.col("o_orderkey") % 7 == 0, "http:").otherwise("https:")
    before = F.coalesce(F.lag(scheme).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")), F.lit("https:"))
    rows = rows.select("o_custkey", "hop", F.concat(before, at(F.col("hop"))).alias("source"), F.concat(scheme, at(F.col("hop") + 1)).alias("target"), F.when(F.col("o_orderkey") % 5 == 0, 302).otherwise(301).alias("http_status"))
    return audits.chain_reasons(rows, "o_custkey")
