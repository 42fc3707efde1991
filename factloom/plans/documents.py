"""Text, URL, HTML, JSON and date functions over documents, pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates, htmlx, jsonx, text, urls
from factloom.plans.registry import registrar
from factloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

_LABELLED = "'Org.nr. ' || substr(lpad(doc_id::varchar, 9, '1'), 1, 3) || ' ' || substr(lpad(doc_id::varchar, 9, '1'), 4, 3) || ' ' || substr(lpad(doc_id::varchar, 9, '1'), 7, 3) || ' MVA, phone 123456789'"


@query("select doc_id, lpad(doc_id::varchar, 9, '1') as numbers from documents")
def q_org_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad(F.col("doc_id").cast("string"), 9, "1")
    said = F.concat(F.lit("Org.nr. "), F.substring(n, 1, 3), F.lit(" "), F.substring(n, 4, 3), F.lit(" "), F.substring(n, 7, 3), F.lit(" MVA, phone 123456789"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", text.org_numbers(F.concat("text", F.lit(" "), said))).alias("numbers"))


@query("select doc_id, regexp_matches(text, '(?i)(^|[^\\w\\x{80}-\\x{10ffff}])the($|[^\\w\\x{80}-\\x{10ffff}])') as named from documents")
def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.names(F.col("text"), F.lit("THE")).alias("named"))


@query("select doc_id, sha256(trim(regexp_replace(text, '[\\s\\x{85}\\x{a0}]+', ' ', 'g'))) as squeezed from documents")
def q_squeezed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.squeeze(F.col("text")), 256).alias("squeezed"))


@query("select c_custkey, lower(c_name) as key, lower(c_name) as plain_key from customer")
def q_company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legal form and extra spaces make no other company."""
    dressed = F.concat(F.lit("  "), F.col("c_name"), F.lit("   ASA"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.company_key(dressed).alias("key"), text.company_key(text.trade_name(F.concat("c_name", F.lit(" Ltd")))).alias("plain_key"))


_WORDS = "string_split(trim(regexp_replace(text, '[\\s\\x{85}\\x{a0}]+', ' ', 'g')), ' ')"


@query(f"""
select doc_id, 1 + len(list_filter(range(1, len(w)), lambda i: regexp_matches(w[i], '[.!?]$') and regexp_matches(w[i + 1], '^[\\p{{Lu}}\\d]') and not regexp_matches(w[i], '(^|[^\\p{{L}}\\p{{N}}_])\\p{{Lu}}\\.$')
  and not regexp_matches(w[i], '(^|[^\\p{{L}}\\p{{N}}_])(bl|ca|dr|dvs|etc|f\\.eks|inc|jr|kl|nr|osv|st)\\.$')))::bigint as sentences from (select doc_id, {_WORDS} as w from documents)
""")
def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("select s_suppkey, replace(replace(lower(s_name), '#', ''), ' ', '') as stem, lower(s_name) || ' aeoa' as folded from supplier")
def q_folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", text.stem_udf(F.concat("s_name", F.lit(" AS"))).alias("stem"), text.fold_udf(F.concat("s_name", F.lit(" ÆØÅ"))).alias("folded"))


_HOST = "regexp_extract(url, '://([^/:?#]+)', 1)"


@query(f"select page_id, {_HOST} as host, regexp_replace({_HOST}, '^www\\.', '') || '|' || regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/+$', '') || '|' || regexp_extract(url, '\\?([^#]*)', 1) as key from pages")
def q_page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), urls.page_key_col(F.col("url")).alias("key"))


@query(f"select page_id, array_to_string(string_split({_HOST}, '.')[-2:], '.') as domain, url like 'https:%' as https, case when url like 'https:%' then regexp_replace(url, '#.*$', '') end as safe from pages")
def q_registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", urls.registrable_col(F.try_parse_url("url", F.lit("HOST"))).alias("domain"), F.col("url").startswith("https:").alias("https"), urls.safe_url_udf("url").alias("safe"))


_TARGET = "lower(case event_id % 6 when 0 then '/Produkter/a' when 1 then '/jobb?x=1' when 2 then '/siste-nytt' when 3 then '/om-oss' when 4 then '/prosjekt/7' else '/x' end)"


@query(f"select event_id, case when {_TARGET} similar to '.*(terms|personvern|privacy|kontakt|contact|om-oss|about).*' then 'legal' when {_TARGET} like '%produkt%' then 'product' when {_TARGET} like '%prosjekt%' then 'showcase' when {_TARGET} like '%job%' then 'career' when {_TARGET} like '%siste-nytt%' then 'news' else 'other' end as kind from events")
def q_link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.element_at(F.array(*map(F.lit, ("/Produkter/a", "/jobb?x=1", "/siste-nytt", "/om-oss", "/prosjekt/7", "/x"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", urls.link_kind(target).alias("kind"))


@query("select page_id, len(regexp_extract_all(html, '<a href=\"')) as n_links, md5(array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ' ')) as links from pages")
def q_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", htmlx.links_udf("html").alias("links"))
    return rows.select("page_id", F.size("links").cast("long").alias("n_links"), F.md5(F.concat_ws(" ", "links")).alias("links"))


@query()
def q_html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs an HTML parser; the tests hold offsets against the source."""
    nodes = htmlx.explode_regions(table(spark, sf_dir, "pages"), ["page_id"])
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


_SHOWN = "regexp_replace(html, '(?s)<(style|script)[^>]*>.*?</(style|script)>|<!--.*?-->', '', 'g')"
_SPACED = f"regexp_replace(regexp_replace({_SHOWN}, '</(p|section|article|footer|address|li|a|h[1-6])>|<(br|meta)[^>]*>', ' ', 'g'), '</?[a-zA-Z!][^>]*(>|$)', '', 'g')"
_DECODED = f"regexp_replace(replace(replace(replace({_SPACED}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


@query(f"select page_id, length(trim(regexp_replace({_DECODED}, '[\\s\\x{{85}}\\x{{a0}}]+', ' ', 'g'))) as n_chars from pages")
def q_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(htmlx.visible_text_udf("html")).cast("long").alias("n_chars"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.k') as span from events")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value and its exact source text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), jsonx.span_text("props", F.lit('["k"]')).alias("span"))


@query("select event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' as canonical, event_id % 2 = 0 as strict from events")
def q_strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd rows get a repeated key, which a strict reader refuses."""
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"k": 1, '), F.substr("props", F.lit(2))))
    return table(spark, sf_dir, "events").select("event_id", jsonx.canonical_json("props").alias("canonical"), jsonx.is_strict_json(broken).alias("strict"))


@query("select event_id, case when event_id % 4 <> 0 then epoch_us(date_trunc('second', ts)) else -1 end as instant from events")
def q_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 3339 literals; every fourth has a lower-case z and is outside the profile."""
    literal = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 4 == 0, "z").otherwise("Z"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.unix_micros(dates.timestamp(literal)), F.lit(-1)).alias("instant"))


@query("select o_orderkey, o_orderkey % 2 = 1 as ok, strftime(o_orderdate, '%Y-%m-%d') as shown, o_orderdate < timestamp '1996-01-02' as before from orders")
def q_periods_and_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.col("o_orderdate") + F.expr("interval 40 days"), "yyyy-MM-dd")
    odd = F.col("o_orderkey") % 2 == 1
    shown = dates.displayed_date(F.concat(F.lit("Publisert "), F.date_format("o_orderdate", "dd.MM.yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.period_ok(F.when(odd, day).otherwise(later), F.when(odd, later).otherwise(day)).alias("ok"), shown.cast("string").alias("shown"), dates.not_after(day, F.lit("1996-01-01 12:00:00").cast("timestamp")).alias("before"))


@query("select s_suppkey, 'https://facebook.com/NordPump' || case when s_suppkey % 2 = 0 then s_suppkey::varchar else 'Group' end as profile, case when s_suppkey % 2 = 0 then 0.98 else 0.0 end::double as score from supplier")
def q_social_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names against handles and profile addresses: a group's handle proves no company of another name."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Nordpump "), F.col("s_suppkey"), F.lit(" AS")).alias("name"), F.concat(F.lit("https://www.facebook.com/NordPump"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise("Group"), F.lit("/about")).alias("link"))
    out = rows.withColumn("profile", urls.profile_udf("link"))
    return out.select("s_suppkey", "profile", urls.handle_score_udf("name", F.element_at(F.split("profile", "/"), -1)).alias("score"))
