"""Official sources as rows: accounts, roles, subunits and postings, each with the reason why a candidate is not accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.dates import not_after, period_ok, timestamp
from factloom.operators.claims import check

# Where the nine amounts stand in a filing.
ACCOUNT_PATHS = {
    "annual_revenue": "resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter",
    "annual_operating_profit": "resultatregnskapResultat.driftsresultat.driftsresultat",
    "annual_profit_before_tax": "resultatregnskapResultat.ordinaertResultatFoerSkattekostnad",
    "annual_net_profit": "resultatregnskapResultat.aarsresultat",
    "total_assets": "eiendeler.sumEiendeler",
    "total_equity": "egenkapitalGjeld.egenkapital.sumEgenkapital",
    "total_liabilities": "egenkapitalGjeld.gjeldOversikt.sumGjeld",
    "current_liabilities": "egenkapitalGjeld.gjeldOversikt.kortsiktigGjeld.sumKortsiktigGjeld",
    "long_term_liabilities": "egenkapitalGjeld.gjeldOversikt.langsiktigGjeld.sumLangsiktigGjeld",
}
MOST_FILINGS, MOST_ROLES = 200, 100
ROLES = "array<struct<sistEndret:string,roller:array<struct<type:struct<kode:string,beskrivelse:string>,avregistrert:boolean,fratraadt:boolean,person:struct<erDoed:boolean,navn:struct<fornavn:string,mellomnavn:string,etternavn:string>>,enhet:struct<organisasjonsnummer:string,navn:array<string>,erSlettet:boolean>>>>>"


def accounts(documents: DataFrame, key: str, body: str) -> DataFrame:
    """key, filing, field, amount (the source's numeral), currency, scope, period_from, period_to, accepted, reason.

    body: a JSON array of filings. Missing and null amounts give no row; negative amounts stay; strings and booleans are
    candidates that are not accepted. More than MOST_FILINGS filings raise.
    """
    filings = documents.select(key, F.variant_get(F.parse_json(body), "$", "array<variant>").alias("f"))
    filings = filings.withColumn("f", F.when(F.size("f") > MOST_FILINGS, F.raise_error(F.lit("too many filings")).cast("array<variant>")).otherwise(F.col("f")))
    rows = filings.select(key, F.posexplode("f").alias("filing", "v"))
    said = lambda path: F.try_variant_get("v", f"$.{path}", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", f"$.{path}", "variant"))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), said(p).alias("amount"), kind(p).alias("kind")) for f, p in ACCOUNT_PATHS.items()))
    out = rows.select(key, "filing", said("valuta").alias("currency"), F.when(said("regnskapstype") == "SELSKAP", "entity_accounts").when(said("regnskapstype") == "KONSERN", "group_accounts").alias("scope"), said("virksomhet.organisasjonsnummer").alias("owner"), said("regnskapsperiode.fraDato").alias("period_from"), said("regnskapsperiode.tilDato").alias("period_to"), F.inline(cells)).where("amount is not null")
    rules = [("the filing is another company's", F.col("owner") == F.col(key).cast("string")), ("unknown scope", F.col("scope").isNotNull()), ("unknown currency", F.col("currency").rlike("^[A-Z]{3}$")), ("period out of order", period_ok(F.col("period_from"), F.col("period_to"))), ("the amount is no number", F.col("kind").rlike("BIGINT|INT|DECIMAL|DOUBLE"))]
    return check(out, rules).drop("owner", "kind")


def roles(documents: DataFrame, key: str, body: str) -> DataFrame:
    """key, group_at, role_at, role_code, role_label, person_name, organisation_number, changed, accepted, reason.

    Two levels are exploded; the holder is a person or an entity; empty parts of names are skipped. More than MOST_ROLES
    roles of a subject raise.
    """
    groups = documents.select(key, F.from_json(F.get_json_object(body, "$.rollegrupper"), ROLES).alias("g"))
    total = F.aggregate("g", F.lit(0), lambda acc, x: acc + F.greatest(F.size(x["roller"]), F.lit(0)))
    groups = groups.withColumn("g", F.when(total > MOST_ROLES, F.raise_error(F.lit("too many roles")).cast(ROLES)).otherwise(F.col("g")))
    rows = groups.select(key, F.posexplode("g").alias("group_at", "x")).select(key, "group_at", F.col("x.sistEndret").alias("changed"), F.posexplode("x.roller").alias("role_at", "r"))
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    person = F.concat_ws(" ", *(part(F.col(f"r.person.navn.{p}")) for p in ("fornavn", "mellomnavn", "etternavn")))
    entity = F.concat_ws(" ", F.filter(F.transform("r.enhet.navn", lambda n: F.trim(n)), lambda n: n != ""))
    out = rows.select(key, "group_at", "role_at", "changed", F.col("r.type.kode").alias("role_code"), F.col("r.type.beskrivelse").alias("role_label"), part(F.coalesce(part(person), entity)).alias("person_name"), F.when(part(person).isNull(), F.col("r.enhet.organisasjonsnummer")).alias("organisation_number"), "r")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules = [("not active", no("r.avregistrert") & no("r.fratraadt")), ("deceased", no("r.person.erDoed")), ("deleted entity", no("r.enhet.erSlettet")), ("no type", F.col("role_code").isNotNull() & F.col("role_label").isNotNull()), ("no holder", F.col("person_name").isNotNull()), ("no change date", F.try_to_date("changed", "yyyy-MM-dd").isNotNull())]
    return check(out, rules).drop("r")


def subunits(documents: DataFrame, key: str, body: str) -> DataFrame:
    """key, subunit_number, name, address (JSON), accepted, reason of the units below a company."""
    rows = documents.select(key, F.explode(F.from_json(F.get_json_object(body, "$._embedded.underenheter"), "array<struct<organisasjonsnummer:string,overordnetEnhet:string,navn:string,beliggenhetsadresse:string>>")).alias("u"))
    out = rows.select(key, F.col("u.organisasjonsnummer").alias("subunit_number"), F.col("u.navn").alias("name"), F.col("u.beliggenhetsadresse").alias("address"), "u")
    return check(out, [("another company's", F.col("u.overordnetEnhet") == F.col(key).cast("string")), ("no number", F.col("subunit_number").rlike("^[0-9]{9}$")), ("no name", F.trim("name") != "")]).drop("u")


def postings(rows: DataFrame, cutoff: Column) -> DataFrame:
    """rows (uuid, url, status, published, expires, retrieved_at) with accepted and reason at a cutoff instant."""
    return check(rows, [
        ("id is no posting id", F.col("uuid").rlike("^[0-9a-f-]{36}$")), ("address and id differ", F.col("url").endswith(F.col("uuid"))), ("not active", F.col("status") == "ACTIVE"), ("not yet published", not_after(F.col("published"), cutoff)),
        ("over", F.coalesce(timestamp(F.col("expires")) >= cutoff, F.lit(False))), ("seen before the cutoff", timestamp(F.col("retrieved_at")) >= cutoff),
    ])
