"""Official sources."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import official


def filing(kind="SELSKAP", **more):
    return {"regnskapstype": kind, "virksomhet": {"organisasjonsnummer": "923609016"}, "valuta": "NOK", "regnskapsperiode": {"fraDato": "2024-01-01", "tilDato": "2024-12-31"}, "resultatregnskapResultat": {"aarsresultat": -3, "ordinaertResultatFoerSkattekostnad": -2, "driftsresultat": {"driftsresultat": -1, "driftsinntekter": {"sumDriftsinntekter": 10}}}, "eiendeler": {"sumEiendeler": 20}, "egenkapitalGjeld": {"egenkapital": {"sumEgenkapital": 5}, "gjeldOversikt": {"sumGjeld": 15, "kortsiktigGjeld": {"sumKortsiktigGjeld": 6}, "langsiktigGjeld": {"sumLangsiktigGjeld": 9}}}} | more


def test_accounts(spark):
    body = [filing(), filing("KONSERN", eiendeler={"sumEiendeler": None}), filing(valuta="kr"), filing(eiendeler={"sumEiendeler": True})]
    got = official.accounts(spark.createDataFrame([("923609016", json.dumps(body))], "id string, body string"), "id", "body").collect()
    first = {r.field: r.amount for r in got if r.filing == 0 and r.accepted}
    assert list(map(first.get, official.ACCOUNT_PATHS)) == ["10", "-1", "-2", "-3", "20", "5", "15", "6", "9"]
    assert {r.scope for r in got if r.filing == 1} == {"group_accounts"} and not any(r.field == "total_assets" for r in got if r.filing == 1)
    assert {r.reason for r in got if r.filing == 2} == {"unknown currency"}
    assert {r.reason for r in got if r.filing == 3 and r.field == "total_assets"} == {"the amount is no number"}
    with pytest.raises(Exception, match="too many filings"):
        official.accounts(spark.createDataFrame([("923609016", json.dumps([{}] * 201))], "id string, body string"), "id", "body").collect()


def test_roles(spark):
    role = lambda **more: {"type": {"kode": "LEDE", "beskrivelse": "Styrets leder"}, "person": {"navn": {"fornavn": "Kari", "mellomnavn": "", "etternavn": "Nord"}}} | more
    body = {"rollegrupper": [{"sistEndret": "2024-05-01", "roller": [role(), role(fratraadt=True), role(person={"erDoed": True, "navn": {"fornavn": "A"}}), role(person=None, enhet={"organisasjonsnummer": "111111111", "navn": ["Revisor", "AS"]}), role(type=None), role(person=None)]}]}
    got = official.roles(spark.createDataFrame([("1", json.dumps(body))], "id string, body string"), "id", "body").orderBy("role_at").collect()
    assert [(r.person_name, r.organisation_number, r.reason) for r in got] == [("Kari Nord", None, None), ("Kari Nord", None, "not active"), ("A", None, "deceased"), ("Revisor AS", "111111111", None), ("Kari Nord", None, "no type"), (None, None, "no holder")]


def test_subunits_and_postings(spark):
    body = {"_embedded": {"underenheter": [{"organisasjonsnummer": "222222222", "overordnetEnhet": "923609016", "navn": "Lager", "beliggenhetsadresse": {"poststed": "OSLO"}}, {"organisasjonsnummer": "333333333", "overordnetEnhet": "1", "navn": "X"}]}}
    got = official.subunits(spark.createDataFrame([("923609016", json.dumps(body))], "id string, body string"), "id", "body").collect()
    assert [(r.subunit_number, r.accepted, r.address) for r in got] == [("222222222", True, '{"poststed":"OSLO"}'), ("333333333", False, None)]
    u = "0" * 8 + "-" + "1" * 27
    rows = [(u, f"/ad/{u}", "ACTIVE", "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z", "2026-01-20T00:00:00Z"), (u, "/ad/x", "ACTIVE", "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z", "2026-01-20T00:00:00Z"), (u, f"/ad/{u}", "INACTIVE", "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z", "2026-01-20T00:00:00Z"), (u, f"/ad/{u}", "ACTIVE", "2026-01-16T00:00:00Z", "2026-02-01T00:00:00Z", "2026-01-20T00:00:00Z"), (u, f"/ad/{u}", "ACTIVE", "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", "2026-01-20T00:00:00Z")]
    table = spark.createDataFrame(rows, "uuid string, url string, status string, published string, expires string, retrieved_at string")
    out = official.postings(table, F.lit("2026-01-15 00:00:00").cast("timestamp")).collect()
    assert [r.reason for r in out] == [None, "address and id differ", "not active", "not yet published", "over"]
