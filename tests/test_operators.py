"""Operators on small fixtures: edge cases that the fixture tables do not have."""

from pyspark.sql import functions as F

from factloom.operators import claims, refresh, sample, windows
from factloom.streaming.refresh import step

CLAIM = "slot string, value_json string, value_type string, availability string, reason string, evidence_ids array<string>, retrieved_at timestamp_ntz, first_observed_at string, last_observed_at string"
DECISION = "slot string, accepted boolean, withdrawn boolean, availability string, reason string, value_json string, value_type string, evidence_id string, retrieved_at timestamp_ntz"


def test_merge_again_changes_nothing(spark):
    t = F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00"))
    prior = spark.createDataFrame([("a", "1", "int", "available", None, ["e"], None, "x", "y"), ("b", "1", "int", "available", None, ["e"], None, "x", "y")], CLAIM).withColumn("retrieved_at", t)
    seen = spark.createDataFrame([("a", True, False, None, None, "1", "int", "e", None), ("b", True, False, None, None, "1", "str", "e2", None), ("c", False, False, None, "absent_in_frozen_row", None, None, None, None), ("d", False, False, "ambiguous", "r", None, None, None, None)], DECISION).withColumn("retrieved_at", t)
    merged = refresh.merge(prior, seen, "now", ["slot"])
    got = {r.slot: r for r in refresh.claims(merged, ["slot"]).collect()}
    assert got["a"].outcome == "confirmed" and got["a"].evidence_ids == ["e"] and got["a"].first_observed_at == "x" and got["a"].last_observed_at == "now"
    assert got["b"].outcome == "changed"  # 1 and "1" are different values
    assert got["c"].availability == "not_available" and got["d"].availability == "ambiguous"
    assert [r.slot for r in refresh.changes(merged, ["slot"]).collect()] == ["b"] and refresh.history(merged, ["slot"]).count() == 1


def test_stream_step_has_the_same_outcomes():
    d = {"accepted": True, "withdrawn": False, "availability": None, "reason": None, "value_json": "1", "value_type": "int", "evidence_id": "e", "retrieved_at": "2", "observed_at": "n"}
    held, outcome, _ = step(None, d)
    assert outcome == "new"
    assert step(held, d | {"evidence_id": "f"})[0]["evidence_ids"] == "e,f"
    assert step(held, d | {"retrieved_at": "1", "value_json": "9"})[1:] == ("older", "older_source_cannot_replace_newer_support")
    assert step(held, d | {"value_type": "str"})[1] == "changed"
    bad = d | {"accepted": False, "reason": "r"}
    assert step(held, bad) == (held, "stale", "r") and step(held, bad | {"withdrawn": True})[1] == "withdrawn" and step(None, bad)[0]["availability"] == "failed"


def test_unpivot_keeps_types_and_zero(spark):
    rows = spark.createDataFrame([(1, 0, "", True, None), (2, None, 'a"ø', None, 1.0)], "id int, n int, s string, b boolean, d double")
    got = {(r.id, r.field): (r.value_json, r.value_type) for r in claims.unpivot(rows, ["id"], {"n": "n", "s": "s", "b": "b", "d": "d"}, drop_missing=True).collect()}
    assert got == {(1, "n"): ("0", "int"), (1, "b"): ("true", "bool"), (2, "s"): ('"a\\"ø"', "str"), (2, "d"): ("1.0", "float")}


def test_unique_decisions_compare_types(spark):
    rows = spark.createDataFrame([("a", 1, True, None, "1", "int"), ("a", 2, True, None, "1", "str"), ("b", 3, False, "no", None, None), ("b", 4, True, None, "2", "int"), ("c", 6, False, "later", None, None), ("c", 5, False, "first", None, None)], "slot string, pos int, accepted boolean, reason string, value_json string, value_type string")
    got = {r.slot: (r.availability, r.value_json, r.reason) for r in claims.unique_decisions(rows, ["slot"], "pos").collect()}
    assert got == {"a": ("ambiguous", None, claims.CONFLICT), "b": ("available", "2", None), "c": ("failed", None, "first")}


def test_round_robin(spark):
    links = ["tjenester/a", "tjenester/b", "karriere", "siste-nytt"]
    group = F.when(F.col("u").startswith("tjenester"), 0).when(F.col("u") == "karriere", 1).otherwise(2)
    rows = spark.createDataFrame([(1, k, u) for k, u in enumerate(links)], "page int, pos int, u string")
    got = windows.round_robin(rows, ["page"], group, "pos").orderBy("place").collect()
    assert [r.u for r in got] == ["tjenester/a", "karriere", "siste-nytt", "tjenester/b"]


def test_holm(spark):
    got = windows.holm(spark.createDataFrame([("x", 0.01), ("y", 0.04)], "t string, p double"), "p").collect()
    assert {r.t: round(r.adjusted, 9) for r in got} == {"x": 0.02, "y": 0.04}


def test_one_per_host_refills_from_the_largest_deficit():
    rows = [("1", "a", "s", "h"), ("2", "b", "s", "h"), ("3", "c", "t", "h"), ("4", "d", "t", None), ("5", "e", "t", "g")]
    assert sample.pick_one_per_host(rows, {"s": 2, "t": 1}) == ["a", "d", "e"]
