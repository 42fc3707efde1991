"""Structural rules: one mutated field per case."""

import pytest

from factloom.operators import envelope as e

T = "2026-01-01T00:00:00Z"
CLAIM = "subject string, field string, claim_id string, value_json string, availability string, reason string, evidence_ids array<string>"
EVIDENCE = "subject string, id string, source_url string, retrieved_at string, content_sha256 string, claim_span string"
CHANGE = "subject string, claim_id string, kind string, old_value string, new_value string, observed_at string"
RUN = "subject string, started_at string, completed_at string, terminal_status string"
GOOD = {
    "claims": [("1", "f", "c1", "1", "available", None, ["e1"]), ("1", "g", "c2", None, "failed", "r", [])],
    "evidence": [("1", "e1", "https://a.no/x", T, "0" * 64, "1")],
    "changes": [("1", "c1", "value_changed", "0", "1", T)],
    "runs": [("1", T, T, "completed")],
}


def broken(spark, **change):
    rows = GOOD | change
    tables = [spark.createDataFrame(rows[k], s) for k, s in (("claims", CLAIM), ("evidence", EVIDENCE), ("changes", CHANGE), ("runs", RUN))]
    return {r.rule for r in e.envelope_violations(spark.createDataFrame([("1",)], "subject string"), *tables).collect()}


@pytest.mark.parametrize("change, rules", [
    ({}, set()),
    ({"claims": [("1", "f", "c1", None, "available", None, ["e1"])]}, {"claim: available if and only if it has a value"}),
    ({"claims": [("1", "f", "c1", "1", "available", None, [])]}, {"claim: available if and only if it has evidence", "evidence: is cited"}),
    ({"claims": [("1", "f", "c1", "1", "available", None, ["e1", "e2"])]}, {"claim: evidence exists"}),
    ({"claims": [*GOOD["claims"], ("1", "g", "c2", None, "failed", None, [])]}, {"claim: one per slot", "claim: a reason unless available"}),
    ({"evidence": [("1", "e1", "http://a.no", T, "0" * 64, "1")]}, {"evidence: https source"}),
    ({"evidence": [("1", "e1", "https://a.no", "2026-01-01T00:00:00", "x", "")]}, {"evidence: time with an offset", "evidence: content digest", "evidence: literal span"}),
    ({"changes": [("1", "c1", "current_support_lost", "0", "1", T)]}, {"change: a lost value has no successor"}),
    ({"changes": [("1", "c1", "other", "1", "1", T)]}, {"change: known kind", "change: values differ"}),
    ({"runs": []}, {"subject: has a terminal row"}),
    ({"runs": [*GOOD["runs"], ("2", "2026-01-02T00:00:00Z", T, "completed")]}, {"run: of an input subject", "run: times in order"}),
])
def test_rules(spark, change, rules):
    assert broken(spark, **change) == rules


def test_prior_claims_are_derived_again(spark):
    prior = spark.createDataFrame([("a", "1", "int", "available"), ("b", "1", "int", "available"), ("c", None, None, "failed")], "slot string, value_json string, value_type string, availability string")
    again = spark.createDataFrame([("a", "1", "int"), ("b", "1", "str")], "slot string, value_json string, value_type string")
    assert [r.slot for r in e.unverified(prior, again, ["slot"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="prior"):
        e.refuse(e.unverified(prior, again, ["slot"]), "prior claims differ")
