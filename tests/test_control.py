"""Run control against brute force and definitions."""

import random

import pytest

from factloom.functions import htmlx, stats
from factloom.operators import control, sample

GOOD = {
    "contract_version": "local-v1", "mode": "local", "sample_size": 10, "wall_time_seconds": 9, "request_budget": 9, "third_party_cost_usd": 0, "workers": 4, "per_host_concurrency": 2, "request_timeout_seconds": 5, "max_retries": 0,
    "finalization_reserve_fraction": 0.1, "max_response_bytes": 1000, "max_pdf_bytes": 1000, "network_enabled": False, "enabled_sources": ["registry"], "settings_origin": "a test",
}
SOURCES = {"registry": {"status": "enabled", "network": False}, "web": {"status": "enabled", "network": True}, "old": {"status": "off", "network": False}}


@pytest.mark.parametrize("change, faults", [
    ({}, []), ({"workers": True}, ["workers must be an integer from 1 on"]), ({"per_host_concurrency": 5}, ["per_host_concurrency must be at most workers"]), ({"max_html_bytes": 10}, ["max_response_bytes must be at most max_html_bytes"]),
    ({"enabled_sources": ["web", "old"]}, ["source web needs the network", "source old is not activated"]), ({"enabled_sources": ["web"], "network_enabled": True}, []), ({"extra": 1, "cutoff": "x"}, ["cutoff is unknown", "extra is unknown"]),
    ({"mode": "official"}, [f"{n} is missing" for n in ("wire_schema_confirmed", "organizer_settings_receipt", "cutoff", "cpu_limit", "memory_limit_bytes")]), ({"third_party_cost_usd": float("nan")}, ["third_party_cost_usd must be a number from 0 on"]),
    ({"finalization_reserve_fraction": 1}, ["finalization_reserve_fraction must be between 0 and 1"]),
])
def test_settings(change, faults):
    assert control.setting_faults(GOOD | change, SOURCES) == faults
    assert control.setting_faults([], SOURCES) == ["settings must be an object"]


def test_paired_interval_is_that_of_the_marginals(spark):
    pairs = spark.createDataFrame([("f", i < 2, 1 <= i < 8) for i in range(100)], "family string, control boolean, challenger boolean")
    r = control.paired_summary(pairs, ["family"]).first()
    g, x = stats.clopper_pearson(6, 100, 0.0125), stats.clopper_pearson(1, 100, 0.0125)
    assert (r.gains, r.losses, r.net, r.control_covered, r.challenger_covered) == (6, 1, 5, 2, 7) and r.gain_pp == pytest.approx(5) and r.p == 0.125
    assert r.low_pp == pytest.approx(100 * (g[0] - x[1])) and r.high_pp == pytest.approx(100 * (g[1] - x[0]))


def test_statistics_against_closed_forms_and_sums():
    import math

    for x in (0.0, 0.1, 0.5, 0.93, 1.0):
        assert stats.beta_cdf(x, 1, 1) == pytest.approx(x, abs=1e-14) and stats.beta_cdf(x, 2, 1) == pytest.approx(x * x, abs=1e-14) and stats.beta_cdf(x, 1, 3) == pytest.approx(1 - (1 - x) ** 3, abs=1e-14)
    for n in (1, 7, 60, 400):
        for k in range(0, n, max(1, n // 9)):
            for p in (0.01, 0.3, 0.5, 0.9):
                assert stats.binomial_cdf(k, n, p) == pytest.approx(math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), abs=1e-12)
            assert stats.mcnemar(k, n - k) == pytest.approx(min(1, 2 * math.fsum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n), rel=1e-12)
    for k, n in ((3, 20), (1, 7), (50, 51), (500, 100_000), (1, 10**7)):
        low, high = stats.clopper_pearson(k, n)
        assert 1 - stats.binomial_cdf(k - 1, n, low) == pytest.approx(0.025, abs=1e-9) and stats.binomial_cdf(k, n, high) == pytest.approx(0.025, abs=1e-9)


def test_picks_of_one_per_host_are_those_of_all_rows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(k, rng.choice("abc"), rng.choice([None, *(f"h{j}" for j in range(40))])) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, s string, host string")
    got = {r.k: r.pick for r in sample.stratified_per_host(df, "k", "s", "host", 30, "x").collect()}
    digests = {r.k: r.d for r in df.select("k", F.sha2(F.concat(F.lit("x:"), F.col("k").cast("string")), 256).alias("d")).collect()}
    quota = {r.s: r.quota for r in sample.quotas(df, ["s"], 30).collect()}
    want = sample.pick_one_per_host([(digests[k], str(k), s, h) for k, s, h in rows], quota)
    assert [str(k) for k in sorted(got, key=got.get)] == want


def test_merged_reports_name_what_is_missing(spark):
    rows = spark.createDataFrame([(0, 0, 5), (2, 1, 7), (2, 0, 1)], "shard int, failed_companies int, requests int")
    r = control.merged_reports(rows, 4, ["requests"]).first()
    assert (r.shards, r.failed_companies, r.requests, r.missing, r.status) == (3, 1, 13, "1,3", "failed")
    assert control.merged_reports(rows.limit(0), 1, ["requests"]).first().status == "failed"


def test_aggregates_refuse_lost_lines_and_too_many_bytes(spark):
    inputs = spark.createDataFrame([(0, "b"), (1, "a")], "pos long, k string")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, line string")
    assert [r.line for r in control.aggregate(rows, inputs, "k", "pos", "line").collect()] == ["2", "1"]
    with pytest.raises(Exception, match="no shard has a row for b"):
        control.aggregate(rows.where("k = 'a'"), inputs, "k", "pos", "line").collect()
    with pytest.raises(ValueError, match="the cap is 1"):
        control.aggregate(rows, inputs, "k", "pos", "line", most=1)


def test_a_blank_legal_name_raises(spark):
    schema = "k string, name string, website string, email string"
    one = spark.createDataFrame([("1", "A AS", None, None)], schema)
    blank = spark.createDataFrame([("2", " ", "x", None)], schema)
    subjects = spark.createDataFrame([("1",), ("2",)], "k string")
    assert control.anchors(one, blank, subjects.limit(1), "k").count() == 1
    with pytest.raises(Exception, match="no legal name for 2"):
        control.anchors(one, blank, subjects, "k").collect()


def test_locale_links_are_safe_and_on_the_host():
    page = '<link rel="alternate" hreflang="nb-NO" href="/no/"><a href="https://b.no/" title="no">x</a><a data-language="nn" href="/nn">y</a><a hreflang="en" href="/en">z</a><a hreflang="no" href="/no/">again</a><a href="http://a.no/x" hreflang="no">w</a>'
    assert htmlx.locale_links(page, "https://a.no/") == ["https://a.no/no/", "https://a.no/nn"]
