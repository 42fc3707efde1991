"""Queries and operators must take whole tables, not subsets of their ids."""

import hashlib

import duckdb
import numpy as np

from factloom.operators import sample
from factloom.plans import audits, measures, relations
from tests.oracle import difference


def test_accounts_of_all_orders(spark, tmp_path):
    lines = [(1, 1, 5, "A", 3.0), (2, 1, 6, "A", 4.0), (2, 3, 6, "A", 2.0), (40, 1, 7, "A", 9.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    r = measures.q_accounts_comparison(spark, str(tmp_path)).first()
    assert (r.expected, r.correct, r.missing, r.unsupported) == (3, 2, 1, 1)


def test_split_of_all_customers(spark, tmp_path):
    rows = [(k, f"s{k % 3}") for k in range(3000)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.part for r in measures.q_stratified_split(spark, str(tmp_path)).collect()}
    digest = {k: hashlib.sha256(f"t:{k}".encode()).hexdigest() for k, _ in rows}
    by = {s: sorted((digest[k], k) for k, t in rows if t == s) for s in ("s0", "s1", "s2")}
    order = [k for *_, k in sorted(((i + 0.5) / len(v), d, k) for v in by.values() for i, (d, k) in enumerate(v))]
    assert got == {k: 0 if at < 20 else 1 if at < 40 else 2 if at < 100 else -1 for at, k in enumerate(order)}


def test_split_of_small_and_null_strata(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b")], "k int, s string")
    got = sample.split(rows, "k", ["s"], [1, 1], "x").collect()
    assert len(got) == 4 and sorted(r.part for r in got if r.part is not None) == [0, 1]


def test_holm_of_all_users(spark, tmp_path):
    users = [(u, (u * 7919) % 997) for u in range(0, 1000)]
    spark.createDataFrame(users, "user_id long, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.adjusted for r in measures.q_holm(spark, str(tmp_path)).collect()}
    want = {}
    for family in range(8):
        tests = sorted((round(e / 997, 9), u) for u, e in users if u % 8 == family)
        steps = np.maximum.accumulate([(len(tests) - i) * p for i, (p, _) in enumerate(tests)])
        want |= {u: round(min(1.0, float(a)), 9) for (_, u), a in zip(tests, steps, strict=True)}
    assert got == want


def test_audit_of_numbers_that_read_alike_backwards(spark, tmp_path):
    spark.range(0, 1_000_000, 1000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    for name in ("q_audit_claims", "q_audit_recall"):
        assert difference(audits.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(audits.ORACLES[name]).df()) == ""


def test_first_seen_of_rows_at_one_place(spark, tmp_path):
    lines = [(7, 1, 1, 3), (7, 1, 2, 3), (7, 1, 3, 3), (1, 2, None, 1), (1, 2, 5, 1), (1, 2, 4, 1), (9, 2, 6, 1), (None, 3, 8, 1), (5, 3, 9, 2), (5, 3, 7, 2), (None, 4, 1, 1), (2, 5, None, 1), (3, None, 2, 2), (3, None, 1, 2)]
    for shift in (0, 100):  # two files, each with its own suppliers at the same places
        rows = [(o, p, s if s is None else s + shift, n) for o, p, s, n in lines]
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")  # with more, which of several files it reads first is open
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = relations.q_first_seen(spark, str(tmp_path)).select("l_partkey", "pos", "l_suppkey").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(relations.ORACLES["q_first_seen"]).fetchall(), key=repr)
