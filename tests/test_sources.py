"""Sources, sinks and the ledger."""

import gzip
import hashlib
import json
from datetime import datetime, timezone

import pytest

from factloom.sources import inputs, registry, snapshots
from factloom.sources.feed import PostingFeed
from factloom.streaming.ledger import Exhausted, Ledger


def receipt(body: bytes, plain: bytes, kind: str) -> dict:
    return {"source_class": "frozen_registry", "dataset_format": kind, "source_url": "https://data.example/x", "retrieved_at": "2025-01-01T00:00:00Z", "sha256": hashlib.sha256(body).hexdigest(), "uncompressed_sha256": hashlib.sha256(plain).hexdigest()}


def test_jsonl_registry_keeps_places_and_bytes(spark, tmp_path):
    lines = ['{"organisation_number":"923609016","name":"\\u00c5 AS"}', "", '{"organisation_number":"111111111","employees":0}']
    plain = "\n".join(lines).encode()
    body = gzip.compress(plain)
    (tmp_path / "r.jsonl.gz").write_bytes(body)
    got = registry.read(spark, str(tmp_path / "r.jsonl.gz"), receipt(body, plain, "jsonl")).collect()
    assert {(r.row_number, r.subject, r.raw) for r in got} == {(1, "923609016", lines[0]), (3, "111111111", lines[2])}
    wanted = spark.createDataFrame([("111111111",)], "subject string")
    rows = registry.read(spark, str(tmp_path / "r.jsonl.gz"), receipt(body, plain, "jsonl"), wanted)
    assert [r.row_number for r in rows.collect()] == [3]
    claim = spark.createDataFrame([("111111111", 3, hashlib.sha256(lines[2].encode()).hexdigest()), ("111111111", 2, "x")], "subject string, row_number long, raw_sha256 string")
    assert registry.proven(claim, rows).count() == 1
    with pytest.raises(Exception, match="does not match"):
        registry.read(spark, str(tmp_path / "r.jsonl.gz"), receipt(body + b"x", plain, "jsonl")).collect()


def test_csv_registry(spark, tmp_path):
    plain = '﻿organisasjonsnummer;navn\n923609016;"To\nlinjer ""AS"""\n111111111;B\n'.encode()
    (tmp_path / "r.csv").write_bytes(plain)
    got = {r.subject: json.loads(r.raw) for r in registry.read(spark, str(tmp_path / "r.csv"), receipt(plain, plain, "csv")).collect()}
    assert got["923609016"] == {"organisasjonsnummer": "923609016", "navn": 'To\nlinjer "AS"'} and len(got) == 2
    for bad in (b"a;b\n1;2;3\n", b"organisasjonsnummer;x\n12;y\n", b"a;a\n1;2\n"):
        with pytest.raises(ValueError):
            list(registry.csv_rows(bad.decode()))
    assert registry.delimiter("a,b;c;d") == ";" and registry.delimiter("a\tb") == "\t"


def test_a_repeated_subject_raises(spark, tmp_path):
    plain = b'{"organisation_number":"111111111"}\n{"organisation_number":"111111111"}\n'
    (tmp_path / "r.jsonl").write_bytes(plain)
    with pytest.raises(Exception, match="several registry rows"):
        registry.read(spark, str(tmp_path / "r.jsonl"), receipt(plain, plain, "jsonl")).collect()


def test_receipts():
    good = receipt(b"a", b"a", "csv")
    assert registry.check_receipt(good) is None
    for change in ({"source_class": "x"}, {"dataset_format": "xml"}, {"source_url": "https://u@h/x"}, {"retrieved_at": "2025-01-01T00:00:00"}, {"retrieved_at": "2999-01-01T00:00:00Z"}, {"sha256": "A" * 64}):
        assert registry.check_receipt(good | change, datetime(2026, 1, 1, tzinfo=timezone.utc))


def test_inputs(spark, tmp_path):
    for name, body in (("a.json", '{"organisation_numbers":["923609016","111111111"]}'), ("b.jsonl", '{"organisation_number":"923609016"}\n{"organisation_number":"111111111"}'), ("c.txt", "923609016\n\n111111111\n")):
        (tmp_path / name).write_text(body)
        assert [(r.pos, r.subject) for r in inputs.read_ids(spark, str(tmp_path / name)).orderBy("pos").collect()] == [(0, "923609016"), (1, "111111111")]
    for bad in ("923609016\n923609016", "12", "x" * 9):
        with pytest.raises(ValueError):
            inputs.parse_ids(bad, "text")
    (tmp_path / "e.jsonl").write_text('{"b":1,"a":2}\n')
    assert inputs.read_envelopes(spark, str(tmp_path / "e.jsonl")).first().canonical == '{"a":2,"b":1}'
    (tmp_path / "f.jsonl").write_text('{"a":1,"a":2}\n')
    with pytest.raises(Exception, match="not strict"):
        inputs.read_envelopes(spark, str(tmp_path / "f.jsonl")).collect()


def test_snapshots_and_publishing(spark, tmp_path):
    bodies = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "body binary")
    store = str(tmp_path / "store")
    for _ in range(2):
        assert snapshots.put(spark, store, bodies).count() == 2
    assert snapshots.read(spark, store).count() == 2
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], snapshots.OBJECTS).write.mode("append").parquet(store)
    with pytest.raises(Exception, match="corrupt"):
        snapshots.read(spark, store).collect()
    rows = spark.createDataFrame([(2, None), (1, "ø")], "pos int, v string")
    snapshots.publish(rows, str(tmp_path / "out"), "pos")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"pos":1,"v":"ø"}', '{"pos":2,"v":null}']
    with pytest.raises(Exception, match="exist"):
        snapshots.publish(rows, str(tmp_path / "out"))
    assert snapshots.report(spark, str(tmp_path / "out"), str(tmp_path / "report")).agg({"lines": "sum"}).first()[0] == 2


def test_feed_source(spark, tmp_path):
    from factloom.session import ready

    ready(spark).dataSource.register(PostingFeed)
    item = lambda u, s: {"url": u, "_feed_entry": {"status": s, "businessName": "B"}}
    (tmp_path / "first.json").write_text(json.dumps({"items": [item("/1", "ACTIVE"), item("/2", "ACTIVE")], "next_url": "second"}))
    (tmp_path / "second.json").write_text(json.dumps({"items": [item("/1", "INACTIVE")]}))
    rows = spark.read.format("posting_feed").option("path", str(tmp_path)).load().orderBy("seq").collect()
    assert [(r.url, r.status, r.window_complete) for r in rows] == [("/1", "ACTIVE", True), ("/2", "ACTIVE", True), ("/1", "INACTIVE", True)]
    stream = spark.readStream.format("posting_feed").option("path", str(tmp_path)).load()
    query = stream.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("feed").count() == 3
    (tmp_path / "second.json").write_text(json.dumps({"items": [], "next_url": "first"}))
    with pytest.raises(Exception, match="cycle"):
        spark.read.format("posting_feed").option("path", str(tmp_path)).load().collect()


def test_ledger():
    ledger = Ledger(requests=2, bytes=100)
    with ledger.fetch("h", 60) as settle:
        assert ledger.remaining()["bytes"] == 40
        settle(10)
    assert ledger.remaining() == {"requests": 1, "bytes": 90, "cost": 0.0}
    with pytest.raises(Exhausted), ledger.fetch("h", 91):
        pass
    with ledger.fetch("h", 1):
        pass
    with pytest.raises(Exhausted), ledger.fetch("h", 1):
        pass
    ledger.cancel()
    assert ledger.by_host == {"h": 2}
