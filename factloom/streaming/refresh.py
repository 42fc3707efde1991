"""Streaming forms: stateful refresh of claims, last event per key, idempotent upserts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.refresh import ABSENT, OLDER, STALE
from factloom.session import shared_dir

STATE = "value_json string, value_type string, availability string, reason string, evidence_ids string, retrieved_at string, first_observed_at string, last_observed_at string"
OUTPUT = "slot string, seq long, outcome string, value_json string, availability string, reason string, current_attempt_reason string, evidence_ids string"
_FIELDS = [f.split()[0] for f in STATE.split(", ")]


def step(prior: dict | None, d: dict) -> tuple[dict, str, str | None]:
    """(claim after a decision, outcome, why the attempt did not count): the rules of the batch merge for one slot."""
    held = prior is not None and prior["availability"] == "available"
    empty = dict.fromkeys(_FIELDS) | {"reason": d["reason"], "evidence_ids": ""}
    if not d["accepted"]:
        if held and d["withdrawn"]:
            return empty | {"availability": "not_available"}, "withdrawn", None
        if held:
            return prior, "stale", d["reason"]
        return empty | {"availability": d.get("availability") or ("not_available" if d["reason"] == ABSENT else "failed")}, "unavailable", None
    if held and d["retrieved_at"] < prior["retrieved_at"]:
        return prior, "older", OLDER
    new = {"value_json": d["value_json"], "value_type": d["value_type"], "availability": "available", "reason": None, "evidence_ids": d["evidence_id"], "retrieved_at": d["retrieved_at"], "first_observed_at": d["observed_at"], "last_observed_at": d["observed_at"]}
    if held and (prior["value_json"], prior["value_type"]) == (d["value_json"], d["value_type"]):
        ids = list(dict.fromkeys([*filter(None, prior["evidence_ids"].split(",")), d["evidence_id"]]))
        return new | {"evidence_ids": ",".join(ids), "first_observed_at": prior["first_observed_at"]}, "confirmed", None
    return new, "changed" if held else "new", None


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    prior = dict(zip(_FIELDS, state.get, strict=True)) if state.exists else None
    out = []
    # a slot's decisions of one micro-batch, in their order; what is late by its evidence is told by step()
    for d in pd.concat(list(frames)).sort_values("seq").astype(object).where(lambda x: x.notna(), None).to_dict("records"):
        prior, outcome, attempt = step(prior, d)
        out.append((key[0], d["seq"], outcome, prior["value_json"], prior["availability"], prior["reason"], attempt, prior["evidence_ids"]))
    state.update(tuple(prior[f] for f in _FIELDS))
    yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])


def refresh_stream(decisions: DataFrame) -> DataFrame:
    """A stream of decisions (slot, seq, accepted, withdrawn, availability, reason, value_json, value_type, evidence_id,
    retrieved_at, observed_at; times as sortable text) to a stream of outcomes, one per decision.

    State is one claim per slot, kept without a time limit: late data loses by comparison with the evidence held, not by
    a watermark.
    """
    return decisions.groupBy("slot").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def last_event_stream(events: DataFrame, key: list[str], seq: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key so far; tombstones are rows like others (see alive())."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*seq)).alias("e")).select(*key, *(F.col(f"e.{c}") for c in columns if c not in key))


def alive(last: DataFrame, status: Column) -> DataFrame:
    """Keys whose last event is not a tombstone."""
    return last.where(status)


def upsert(path: str, key: list[str], seq: str):
    """A foreachBatch function that keeps the last row of each key in a versioned folder; replays change nothing.

    Each micro-batch writes version=<batch id> from the version before it, so a batch that runs again overwrites its own
    version only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/version={batch_id - 1}").unionByName(batch)
        rest = [c for c in batch.columns if c not in key]
        rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*key, "r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what there is, and give its result from a table in the shared folder.

    complete mode: the table is that of the last micro-batch; append mode: of all.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    last: dict[str, Any] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        last["id"] = batch_id

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if "id" not in last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch={last['id']}" if mode == "complete" else f"{path}/out/*")
