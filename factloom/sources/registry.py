"""Frozen registry files: exact rows with their places, delimiters found from the header, receipts checked first."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import jsonx
from factloom.session import small

ROW = "row_number long, subject string, raw string, raw_sha256 string"
#: Caps of a registry file, its expanded form and one row.
ARCHIVE_BYTES, EXPANDED_BYTES, ROW_BYTES = 1 << 30, 2 << 30, 1 << 20
SUBJECT = re.compile(r"[0-9]{9}")


def check_receipt(receipt: dict, now: datetime | None = None) -> str | None:
    """Why a receipt is not usable, null if it is: class, format, a plain https source, a past time, two digests."""
    if receipt.get("source_class") != "frozen_registry":
        return "not a frozen registry"
    if receipt.get("dataset_format") not in ("jsonl", "csv"):
        return "unknown format"
    if not re.fullmatch(r"https://[^@\s]+", receipt.get("source_url") or ""):
        return "source is not plain https"
    try:
        at = datetime.fromisoformat((receipt.get("retrieved_at") or "").replace("Z", "+00:00"))
    except ValueError:
        return "time is not readable"
    if at.tzinfo is None or at > (now or datetime.now(timezone.utc)):
        return "time has no offset or lies ahead"
    if not all(re.fullmatch(r"[0-9a-f]{64}", receipt.get(k) or "") for k in ("sha256", "uncompressed_sha256")):
        return "digests are missing"
    return None


def delimiter(header: str) -> str:
    """The one of ; , and tab that splits a header into most names."""
    return max(";,\t", key=lambda d: len(next(csv.reader([header], delimiter=d))))


def jsonl_rows(text: str, key: str = "organisation_number") -> Iterator[tuple[int, str, str]]:
    """(row number from 1, subject, exact text) of each line with content; blank lines count as rows."""
    for number, line in enumerate(text.split("\n"), 1):
        if line.strip():
            if len(line.encode()) > ROW_BYTES:
                raise ValueError(f"row {number} is too long")
            subject = jsonx.loads(line).get(key)
            if not isinstance(subject, str) or not SUBJECT.fullmatch(subject):
                raise ValueError(f"row {number} has no organisation number")
            yield number, subject, line


def csv_rows(text: str, key: str = "organisasjonsnummer") -> Iterator[tuple[int, str, str]]:
    """(row number from 1, subject, canonical JSON of all columns) of each record; quoted values may span lines."""
    text = text.removeprefix("﻿")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text.split("\n", 1)[0]), doublequote=True, strict=True)
    names = next(reader)
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    for number, values in enumerate(reader, 1):
        if len(values) != len(names):
            raise ValueError(f"row {number} has {len(values)} of {len(names)} columns")
        row = dict(zip(names, values, strict=True))
        if not SUBJECT.fullmatch(row.get(key, "")):
            raise ValueError(f"row {number} has no organisation number")
        yield number, row[key], jsonx.canonical(row)


def read(spark: SparkSession, path: str, receipt: dict, subjects: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """row_number, subject, raw, raw_sha256 of a registry file (JSONL or CSV, plain or gzip), of all or some subjects.

    A file is one task, as places and the digest of the whole need it; many files are many tasks. A wrong digest, a
    broken row or a wanted subject that repeats raises.
    """
    if why := check_receipt(receipt):
        raise ValueError(f"registry receipt: {why}")
    form = receipt["dataset_format"]
    own = (key or ("organisation_number" if form == "jsonl" else "organisasjonsnummer"),)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for body in frame["content"]:
                if len(body) > ARCHIVE_BYTES or hashlib.sha256(body).hexdigest() != receipt["sha256"]:
                    raise ValueError("registry file does not match its receipt")
                data = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else bytes(body)
                if len(data) > EXPANDED_BYTES or hashlib.sha256(data).hexdigest() != receipt["uncompressed_sha256"]:
                    raise ValueError("expanded registry does not match its receipt")
                held = []
                for row in (jsonl_rows if form == "jsonl" else csv_rows)(data.decode(), *own):
                    held.append((*row, hashlib.sha256(row[2].encode()).hexdigest()))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["row_number", "subject", "raw", "raw_sha256"])
                        held = []
                yield pd.DataFrame(held, columns=["row_number", "subject", "raw", "raw_sha256"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ROW)
    if subjects is not None:
        rows = rows.join(small(subjects.select("subject").distinct()), "subject", "left_semi").select("row_number", "subject", "raw", "raw_sha256")
    count = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("row_number", "raw", "raw_sha256")).alias("r"))
    checked = count.withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.lit("a subject has several registry rows"))).otherwise(F.col("n")))
    return checked.where("n = 1").select("r.row_number", "subject", "r.raw", "r.raw_sha256")


def proven(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates (subject, row_number, raw_sha256) whose row is a member of the registry at that place, byte by byte."""
    return candidates.join(registry.select("subject", "row_number", "raw_sha256").distinct(), ["subject", "row_number", "raw_sha256"], "left_semi")
