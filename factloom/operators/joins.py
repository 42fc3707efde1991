"""Joins of the pipeline: lookup, bridge, suffix, gold and containment joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import small


def lookup(subjects: DataFrame, registry: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(registry rows of the subjects, subjects without a row). The subjects' side is broadcast if it is small."""
    side = small(subjects.select(key).distinct())
    return registry.join(side, key, "left_semi"), subjects.join(registry.select(key), key, "left_anti")


def suffixes(host: Column, least: int = 1) -> Column:
    """All label suffixes of a host, the host itself first: a.b.c -> [a.b.c, b.c, c], of at least so many labels."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - least + 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def suffix_join(rows: DataFrame, host: str, domains: DataFrame, domain: str, how: str = "left_semi") -> DataFrame:
    """Rows whose host is one of the domains or below one, by an equi-join on the suffixes of the distinct hosts."""
    hosts = rows.select(host).where(F.col(host).isNotNull()).distinct()
    hit = hosts.select(host, F.explode(suffixes(F.col(host))).alias("_s")).join(small(domains.select(F.col(domain).alias("_s")).distinct()), "_s", "left_semi").select(host).distinct()
    return rows.join(hit, host, how).select(*rows.columns)


def bridge(postings: DataFrame, org: str, bridges: DataFrame, child: str, parent: str, subjects: DataFrame, subject: str) -> DataFrame:
    """Postings of each subject: owned by it, or by a child whose bridge names it as parent.

    The alternatives are two keys of one equi-join, not an OR condition, so no nested loop is planned.
    """
    up = postings.join(bridges.select(F.col(child).alias(org), F.col(parent).alias("_parent")), org, "left")
    owners = up.withColumn("_owner", F.explode(F.array_distinct(F.array_compact(F.array(org, "_parent")))))
    return owners.join(subjects.select(F.col(subject).alias("_owner")).distinct(), "_owner").withColumn("via", F.when(F.col("_owner") == F.col(org), "own").otherwise("bridge")).withColumnRenamed("_owner", subject if subject != org else f"{subject}_owner").drop("_parent")


def gold_match(gold: DataFrame, claims: DataFrame, keys: Sequence[str], matched: bool = True) -> DataFrame:
    """Gold rows with (or without) a published claim of equal keys."""
    return gold.join(claims.select(*keys).distinct(), list(keys), "left_semi" if matched else "left_anti")


#: An odd base and its inverse modulo 2**64, for hashes of windows; characters hashed at once.
_BASE, _INVERSE, _STEP = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _window_hashes(codes: np.ndarray, length: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of length codes, by sums of codes times powers of the base."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return (sums[length:] - sums[:-length]) * down[: len(codes) - length + 1]


def windows_among(rows: DataFrame, text: str, heads: DataFrame, head: str, length: int) -> DataFrame:
    """head: the windows of length characters, at any place of the whole texts, that are among the heads.

    Every window is hashed, and those with the hash of a head are given, once for each text; only the hashes of the
    distinct heads, 8 bytes each, pass through the driver. A window that merely shares a hash may be among them, so an
    equi-join with the heads must follow, as in gold_match.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers(_BASE, length), _powers(_INVERSE, length)
        for batch in batches:
            found = [int(_window_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64), length, up, down)[0].view(np.int64)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])

    whole = heads.where(F.length(head) == length).select(head).distinct()
    wanted = np.unique(np.array([r.h for r in whole.mapInArrow(hashed, "h long").collect()], np.int64).view(np.uint64))
    maybe = np.zeros(1 << 16, bool)
    maybe[wanted >> np.uint64(48)] = True

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers(_BASE, _STEP + length), _powers(_INVERSE, _STEP + length)
        for batch in batches:
            out: list[str] = []
            for column in batch.column(0):
                t = column.as_py()
                found: set[str] = set()
                for at in range(0, len(t) - length + 1, _STEP):
                    codes = np.frombuffer(t[at : at + _STEP + length - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
                    h = _window_hashes(codes, length, up, down)
                    near = np.flatnonzero(maybe[h >> np.uint64(48)])
                    found.update(t[at + i : at + i + length] for i in near[np.isin(h[near], wanted)].tolist())
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=[head])

    return rows.where(F.length(text) >= length).select(text).mapInArrow(probed, f"{head} string")


def containment(inner: DataFrame, outer: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Pairs of intervals of a key in which the first lies strictly inside the second: key, in_*, out_*."""
    a = inner.select(*key, F.col(start).alias("in_start"), F.col(end).alias("in_end"))
    b = outer.select(*key, F.col(start).alias("out_start"), F.col(end).alias("out_end"))
    return a.join(b, list(key)).where("out_start < in_start and in_end < out_end")


def paired(control: DataFrame, challenger: DataFrame, key: str) -> DataFrame:
    """key, control, challenger; a key that only one side has raises."""
    a, b = control.select(key, F.col("outcome").alias("control")), challenger.select(key, F.col("outcome").alias("challenger"))
    both = a.join(b, key, "full")
    bad = F.col("control").isNull() | F.col("challenger").isNull()
    return both.select(key, F.when(bad, F.raise_error(F.lit("control and challenger must hold the same keys"))).otherwise(F.col("control")).alias("control"), "challenger")


def chain(receipts: DataFrame, links: Sequence[str], key: str = "snapshot_id") -> DataFrame:
    """Receipts with the receipt that each link column names, as a struct of that name without _id; absent: null."""
    out = receipts
    body = [c for c in receipts.columns if c not in links]
    for link in links:
        target = receipts.select(F.col(key).alias(link), F.struct(*body).alias(link.removesuffix("_id")))
        out = out.join(target, link, "left")
    return out


def shard_of(pos: Column, size: int = 100) -> Column:
    """The shard of an input place."""
    return F.floor(pos / size).cast("long")
