"""Near-duplicate embeddings by cross-polytope hashing with fast Hadamard rotations, multiprobe and exact verification.

Every vector is hashed in TABLES tables: HASHES pseudo-random rotations (three rounds of random signs and a fast
Hadamard transform) each give the nearest of the 2d signed axes. A vector stands in its own bucket and in PROBES
neighbouring ones per table; two vectors are compared where at least one of them is at home. Equal vectors are one class
that is compared once and counts as often as it has members. Buckets are cut into blocks of bounded size and compared block against block, so a bucket with a third of all vectors is dealt out as
well. Links found in several buckets count once: in the first bucket that both vectors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import components, hot_join, ready, roots, table, written

COSINE = 0.9
TABLES, HASHES, PROBES = 4, 2, 2
#: Vectors of one block; a pair of blocks is one group's work.
BLOCK = 1024
SEED = 20


def rotations(dim: int, seed: int = SEED) -> np.ndarray:
    """Signs of all rotations, (TABLES * HASHES, 3, padded dimension)."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], (TABLES * HASHES, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray) -> np.ndarray:
    """(n, TABLES, 1 + PROBES) bucket numbers of unit vectors: home first, then the likeliest others, all different."""
    n, dim = x.shape
    signs = rotations(dim)
    size = signs.shape[2]
    x = np.pad(x, ((0, 0), (0, size - dim)))
    best, gap, second = [], [], []
    for s in signs:
        y = x
        for r in s:
            y = hadamard(y * r)
        a = np.abs(y)
        two = np.argpartition(-a, 1, axis=1)[:, :2]
        v = np.take_along_axis(a, two, 1)
        two = np.where((v[:, :1] < v[:, 1:]), two[:, ::-1], two)
        v = np.sort(v, 1)[:, ::-1]
        axis = two + size * (np.take_along_axis(y, two, 1) < 0)
        best.append(axis[:, 0])
        second.append(axis[:, 1])
        gap.append(v[:, 0] - v[:, 1])
    best, second, gap = (np.stack(z, 1).reshape(n, TABLES, HASHES) for z in (best, second, gap))
    weight = (2 * size) ** np.arange(HASHES)
    home = best @ weight
    out = [home]
    order = np.argsort(gap, axis=2)  # the rotation whose two best axes are closest is probed first
    for k in range(min(PROBES, HASHES)):
        at = order[:, :, k : k + 1]
        moved = best.copy()
        np.put_along_axis(moved, at, np.take_along_axis(second, at, 2), 2)
        out.append(moved @ weight)
    return np.stack(out, 2).astype(np.int32)


def _unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Usable rows (not null or empty, finite, not zero) and their unit vectors in doubles."""
    rows = [(i, np.array(v, np.float64)) for i, v in enumerate(column.to_pylist()) if v is not None and len(v) and None not in v]
    rows = [(i, v / np.abs(v).max()) for i, v in rows if np.isfinite(v).all() and (v != 0).any()]
    return np.array([i for i, _ in rows], np.int64), [v / np.sqrt(v @ v) + 0.0 for _, v in rows]


UNIT = "vec_id long, digest binary, v array<double>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unit vectors and their digests."""
    for batch in batches:
        at, units = _unit(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array([xxhash.xxh3_128_digest(u.tobytes()) for u in units], pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "digest", "v"])


ENTRY = "bucket long, vec_id long, salt int, v array<double>, codes array<int>, probe int, mult long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table and bucket of each unit vector; vectors of different lengths share no bucket."""
    for batch in batches:
        units = [v.values.to_numpy() for v in batch.column("v")]
        ids, mult = (batch.column(c).to_numpy() for c in ("vec_id", "mult"))
        for dim in sorted({len(u) for u in units}):
            rows = np.array([k for k, u in enumerate(units) if len(u) == dim])
            x = np.stack([units[k] for k in rows])
            c = codes(x)
            each = c.shape[2]
            n = len(rows) * TABLES * each
            number = (np.int64(dim) << 48) + (np.arange(TABLES, dtype=np.int64) << 40)[None, :, None] + c
            who = np.repeat(np.arange(len(rows)), TABLES * each)
            vecs = ids[rows][who]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number.ravel()), pa.array(vecs.astype(np.int64)), pa.array((vecs * 2654435761 % (1 << 31)).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x[who].ravel())), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (TABLES * each)), pa.array(c.reshape(len(rows), -1)[who].ravel())), pa.array(np.tile(np.arange(each, dtype=np.int32), len(rows) * TABLES)), pa.array(mult[rows][who])],
                names=["bucket", "vec_id", "salt", "v", "codes", "probe", "mult"],
            )


def _compare(x: dict, y: dict | None, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links) and (ids, root ids) of one block against itself (y None) or another."""
    other = x if y is None else y
    cos = x["v"] @ other["v"].T
    near = cos >= COSINE
    near &= (x["probe"][:, None] == 0) | (other["probe"][None] == 0)
    near &= x["id"][:, None] != other["id"][None]
    if y is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    ids = np.r_[x["id"], other["id"]] if y is not None else x["id"]
    j_all = j + (len(x["id"]) if y is not None else 0)
    root = roots(len(ids), i, j_all)
    # counted only in the first bucket, by table and number, where the two meet with one of them at home
    table, code = bucket >> 40 & 255, bucket & ((1 << 40) - 1)
    a, b = x["codes"][i], other["codes"][j]
    first = np.ones(len(i), bool)
    each = a.shape[2] if len(i) else 1
    for t in range(table + 1):
        for p in range(each):
            for q in range(each):
                if p == 0 or q == 0:
                    same = a[:, t, p] == b[:, t, q]
                    first &= ~(same & ((t < table) | (a[:, t, p] < code)))
    links = np.bincount(i[first], other["mult"][j[first]], len(ids)) + np.bincount(j_all[first], x["mult"][i[first]], len(ids))
    return ids, links.astype(np.int64), ids[root]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, n, root): links counted in a group and the smallest row of its component there, from sorted rows."""
    carry: pa.Table | None = None

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        cols = {c: t.column(c).to_numpy() for c in ("bucket", "lo", "hi", "side", "vec_id", "probe", "mult")}
        start = np.flatnonzero(np.r_[True, (np.diff(cols["bucket"]) != 0) | (np.diff(cols["lo"]) != 0) | (np.diff(cols["hi"]) != 0)])
        out: list[tuple] = []
        for s, e in zip(start, np.r_[start[1:], len(t)], strict=True):
            if e - s > 1:
                rows = t.slice(s, e - s)
                flat = lambda c, rows=rows: rows.column(c).combine_chunks().flatten().to_numpy()
                side = cols["side"][s:e]
                all_ = {"id": cols["vec_id"][s:e], "probe": cols["probe"][s:e], "mult": cols["mult"][s:e], "v": flat("v").reshape(e - s, -1), "codes": flat("codes").reshape(e - s, TABLES, -1)}
                if cols["lo"][s] == cols["hi"][s]:
                    out.append(_compare(all_, None, int(cols["bucket"][s])))
                elif 0 < side.sum() < e - s:
                    x, y = ({k: v[side == k2] for k, v in all_.items()} for k2 in (0, 1))
                    out.append(_compare(x, y, int(cols["bucket"][s])))
        if out:
            ids, n, root = (np.concatenate([o[k] for o in out]) for k in range(3))
            keep = (n > 0) | (root != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(n[keep]), pa.array(root[keep])], names=["vec_id", "n", "root"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        carry = t if carry is None else pa.concat_tables([carry, t])
        keys = [carry.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
        same = np.logical_and.reduce([k == k[-1] for k in keys]) if len(carry) else np.zeros(0, bool)
        cut = int(np.argmax(same)) if len(carry) else 0
        if cut:
            yield from solve(carry.slice(0, cut))
            carry = carry.slice(cut)
    if carry is not None and len(carry):
        yield from solve(carry)


def dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (columns vec_id and embedding).

    Links are pairs of vectors of equal length with a cosine of at least COSINE in double precision. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing. Null ids give a row without component;
    rows that repeat an id are one vector, that with the least digest where they differ. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = ready(vectors.sparkSession)
    usable = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    units = usable.mapInArrow(_units, UNIT)
    known = written(units.groupBy("vec_id").agg(F.min("digest").alias("digest")), "digests")
    classes = known.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("mult"))
    entries = units.join(classes, ["vec_id", "digest"]).dropDuplicates(["vec_id"]).select("vec_id", "v", "mult").mapInArrow(_entries, ENTRY)
    counts = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    placed = entries.join(counts, "bucket").withColumn("cuts", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("cut", F.col("salt") % F.col("cuts"))
    # block k of a bucket meets every block: as the lower side those behind it, as the upper those before it
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    placed = placed.select("bucket", F.least("cut", "with").alias("lo"), F.greatest("cut", "with").alias("hi"), (F.col("cut") > F.col("with")).cast("int").alias("side"), "vec_id", "v", "codes", "probe", "mult")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = placed.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "vec_id")
    found = written(grouped.mapInArrow(_links, "vec_id long, n long, root long"), "links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comp = components(found.where("root <> vec_id"), "vec_id", "root").withColumnRenamed("node", "vec_id")
    each = classes.join(links, "vec_id", "left").join(comp, "vec_id", "left")
    each = each.select("digest", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    every = hot_join(known, each, "digest", "vec_id", known.count())
    out = vectors.select(F.col("vec_id").cast("long")).join(every, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))
