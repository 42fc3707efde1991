"""Shared plumbing: shared-folder tables, id bitmaps sized by count, joins with hot keys, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom import session
from factloom.session import shared_dir, small

__all__ = ["MOST_IDS", "bit_of", "bitmap", "components", "has_bit", "hot_join", "narrow", "ready", "roots", "shared_dir", "small", "table", "written"]
#: Bits of an id bitmap: sixteen for each id, between these bounds (1 and 16 MB).
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 27
#: Ids that a bitmap is made for at most; with more, an exact semi-join takes its place.
MOST_IDS = 1 << 25
#: Rows of a key from which it is dealt out, at least; and the share of all rows, so that hot keys are 1000 at most.
HOT_ROWS, HOT_SHARE = 250, 1000
#: Edges that one task replaces by stars, some 100 MB.
LOCAL_EDGES = 1 << 20
#: Rows or bytes that a Python worker holds before it writes them.
HELD_ROWS, HELD_BYTES = 1 << 17, 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For a shared folder that is mounted (file:): Hadoop's local file system starts a child (chmod) for each file, for its checksum file
#: and again for both; until such a child runs its own program it counts as a second JVM. Without checksum files it is one child a file.
#: narrow() needs none at all.
_NO_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound their batches, and make sure that a checkpoint folder is set."""
    shared_dir(session.ready(spark))
    return spark


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: cuts lineage, survives lost executors.

    compact: for narrow results of shuffles; at most four files for each core or one for four shuffle partitions, whichever
    is more, as each file costs a cluster's file system more than such rows do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    if compact:
        df = df.coalesce(_most_files(spark))
    df.write.options(**_NO_CHECKSUMS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _mounted(spark: SparkSession) -> str | None:
    """The shared folder's path in the file system, where it is mounted (file:)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return full.getPath() if full.getScheme() == "file" else None


def _saved(batches: Iterator[pa.RecordBatch], folder: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(file,): the Parquet file of a task's rows, if it has any, under a name that no reader takes."""
    name, out, held = f"_{uuid.uuid4().hex}", None, []
    try:
        for batch in batches:
            if batch.num_rows:
                out = out or parquet.ParquetWriter(f"{folder}/{name}", schema)
                held.append(batch)
                if sum(b.num_rows for b in held) >= HELD_ROWS or sum(b.nbytes for b in held) >= HELD_BYTES:
                    out.write_table(pa.Table.from_batches(held).select(schema.names).cast(schema))
                    held = []
        if held:
            out.write_table(pa.Table.from_batches(held).select(schema.names).cast(schema))
    finally:
        if out:
            out.close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])


def narrow(df: DataFrame, name: str, how: Callable | None = None, schema: str | None = None, compact: bool = True) -> DataFrame:
    """written(), for tables without long texts: the rows of df, or of df.mapInArrow(how, schema).

    Where the shared folder is mounted, the Python workers write the files, so that no executor starts a child for them
    (see _NO_CHECKSUMS). A task's file has a hidden name until all tasks have ended; the driver then renames those that they
    returned, so what failed or repeated tasks leave is never read. how and the writing share a worker. The shuffle files of
    this one run are removed at its end (from Spark 4.1 on), not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    folder = _mounted(spark)
    if folder is None:
        return written(df.mapInArrow(how, schema) if how else df, name, compact)
    kind = StructType.fromDDL(schema) if how else df.schema
    if compact:
        df = df.coalesce(_most_files(spark))
    path, arrow = f"{folder}/factloom/{name}-{uuid.uuid4().hex}", to_arrow_schema(kind)
    os.makedirs(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        files = df.mapInArrow(lambda it: _saved(how(it) if how else it, path, arrow), "file string").collect()
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    for (file,) in files:
        os.rename(f"{path}/{file}", f"{path}/part-{file[1:]}.parquet")
    return spark.read.schema(kind).parquet(f"file://{path}")


def _most_files(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bit_of(col, words: np.ndarray) -> F.Column:
    """Place of an id in a bitmap of bitmap()."""
    return F.pmod(F.xxhash64(col), F.lit(32 * len(words)))


def bitmap(ids: DataFrame, col: str, n: int | None = None) -> np.ndarray:
    """One bit for each hashed id in 32-bit words, MOST_BITS / 8 bytes at most on the driver however many ids there are.

    n: number of ids, if it is known. A filter that may let other ids pass, never one that loses an id; exact joins follow it.
    """
    bits = min(max(1 << (16 * (ids.count() if n is None else n)).bit_length(), LEAST_BITS), MOST_BITS)
    rows = ids.select(F.pmod(F.xxhash64(col), F.lit(bits)).alias("p")).groupBy(F.expr("cast(shiftright(p, 5) as int)").alias("w")).agg(F.expr("cast(bit_or(shiftleft(1L, cast(p & 31 as int))) as long)").alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.uint32)
    return out


def has_bit(words: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (words[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key; left's hot keys are dealt out by the column `by`.

    rows: of left, about. Hot keys are those with more than HOT_ROWS rows of left and 1 / HOT_SHARE of all, so some
    HOT_SHARE of them are broadcast; right's rows for them are repeated once for so many rows of left.
    """
    most = max(HOT_ROWS, rows // HOT_SHARE)
    if rows <= most:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).alias("_salts")))
    one = F.lit(1).cast("long")
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", one))).drop("_salts")
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", one) - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest of the numbers 0 to n - 1 that each can reach by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of a task's edges with the smallest node that these edges reach from it."""
    parts = [np.stack([b.column(k).to_numpy() for k in (0, 1)]) for b in batches if b.num_rows]
    if parts:
        edges = np.concatenate(parts, 1)
        del parts
        nodes, at = np.unique(edges, return_inverse=True)
        i, j = at.reshape(2, -1)
        found = nodes[roots(len(nodes), i, j)]
        for k in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 50_000]), pa.array(found[k : k + 50_000])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    First each task replaces LOCAL_EDGES edges, whichever they are, by stars around the smallest nodes; where one task
    has them all, that is the answer. Else alternating large-star and small-star steps follow: each keeps the
    reachability, all end as stars around the smallest nodes in O(log^2 n) rounds, and the edges of a hub are dealt out
    over several tasks. Nodes are longs; self edges, nulls and repeated edges are allowed; a node that has only self edges
    is its own component. No edges give no rows. The edges are read twice.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    tasks = -(-e.count() // LOCAL_EDGES) or 1
    nodes = e = narrow(e.repartition(tasks), "forest", _forest, "u long, v long", compact=False)
    if tasks == 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    e, size = e.where("u <> v").distinct(), 2 * e.count()
    while True:
        # large star: larger neighbours of u move to the smallest neighbour of u
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hot_join(both.where("v > u"), low, "u", "v", size).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = hot_join(large, least, "u", "v", size).select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m")), F.struct(F.col("u").alias("x"), F.col("m")))).alias("s")).select(F.col("s.x").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct().checkpoint()
        size, depth = e.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if size == depth and not e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi").take(1):
            break
    flat = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = nodes.select(F.col("u").alias("node")).distinct()
    return every.join(flat, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
