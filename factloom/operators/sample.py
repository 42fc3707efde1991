"""Stratified samples: largest-remainder quotas by windows, picks by hash rank, one company per host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import small


def employee_band(n: Column) -> Column:
    """Fixed bands of company sizes."""
    return F.when(n.isNull() | (n <= 0), "0_unknown").when(n < 10, "1_9").when(n < 50, "10_49").otherwise("50_plus")


def quotas(rows: DataFrame, stratum: Sequence[str], total: int) -> DataFrame:
    """stratum, n, quota: whole shares of the total, what is left to the largest remainders, ties by stratum.

    Only the strata, a bounded catalogue, come together in one window.
    """
    counts = rows.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    share = counts.withColumn("_all", F.sum("n").over(everything)).withColumn("_base", F.expr(f"({total} * n) div _all")).withColumn("_rest", F.expr(f"({total} * n) % _all"))
    left = F.lit(total) - F.sum("_base").over(everything)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rest"), *stratum))
    return share.withColumn("_left", left).withColumn("_rank", rank).select(*stratum, "n", (F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("quota"))


def stratified(rows: DataFrame, key: str, stratum: Sequence[str], total: int, seed: str) -> DataFrame:
    """Rows of each stratum with the smallest digests of seed:key, as many as its quota; no host rule."""
    ranked = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*stratum).orderBy("digest")))
    limit = quotas(rows, stratum, total).select(*stratum, "quota")
    return ranked.join(small(limit), list(stratum)).where("rank <= quota")


def pick_one_per_host(candidates: list[tuple[str, str, str, str | None]], quota: dict[str, int]) -> list[str]:
    """Keys picked from (digest, key, stratum, host): by stratum and digest, no host twice; refilled by largest deficit.

    Picks depend on earlier ones through hosts, so this runs on the driver, over at most a bounded multiple of the
    quotas per stratum (see stratified); strata are taken in order.
    """
    by = {s: sorted(c for c in candidates if c[2] == s) for s in sorted(quota)}
    hosts: set[str] = set()
    got: Counter = Counter()
    out: list[str] = []

    def take(s: str) -> bool:
        while by[s]:
            _, key, _, host = by[s].pop(0)
            if host is None or host not in hosts:
                hosts.add(host) if host is not None else None
                got[s] += 1
                out.append(key)
                return True
        return False

    for s in by:
        while got[s] < quota[s] and take(s):
            pass
    while len(out) < sum(quota.values()):
        open_ = [s for s in by if by[s]]
        if not open_:
            break
        s = max(open_, key=lambda s: (quota[s] - got[s], s))
        if not take(s):
            by[s] = []
    return out


def stratified_per_host(rows: DataFrame, key: str, stratum: str, host: str, total: int, seed: str) -> DataFrame:
    """As stratified, but no host twice: rows with pick (from 0), in the order in which pick_one_per_host takes them.

    Of a host only the row of a stratum with the smallest digest can be picked, and the picks pass over at most one row
    for each host that another stratum has used; so 2 * total rows of each stratum, by digest, are enough for the same picks
    as all rows give, and only they reach the driver.
    """
    ranked = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    lone = ranked.where(F.col(host).isNull()).select(stratum, "digest", key, F.lit(None).cast("string").alias("h"))
    first = ranked.where(F.col(host).isNotNull()).groupBy(stratum, F.col(host).cast("string").alias("h")).agg(F.min_by(F.struct("digest", key), "digest").alias("r")).select(stratum, "r.digest", f"r.{key}", "h")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("digest"))
    near = first.unionByName(lone).withColumn("_k", place).where(F.col("_k") <= 2 * total)
    quota = {r[stratum]: r["quota"] for r in quotas(rows, [stratum], total).collect()}
    keys = {str(r[key]): r[key] for r in near.collect()}
    picks = pick_one_per_host([(r["digest"], str(r[key]), r[stratum], r["h"]) for r in near.collect()], quota)
    picked = rows.sparkSession.createDataFrame([(keys[k], n) for n, k in enumerate(picks)], f"{key} {rows.schema[key].dataType.simpleString()}, pick int")
    return ranked.join(F.broadcast(picked), key)  # at most `total` rows


def split(rows: DataFrame, key: str, stratum: Sequence[str], sizes: Sequence[int], seed: str) -> DataFrame:
    """rows with part: disjoint parts of the given sizes, dealt within strata by digest rank; beyond them: null.

    The key is unique. A row stands in the global order behind all rows of its stratum with smaller digests, so only the
    sum of the sizes of each stratum, a bounded catalogue, come together in one window, however many rows there are.
    """
    ranked = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    first = ranked.select(key, "digest", F.struct(*stratum).alias("_s")).withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy("digest"))).where(F.col("_k") <= sum(sizes))
    n = ranked.groupBy(F.struct(*stratum).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    placed = first.join(F.broadcast(n), F.col("_s").eqNullSafe(F.col("_t"))).withColumn("_q", (F.col("_k") - 0.5) / F.col("_n"))
    placed = placed.withColumn("_at", F.row_number().over(Window.partitionBy().orderBy("_q", "digest"))).where(F.col("_at") <= sum(sizes))
    part, at = F.lit(None).cast("int"), 0
    for i, size in enumerate(sizes):
        part = F.when((F.col("_at") > at) & (F.col("_at") <= at + size), i).otherwise(part)
        at += size
    picked = placed.select(F.col(key).alias("_key"), part.alias("part"))
    return ranked.join(F.broadcast(picked), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
