"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks, DataFrame functions only.

A window of a document has as many words as the benchmark item that it may repeat; it may hang over either end of the
document. Only windows that hold one of the item's anchor shingles are laid, at all their places: the anchors are so many of its
5-word shingles that the others hold less than the threshold of its weight, so every window that can pass holds one.
Windows and items get 64-bit fingerprints of their words. The index holds every item under each of its BLOCKS blocks
with up to FLIPS bits turned: two fingerprints within RADIUS differ by FLIPS bits at most in one block, so the window's own
blocks meet all of them. Pairs within RADIUS are verified by exact similarity of their shingles, weighted by length.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import ready, small, table, written

SHINGLE = 5
SIMILARITY = 0.75
#: Bits in which a window may differ from its item; widths of the blocks; bits that differ in the best block at most.
RADIUS, WIDTHS = 19, (13, 13, 13, 13, 12)
BLOCKS, FLIPS = len(WIDTHS), RADIUS // len(WIDTHS)
NOT_WORD = r"[^\p{L}\p{N}\p{M}]+"


def _words(col: F.Column) -> F.Column:
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), NOT_WORD), "")


def _hashes(words: str, k: int = SHINGLE) -> F.Column:
    """Hashes of the k-word shingles at all places of an array of words, none if it has fewer."""
    n = F.size(words)
    h = F.transform(words, lambda w: F.xxhash64(w))
    if k == SHINGLE:
        pair = lambda a, b: F.xxhash64(a, b)
        two = F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), pair)
        four = F.zip_with(F.slice(two, F.lit(1), n - 3), F.slice(two, F.lit(3), n - 3), pair)
        found = F.zip_with(F.slice(four, F.lit(1), n - 4), F.slice(h, F.lit(5), n - 4), pair)
    else:
        found = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))
    return F.when(n >= k, found).otherwise(F.array().cast("array<long>"))


def _strings(words: str, k: F.Column) -> F.Column:
    """The k-word shingles at all places as strings; of fewer words the whole."""
    n = F.size(words)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, k)))


def _simhash(hashes: str, planes: int) -> F.Column:
    """64-bit SimHash of an array of word hashes: a bit is set if more than half of them have it.

    The 64 counters stand upright: bit b of plane k is digit k of the number of hashes with bit b, so that one hash is
    added to all counters by a few operations on whole numbers. planes: digits of the largest size.
    """
    name = [f"p{k}" for k in range(planes)]
    zero = F.struct(*(F.lit(0).cast("long").alias(p) for p in name))

    def every(cols: list, start):
        for c in cols:
            start = start.bitwiseAND(c)
        return start

    def add(acc: F.Column, h: F.Column) -> F.Column:
        return F.struct(*(acc[p].bitwiseXOR(every([acc[q] for q in name[:k]], h)).alias(p) for k, p in enumerate(name)))

    def over_half(acc: F.Column) -> F.Column:
        """Bits whose number is above half the size: compared digit by digit from the highest, all bits at once."""
        half = F.floor(F.size(hashes) / 2).cast("long")
        digit = lambda k: F.when(F.getbit(half, F.lit(k)) == 1, F.expr("-1L")).otherwise(F.expr("0L"))
        out = F.expr("0L")
        for k, p in enumerate(name):
            same = [F.bitwise_not(acc[name[j]].bitwiseXOR(digit(j))) for j in range(k + 1, planes)]
            out = out.bitwiseOR(every(same, acc[p].bitwiseAND(F.bitwise_not(digit(k)))))
        return out

    return F.aggregate(hashes, zero, add, over_half)


def _blocks(fp: F.Column) -> F.Column:
    at = [sum(WIDTHS[:k]) for k in range(BLOCKS)]
    return F.array(*(F.call_function("shiftrightunsigned", fp, F.lit(a)).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(at, WIDTHS, strict=True)))


def _turned(width: int) -> F.Column:
    """The numbers of so many bits of which up to FLIPS are set."""
    masks = [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(width), n)]
    return F.array(*(F.lit(m).cast("long") for m in masks))


def _weight(shingles: F.Column) -> F.Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, hamming, similarity: the best window of each document for each item it repeats.

    start counts the document's words from 0; of equally similar windows the first is given. An item of fewer than
    SHINGLE words is one shingle, found wherever its words stand. Documents and items with null ids, and those without
    words, match nothing. Rows that repeat an id are taken together, each for itself. Other columns are ignored. Empty tables give no rows.
    """
    ready(docs.sparkSession)
    items = benchmark.where("item_id is not null").select("item_id", _words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    items = written(items.select("item_id", "iw", F.size("iw").alias("m"), F.xxhash64("item_id", F.concat_ws(" ", "iw")).alias("item")).distinct(), "items", compact=True)
    k = F.least(F.lit(SHINGLE), F.col("m"))
    longest, *short = [r[0] for r in items.agg(F.max("m").alias("m")).unionAll(items.where(F.col("m") < SHINGLE).select("m").distinct()).collect()]
    planes = int(longest or 1).bit_length()
    items = items.withColumn("t", F.array_distinct(_strings("iw", k))).withColumn("ih", F.transform("iw", lambda w: F.xxhash64(w)))
    items = items.select("item", "item_id", "m", "iw", "t", _weight(F.col("t")).alias("tw"), _simhash("ih", planes).alias("ifp"))

    # anchors: an item's different shingles by hash, until what is left can't reach the threshold
    order = Window.partitionBy("item").orderBy("hash", "shingle")
    at = F.when(F.col("m") >= SHINGLE, _hashes("iw"))
    for n in short:
        at = at.when(F.col("m") == n, _hashes("iw", n))
    places = items.select("item", "m", "tw", F.explode(F.arrays_zip(at.alias("hash"), _strings("iw", k).alias("shingle"))).alias("x")).select("item", "m", "tw", "x.hash", "x.shingle").distinct()
    before = F.coalesce(F.sum(F.length("shingle")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    anchors = written(places.withColumn("before", before).where(F.col("before") <= (1 - SIMILARITY) * F.col("tw")).select("hash", "m").distinct(), "anchors", compact=True)

    # hits: places of anchors, each with the words that its windows can hold
    words = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), _words(F.col("text")).alias("w"))
    reach = F.greatest(F.col("m") - SHINGLE, F.lit(0))
    hits = None
    for n in (SHINGLE, *sorted(short)):
        found = words.select("doc_id", "row", "w", F.posexplode(_hashes("w", n)).alias("pos", "hash"))
        found = found.join(small(anchors.where(F.col("m") >= SHINGLE if n == SHINGLE else F.col("m") == n)), "hash").withColumn("from", F.greatest(F.col("pos") - reach, F.lit(0)))
        found = found.select("doc_id", "row", "m", "pos", "from", F.slice("w", F.col("from") + 1, F.col("pos") + F.col("m") - F.col("from")).alias("w"))
        hits = found if hits is None else hits.unionAll(found)
    # a window is laid at the first hit that it holds: starts up to the hit's place that no hit before reaches
    behind = F.lag("pos").over(Window.partitionBy("doc_id", "row", "m").orderBy("pos"))
    laid = hits.withColumn("first", F.greatest(F.col("pos") - reach, behind + 1)).where("first <= pos").withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    laid = laid.select("doc_id", "m", "from", "w", "h", F.explode(F.sequence("first", "pos")).alias("s")).withColumn("start", F.greatest("s", F.lit(0)))
    cut = lambda c: F.slice(c, F.col("start") - F.col("from") + 1, F.col("s") + F.col("m") - F.col("start"))
    windows = laid.select("doc_id", "m", "start", cut("w").alias("win"), cut("h").alias("h"))
    windows = windows.select("doc_id", "m", "start", "win", _simhash("h", planes).alias("fp"))

    key = F.xxhash64("m", "k", "v").alias("key")
    turned = F.when(F.col("k") == F.lit(BLOCKS - 1), _turned(WIDTHS[-1])).otherwise(_turned(WIDTHS[0]))
    index = items.select("item", "m", "ifp", F.posexplode(_blocks(F.col("ifp"))).alias("k", "b")).select("item", "m", "ifp", "k", F.explode(F.transform(turned, lambda t: t.bitwiseXOR(F.col("b")))).alias("v"))
    index = written(index.select(key, "item", F.col("m").alias("im"), "ifp"), "blocks", compact=True)
    met = windows.select("*", F.posexplode(_blocks(F.col("fp"))).alias("k", "v")).select("*", key).join(small(index), "key").where("m = im")
    met = met.withColumn("x", F.col("fp").bitwiseXOR(F.col("ifp"))).withColumn("hamming", F.bit_count("x")).where(F.col("hamming") <= RADIUS)
    near = F.transform(_blocks(F.col("x")), lambda b: F.bit_count(b) <= FLIPS)
    met = met.where(F.array_position(near, F.lit(True)) == F.col("k") + 1)  # once, in the first block where they meet
    met = met.select("doc_id", "start", "win", "hamming", "item").join(small(items.select("item", "item_id", "m", "t", "tw")), "item")
    met = met.withColumn("s", F.array_distinct(_strings("win", k)))
    both = met.select("doc_id", "item_id", "start", F.size("win").alias("n_words"), "hamming", "tw", _weight(F.col("s")).alias("sw"), _weight(F.array_intersect("s", "t")).alias("common"))
    scored = both.withColumn("similarity", F.col("common") / (F.col("sw") + F.col("tw") - F.col("common"))).where(F.col("similarity") >= SIMILARITY)
    best = F.max_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start"), -F.col("n_words")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.start").cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.hamming").cast("int").alias("hamming"), "b.similarity")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
