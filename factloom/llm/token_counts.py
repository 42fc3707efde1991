"""Token counts through a digest cache: only contents that the cache does not know are encoded, once each."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bit_of, bitmap, has_bit, hot_join, ready, shared_dir, table, written

CACHE = "tokenizer string, digest binary, n_bytes long, n_tokens long"
LIMIT = 4096
#: Encoded at once: bounds what a worker holds besides its Arrow batch.
ENCODE_CHARS = 4_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_of(name: str) -> str:
    """Name and content digest of a tokenizer file: a changed file never meets old counts."""
    with open(tokenizer_path(name), "rb") as f:
        return f"{name}:{hashlib.sha256(f.read()).hexdigest()[:16]}"


def counter(name: str):
    """A function from texts to their numbers of tokens, as the library for this file gives them."""
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _encode(batches: Iterator[pa.RecordBatch], name: str, skip) -> Iterator[pa.RecordBatch]:
    count = counter(name)
    schema = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def out(digests: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count(texts), pa.int64())], schema=schema)

    for batch in batches:
        digest, text = batch.column("digest"), batch.column("text")
        take = range(batch.num_rows) if skip is None else (~has_bit(skip.value, batch.column("bit").to_numpy())).nonzero()[0]
        digests, texts, size = [], [], 0
        for i in take:
            digests.append(digest[i].as_py())
            texts.append(text[i].as_py())
            size += len(texts[-1])
            if size > ENCODE_CHARS:
                yield out(digests, texts)
                digests, texts, size = [], [], 0
        if digests:
            yield out(digests, texts)


def count_tokens(docs: DataFrame, tokenizer: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of docs; the cache at cache_dir gains what it did not hold.

    The content is normalised only by null -> empty (any other change could change a count) and known by its
    SHA-256. Contents without a row in the cache are encoded once: those that stand in one row are encoded where
    they are read, without a shuffle; those in several rows (and rows that the bitmap can't tell from them) go
    through an exact distinct. Empty texts have 0 tokens. Null or repeated ids give a row each; a digest that the
    cache holds twice, as after a repeated append, counts once. Other columns of docs are ignored. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    sc = spark.sparkContext
    version = version_of(tokenizer)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_dir)  # the folder exists from here on
    cache = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer") == version).select("digest", "n_bytes", "n_tokens")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = written(rows.select("id", "digest"), "digests")
    held = known.select("digest").join(cache.select("digest"), "digest", "left_semi") if cache.take(1) else None
    many = known.groupBy("digest").count().where("count > 1").select("digest")
    words = bitmap(many if held is None else many.unionAll(held), "digest")
    skip = sc.broadcast(words)
    keyed = rows.select("digest", "text", bit_of(F.col("digest"), words).alias("bit"))
    schema = "digest binary, n_bytes long, n_tokens long"
    alone = keyed.mapInArrow(lambda it: _encode(it, tokenizer, skip), schema)

    def hit(it):
        for b in it:
            yield b.filter(pa.array(has_bit(skip.value, b.column("bit").to_numpy())))

    again = keyed.mapInArrow(hit, keyed.schema).select("digest", "text")
    again = again.groupBy("digest").agg(F.first("text").alias("text"))
    again = again.join(cache.select("digest"), "digest", "left_anti").mapInArrow(lambda it: _encode(it, tokenizer, None), schema)
    alone.unionAll(again).select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(cache_dir)
    cache = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer") == version).select("digest", "n_bytes", "n_tokens")
    skip.unpersist()
    return hot_join(known, cache.dropDuplicates(["digest"]), "digest", "id", known.count()).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with a cache that starts empty, so that all distinct contents are encoded."""
    docs = table(spark, sf_dir, "documents")
    out = count_tokens(docs, "piece_bpe_32k.model", f"{shared_dir(spark)}/factloom/token-cache-{uuid.uuid4().hex}")
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
