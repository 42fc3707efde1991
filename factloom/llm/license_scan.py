"""License scan: exact set-containment join of text blocks with license templates, DataFrame functions only.

Tokens are ordered by their frequency over the whole corpus, rare ones first. A block that holds a share t of a
template's tokens holds one of the template's first n - ceil(t * n) + 1 tokens, so only documents with such a token
are cut into blocks; blocks and templates meet on prefix tokens, the length and positional filters drop pairs that
cannot reach the share, and the rest is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ready, small, table, written

#: Phrases and labels of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Common license notices by label, as lower-case words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this work is dedicated to the public domain",
}
CONTAINMENT = 0.9
#: Words of a block and the step between blocks: any half block's length of consecutive words lies in one block.
BLOCK, STEP = 64, 32
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(col: F.Column) -> F.Column:
    return F.split(F.translate(col, AZ, AZ.lower()), NOT_WORD)


def _targets(templates: Mapping[str, str]) -> list[tuple[str, list[str], int]]:
    """(label, distinct tokens, least number shared); the phrases must be held wholly."""
    out = [(label, sorted(set(text.split())), CONTAINMENT) for label, text in templates.items()]
    out += [(f"={phrase}", sorted(set(phrase.split())), 1.0) for phrase in PHRASES]
    return [(label, tokens, math.ceil(share * len(tokens) - 1e-9)) for label, tokens, share in out]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    templates: label -> its lower-case words, short notices or whole license texts; blocks are so long that a text as long as
    the longest template lies in one. labels are those of the phrases and of all templates of which a block holds CONTAINMENT of the distinct tokens;
    score is the largest containment (1 for a phrase, 0 without a match). Null texts count as empty: no words, no
    labels, empty strings, null word places. Null or repeated ids give a row each; other columns are ignored; an
    empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    targets = _targets(templates)
    half = max(STEP, *(len(t.split()) for t in templates.values()), 0)
    block, step = (BLOCK, STEP) if half == STEP else (2 * half, half)
    vocabulary = sorted({t for _, tokens, _ in targets for t in tokens})
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    # the global order, from all documents; at most the vocabulary of the templates comes to the driver
    counts = texts.select(F.explode(_words(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    seen = {r[0]: r[1] for r in counts.collect()}
    rank = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    sets = [(label, sorted(tokens, key=rank.get), least) for label, tokens, least in targets]
    starts = [(t, label, i, len(tokens), least, tokens) for label, tokens, least in sets for i, t in enumerate(tokens[: len(tokens) - least + 1])]
    index = small(spark.createDataFrame(starts, "token string, label string, i int, size int, least int, tokens array<string>"))
    first = F.array(*(F.lit(t) for t in sorted({s[0] for s in starts})))

    split = texts.select("id", _words(F.col("text")).alias("w"))
    lead = F.when(F.element_at("w", 1) == "", 1).otherwise(0)
    trail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    kept = split.select("id", (F.size("w") - lead - trail).cast("long").alias("n_words"), F.when(F.arrays_overlap("w", first), F.slice("w", lead + 1, F.size("w") - lead - trail)).alias("w"))
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()), "license-words")

    held = kept.where("w is not null").select("row", "w")
    # the exact places of the phrases, only in documents that hold a prefix token of theirs
    at = [F.filter(F.sequence(F.lit(0), F.size("w") - 1), _stands(phrase.split())) for phrase in PHRASES]
    places = held.select("row", *(a.alias(f"p{k}") for k, a in enumerate(at)))
    all_places = F.concat(*(F.col(f"p{k}") for k in range(len(at))))
    base = places.select("row", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"), F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())))).alias("base"))

    blocks = held.select("row", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - step) / step).cast("int") - 1))).alias("block")).select("row", "block", F.slice("w", F.col("block") * step + 1, block).alias("w"))
    ordered = F.array(*(F.lit(t) for t in sorted(rank, key=rank.get)))
    blocks = blocks.select("row", "block", F.array_intersect(ordered, "w").alias("b")).where(F.size("b") > 0)
    met = blocks.select("row", "block", "b", F.posexplode("b").alias("j", "token")).join(index, "token")
    met = met.where((F.size("b") >= F.col("least")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - F.col("j") - 1) >= F.col("least")))
    found = met.withColumn("shared", F.size(F.array_intersect("b", "tokens"))).where("shared >= least and label not like '=%'").groupBy("row").agg(F.collect_set("label").alias("own"), F.max(F.col("shared") / F.col("size")).alias("best"))  # a set of template labels: bounded

    out = kept.select("row", "id", "n_words").join(base, "row", "left").join(found, "row", "left")
    none = F.array().cast("array<string>")
    base_set, own = F.coalesce("base", none), F.coalesce("own", none)
    score = F.when(F.coalesce("n_base", F.lit(0)) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.concat_ws(",", F.sort_array(F.array_distinct(base_set))).alias("base_labels"), F.concat_ws(",", F.sort_array(F.array_distinct(F.concat(base_set, own)))).alias("labels"), score.alias("score"))


def _stands(phrase: list[str]):
    """Whether the words of a phrase stand in the array w from place i on."""

    def test(i: F.Column) -> F.Column:
        out = F.lit(True)
        for k, x in enumerate(phrase):
            out = out & F.coalesce(F.try_element_at("w", i + k + 1) == x, F.lit(False))
        return out

    return test


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
