"""Bounded, repeatable samples of labelled rows for the models that are fitted here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a training text that are kept at most; the texts that a model is applied to are whole.
TEXT_CHARS = 50_000
_SPAN = 1 << 32


def held_out(col: str = "doc_id") -> F.Column:
    """True for the quarter of documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def smallest(rows: DataFrame, group: str, most: int) -> list:
    """At most `most` rows of each group, those with the smallest hashes of doc_id, on the driver.

    rows: doc_id and group, a row for each doc_id. The groups are counted first, and only rows below a cut of the hash
    space travel, where about twice as many as needed stand; a group that has too few there gets a larger cut. So no
    group stands in one task, however large it is, and the driver gets some 2 * most rows of each group.
    """
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(_SPAN)))
    total = {r[0]: r[1] for r in hashed.groupBy(group).count().collect()}
    cut = {g: min(_SPAN, 1 + int(_SPAN * (2 * most + 20) / n)) for g, n in total.items()}
    out, todo = [], set(total)
    while todo:
        below = F.lit(False)
        for g in sorted(todo, key=str):
            below = below | ((F.col(group) == F.lit(g)) & (F.col("_h") < cut[g]))
        found: dict = {g: [] for g in todo}
        for r in hashed.where(below).collect():
            found[r[group]].append(r)
        for g, got in found.items():
            if len(got) >= min(most, total[g]):
                out += sorted(got, key=lambda r: (r["_h"], r["doc_id"]))[:most]
                todo.discard(g)
            cut[g] = min(_SPAN, 4 * cut[g])
    return out


def texts_of(docs: DataFrame, ids: list, chars: int = TEXT_CHARS) -> list[tuple]:
    """(doc_id, text) of these documents in order: one text each, its first `chars` characters; null texts are left out."""
    if not ids:
        return []
    rows = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    return sorted((r[0], r[1]) for r in rows.collect())


def sample(docs: DataFrame, labelled: DataFrame, label: str, per_label: int) -> list[tuple[str, object]]:
    """(text, label) of at most per_label documents of each label, by hash of doc_id; never held-out ones.

    labelled: doc_id and label, a small number of different labels; where a document has several labels, the least
    counts, and where it has several texts, the least text. per_label and TEXT_CHARS bound what the driver gets.
    """
    one = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"))
    chosen = {r["doc_id"]: r["label"] for r in smallest(one, "label", per_label)}
    return [(text, chosen[i]) for i, text in texts_of(docs, list(chosen))]
