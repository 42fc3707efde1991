"""Language of documents by a linear-chain CRF that labels every word, for texts that switch between languages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ready, table
from factloom.llm.crf import Model, fit, posteriors
from factloom.llm.training import held_out, sample

#: Documents of each language that the model learns from at most.
PER_LABEL = 150
#: Hashed features; characters of a word's head and tail that features see.
FEATURES, SIDE = 1 << 16, 12
CACHE_WORDS = 250_000
#: Words for which forward-backward runs at once.
CHUNK = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; a word longer than two SIDEs is known by its head and tail."""
    found = _WORD.findall((text or "").lower())
    return found if any(map(_has_letter, found)) else []


def _has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def _hash(parts: list[np.ndarray], kind: int) -> np.ndarray:
    h = np.full(len(parts[0]), 1469598103934665603 + kind * 7919, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
    return (h % np.uint64(FEATURES)).astype(np.int64)


def word_features(words: list[str]) -> np.ndarray:
    """Feature numbers of words, -1: none: prefixes and suffixes of 1 to 4, trigrams, the word itself (lexicon)."""
    width = 2 * SIDE
    cut = [w if len(w) <= width else w[:SIDE] + w[-SIDE:] for w in words]
    c = np.array(cut, f"U{width}").view(np.uint32).reshape(len(cut), width)
    n = np.array([len(w) for w in cut], np.int64)
    rows = np.arange(len(cut))
    out = [_hash(list(c.T), 0)]
    for k in range(1, 5):
        out.append(np.where(n >= k, _hash(list(c[:, :k].T), k), -1))
        tail = [c[rows, np.maximum(n - j, 0)] for j in range(k, 0, -1)]
        out.append(np.where(n >= k, _hash(tail, 10 + k), -1))
    most = int(n.max()) if len(n) else 0
    for j in range(max(0, most - 2)):
        out.append(np.where(n >= j + 3, _hash([c[:, j], c[:, j + 1], c[:, j + 2]], 20), -1))
    return np.stack(out, 1)


def train(rows: list[tuple[str, str]], rounds: int = 20) -> tuple[Model, list[str]]:
    """A word model from (text, language); every word of a text counts as of its language."""
    langs = sorted({lang for _, lang in rows})
    seen: dict[str, int] = {}
    items, labels, lengths = [], [], []
    for text, lang in rows:
        words = words_of(text)
        items += [seen.setdefault(w, len(seen)) for w in words]
        labels += [langs.index(lang)] * len(words)
        lengths.append(len(words))
    if not items:
        return Model(np.zeros((FEATURES, len(langs))), np.zeros((len(langs), len(langs)))), langs
    lengths = np.array(lengths)
    # every document weighs the same whatever its length
    weight = np.repeat(lengths.sum() / max(1, (lengths > 0).sum()) / np.maximum(lengths, 1), lengths)
    model = fit(word_features(list(seen)), None, np.array(labels), lengths, FEATURES, len(langs), np.array(items), rounds, weight=np.minimum(weight, 10.0))
    return model, langs


class WordScores(dict):
    """Word -> row of its emission scores; new words are scored together."""

    def __init__(self, model: Model):
        self.model, self.new, self.scores = model, [], np.zeros((0, model.trans.shape[0]))

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = out = len(self)
        return out

    def rows(self) -> np.ndarray:
        parts = [self.scores]
        for at in range(0, len(self.new), 20_000):
            f = word_features(self.new[at : at + 20_000])
            out = np.zeros((len(f), self.scores.shape[1]))
            for col in f.T:
                has = col >= 0
                out[has] += self.model.weights[col[has]]
            parts.append(out)
        self.scores, self.new = np.concatenate(parts) if len(parts) > 1 else self.scores, []
        return self.scores

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.new, self.scores = [], self.scores[:0]


def _label(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model, langs = shared.value
    cache = WordScores(model)

    def solve(ids: list[np.ndarray]) -> Iterator[tuple[str, float]]:
        lengths = np.array([len(x) for x in ids], np.int64)
        post, _, _ = posteriors(cache.rows()[np.concatenate(ids)] if lengths.sum() else np.zeros((0, max(1, len(langs)))), lengths, model.trans)
        ends = np.cumsum(lengths)
        for end, n in zip(ends, lengths, strict=True):
            if not n or not langs:
                yield "und", 0.0
            else:
                mean = post[end - n : end].mean(0)
                yield langs[int(mean.argmax())], float(min(1.0, mean.max()))

    for batch in batches:
        out: list[tuple[str, float]] = []
        held, size = [], 0
        for text in batch.column("text"):
            ids = np.fromiter(map(cache.__getitem__, words_of(text.as_py())), np.int64)
            held.append(ids)
            size += len(ids)
            if size > CHUNK:
                out += solve(held)
                held, size = [], 0
                cache.trim()
        if held:
            out += solve(held)
        cache.trim()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, training: DataFrame | None = None, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (columns doc_id and text).

    Learns from training (default docs; doc_id, text, lang), but never from held-out documents or null languages.
    score is the mean marginal of the predicted language over the words. Texts that are null or without a letter are
    `und` with score 0, as are all without anything to learn from. Null ids are not held out. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    training = docs if training is None else training
    model = spark.sparkContext.broadcast(train(sample(training, training, "lang", per_label)))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _label(it, model), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
