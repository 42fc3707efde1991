"""Quality of documents: a linear-chain CRF labels every line good or bad; its marginals, weighted by length, add up."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ready, table
from factloom.llm.crf import Model, fit, posteriors
from factloom.llm.training import held_out, sample

#: Documents of each label that the model learns from at most.
PER_LABEL = 1000
THRESHOLD = 0.7
CHUNK = 20_000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"!#$%&*|@^~<>=+_{}[]\\/"
MARKS = b".,;:?'\"()-"
#: Kinds of features of a line and buckets of each.
KINDS, BUCKETS = 12, 12
NEAR = (1, 2, 5, 6)
FEATURES = (KINDS + 2 * len(NEAR)) * BUCKETS + 1


def _share(part: int, whole: int) -> int:
    """0: none, then rising with the logarithm of the share, BUCKETS - 1: all."""
    if not part or not whole:
        return 0
    return max(1, min(BUCKETS - 1, BUCKETS - 1 + int(1.5 * np.log2(part / whole))))


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) numbers, -1: none, and the lines' lengths; at least one line, also for null and empty texts."""
    lines = (text or "").split("\n")
    times = Counter(lines)
    own = np.empty((len(lines), KINDS), np.int64)
    sizes = np.empty(len(lines))
    for k, line in enumerate(lines):
        b = line.encode("utf-8", "replace")
        n = len(b)
        words = line.split()
        upper, digits, symbols, marks = (n - len(b.translate(None, x)) for x in (UPPER, DIGITS, SYMBOLS, MARKS))
        letters = upper + n - len(b.translate(None, LOWER))
        count = max(1, len(words))
        low = [w.lower() for w in words]
        same = sum(x == y for x, y in zip(low, low[1:], strict=False))
        wide = n - len(line)
        sizes[k] = len(line)
        own[k] = (
            min(BUCKETS - 1, n.bit_length()), _share(upper, max(1, letters)), _share(symbols, n), _share(digits, n), _share(marks, n), _share(count - len(set(low)), count),
            _share(same, count), min(BUCKETS - 1, n // count), _share(times[line] - 1, len(lines)), _share(wide, n), min(BUCKETS - 1, len(words).bit_length()), int(line[-1:] in ".!?") + 2 * int(line[:1].isupper()),
        )
    base = own + np.arange(KINDS) * BUCKETS
    near = own[:, NEAR] + np.arange(len(NEAR)) * BUCKETS + KINDS * BUCKETS
    none = np.full((1, len(NEAR)), -1)
    before = np.concatenate([none, near[:-1]])
    after = np.concatenate([near[1:] + len(NEAR) * BUCKETS, none])
    return np.concatenate([base, before, after, np.full((len(lines), 1), FEATURES - 1)], 1), sizes


def _document_scores(model: Model, features: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    lengths = np.array([len(f) for f in features], np.int64)
    f = np.concatenate(features)
    scores = (model.weights[np.where(f >= 0, f, 0)] * (f >= 0)[..., None]).sum(1)
    good = posteriors(scores, lengths, model.trans)[0][:, 1]
    weight = np.concatenate(sizes) + 1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.clip(np.bincount(owner, good * weight, len(lengths)) / np.bincount(owner, weight, len(lengths)), 0, 1)


def train(rows: list[tuple[str, int]], rounds: int = 60) -> Model:
    """A line model from (text, 0 or 1); every line of a text counts as good or bad as the text."""
    if not rows:
        return Model(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    features = [line_features(text)[0] for text, _ in rows]
    lengths = np.array([len(f) for f in features])
    labels = np.repeat([int(bool(y)) for _, y in rows], lengths)
    # documents weigh the same whatever their number of lines
    weight = np.repeat(lengths.mean() / lengths, lengths)
    return fit(np.concatenate(features), None, labels, lengths, FEATURES, 2, rounds=rounds, rate=0.15, weight=np.clip(weight, 0.1, 10))


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        out, features, sizes, held = [np.zeros(0)], [], [], 0
        for text in batch.column("text"):
            f, n = line_features(text.as_py())
            features.append(f)
            sizes.append(n)
            held += len(f)
            if held > CHUNK:
                out.append(_document_scores(model, features, sizes))
                features, sizes, held = [], [], 0
        if features:
            out.append(_document_scores(model, features, sizes))
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.concatenate(out))], names=[*rest, "score"])


def model_for(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """The line model from at most per_label documents of each label, never held-out ones.

    Null ids, labels and texts and repeated rows are passed over as in training.sample(). With labels of one class all
    scores are near that class; without any, 0.5.
    """
    return train(sample(docs, labels.select("doc_id", "quality"), "quality", per_label))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) for every row of docs; null and empty texts are one empty line.

    Null ids are not held out; null or repeated ids give a row each. Other columns, whatever their names, are ignored. An
    empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _score(it, shared), "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; null texts are one empty line.

    Null and repeated ids are judged row by row; the columns may have any names; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [s.column("score").to_numpy() >= threshold for s in _score([batch.select(["text"])], shared)]
            yield batch.filter(pa.array(ok[0]))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, model_for(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
