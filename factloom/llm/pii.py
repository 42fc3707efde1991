"""Personal data by a skip-chain conditional random field over the sentences that can hold any.

Only tokens with a digit or an @ can be part of an entity. The chain holds each of them with the words of its sentence
around it; words further off are O whatever stands beside them. The chain's potentials are learned from the spans
that the base patterns find in a bounded sample of documents. Tokens of a document that repeat, or that have the same
digits or the same last digits, share a skip potential, one for each kind of link, learned as well; loopy message
passing over chain and skip edges makes their labels agree. Spans of the base patterns always stay; the field adds others.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ready, table
from factloom.llm.crf import Model, fit
from factloom.llm.training import held_out, smallest, texts_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, each from the first sign of a run on and without giving back what it took, which
#: finds the same matches and takes time in proportion to the text. The e-mail pattern is cut at its @.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Documents with candidate tokens that the field learns from at most.
SAMPLE = 1500
FEATURES = 1 << 14
#: Words of a sentence on either side of a candidate that stand on its chain.
CONTEXT = 12
#: Kinds of links: the same token, the same digits (so many at least), the same last digits.
LINKS, DIGITS = 3, 7
#: Rounds of message passing; belief from which a token counts; skip potential before learning and its weight as a prior.
ROUNDS, BELIEF, SKIP, PRIOR = 12, 0.9, 1.0, 0.02
#: Gradient steps for the skip potentials and their size.
STEPS, RATE = 15, 5.0
_CANDIDATE = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
#: Longer tokens, in runs without white space, are split at what is no part of an entity.
LONG = 400
_PIECE = re.compile(r"[^\s,;:!?(){}\[\]<>\"'|*&$#=¡¿/\\]+")
_EDGE = ".,;:!?()[]{}<>\"'|*&%$#=¡¿"


@dataclass
class Field:
    """The chain and the skip potentials of the kinds of links."""

    chain: Model
    skip: np.ndarray


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and non-overlapping, from each @ to both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = text[done:at]
        start = done + len(local.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in found.split("."))
    number = re.sub(r"[^0-9]", "", found)
    return 9 <= len(number) <= 15 if kind == "phone" else 12 <= len(number) <= 19 and luhn(number)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' valid matches, in order; kinds as in KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for k, kind in enumerate(KINDS[1:], 1):
            if kind != "phone" or "+" in text:
                out += [(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if _valid(kind, m[0])]
    return sorted(out)


def _shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: "9" * min(len(m[0]), 5), token[:200]))[:40]


@dataclass
class Token:
    """A token without the signs at its edges. joined: the one before it on the list stands before it on its chain."""

    start: int
    end: int
    text: str
    candidate: bool
    joined: bool


def tokens(text: str) -> list[Token]:
    """The tokens with a digit or an @, and the words of their sentences up to CONTEXT away, in order.

    Sentences end with lines and with tokens that end in . ! or ?. A token of more than LONG characters gives its
    pieces with a digit or an @ between punctuation instead, each on a chain of its own.
    """
    out: list[Token] = []
    at = 0
    for line in text.split("\n"):
        if _CANDIDATE.search(line):
            sentence: list[tuple[int, str]] = []
            for m in _TOKEN.finditer(line):
                sentence.append((at + m.start(), m[0]))
                if m[0][-1] in ".!?":
                    _sentence(sentence, out)
                    sentence = []
            _sentence(sentence, out)
        at += len(line) + 1
    return out


def _sentence(words: list[tuple[int, str]], out: list[Token]) -> None:
    hits = [k for k, (_, w) in enumerate(words) if _CANDIDATE.search(w)]
    last = -2  # number of the word whose token ends the list
    for n, hit in enumerate(hits):
        upto = min(hit + CONTEXT, len(words) - 1, hits[n + 1] - 1 if n + 1 < len(hits) else len(words))
        for k in range(max(last + 1, hit - CONTEXT, 0), upto + 1):
            start, w = words[k]
            if len(w) > LONG:
                if k == hit:
                    for p in _PIECE.finditer(w):
                        piece = p[0].strip(_EDGE)
                        if piece and _CANDIDATE.search(piece):
                            begin = start + p.start() + len(p[0]) - len(p[0].lstrip(_EDGE))
                            out.append(Token(begin, begin + len(piece), piece, True, False))
                last = -2 if k < upto else last
                continue
            core = w.strip(_EDGE) or w
            begin = start + w.index(core)
            out.append(Token(begin, begin + len(core), core, _CANDIDATE.search(core) is not None, last == k - 1))
            last = k


def _features(text: str, toks: list[Token]) -> np.ndarray:
    """Feature numbers of each token: its word or shape, lengths and signs, its neighbours', the signs around it."""
    shapes = [_shape(t.text) if t.candidate else t.text[:40].casefold() for t in toks]
    out = np.empty((len(toks), 9), np.int64)
    for k, t in enumerate(toks):
        said = t.text
        digits = len(re.sub(r"[^0-9]", "", said)) if t.candidate else 0
        before = shapes[k - 1] if t.joined else ""
        after = shapes[k + 1] if k + 1 < len(toks) and toks[k + 1].joined else ""
        marks = "".join(sorted(set(said) & set("@+-.():=/_")))
        names = (f"s{shapes[k]}", f"d{min(digits, 20)}", f"l{min(len(said), 40)}", f"m{marks}", f"b{before}", f"a{after}", f"w{int(t.candidate)}", f"x{text[t.start - 1 : t.start]}{text[t.end : t.end + 1]}", f"c{digits >= 12 and luhn(re.sub('[^0-9]', '', said))}")
        out[k] = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]
    return out


def _gold(toks: list[Token], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Labels: 0, or 1 + the kind of the span that the token overlaps; spans in order."""
    out, first = np.zeros(len(toks), np.int64), 0
    for k, t in enumerate(toks):
        while first < len(spans) and spans[first][2] <= t.start:
            first += 1
        n = first
        while t.candidate and n < len(spans) and spans[n][0] < t.end:
            if t.start < spans[n][2]:
                out[k] = spans[n][1] + 1
                break
            n += 1
    return out


def _links(toks: list[Token]) -> list[tuple[int, int, int]]:
    """(i, j, kind): each candidate with the last one before it that is the same ignoring case (0), has the same DIGITS
    or more digits (1), or stands at the same place from the right in a run of candidates that ends in the same DIGITS
    digits (2). The strongest kind of a pair counts."""
    digits = [re.sub(r"[^0-9]", "", t.text) if t.candidate else "" for t in toks]
    last: dict[tuple, int] = {}
    out: dict[tuple[int, int], int] = {}
    tail, places = "", [0] * len(toks)
    ends: dict[int, str] = {}  # last digits of the run that a candidate is in
    for k in range(len(toks) - 1, -1, -1):
        joined = k + 1 < len(toks) and toks[k + 1].joined and toks[k + 1].candidate
        if toks[k].candidate:
            places[k] = places[k + 1] + 1 if joined else 0
            tail = (digits[k] + tail)[-DIGITS:] if joined else digits[k][-DIGITS:]
            ends[k] = tail
    for k in range(1, len(toks)):  # a run's digits are known at its first token
        if toks[k].candidate and toks[k].joined and toks[k - 1].candidate:
            ends[k] = ends[k - 1]
    for k, t in enumerate(toks):
        if t.candidate:
            keys = [(0, t.text.casefold())]
            keys += [(1, digits[k])] if len(digits[k]) >= DIGITS else []
            keys += [(2, ends[k], places[k], digits[k][-DIGITS:])] if len(ends[k]) == DIGITS and digits[k] else []
            for key in keys:
                if key in last:
                    out.setdefault((last[key], k), key[0])
                last[key] = k
    return sorted((i, j, kind) for (i, j), kind in out.items())


class Graph:
    """Chain and skip edges of many documents, in both directions, for message passing."""

    def __init__(self, docs: list[list[Token]], links: list[list[tuple[int, int, int]]]):
        chain, skip, at = [], [], 0
        for toks, found in zip(docs, links, strict=True):
            chain += [(at + k - 1, at + k) for k, t in enumerate(toks) if t.joined]
            skip += [(at + i, at + j, kind) for i, j, kind in found]
            at += len(toks)
        self.n = at
        self.skip = np.array(skip, np.int64).reshape(-1, 3)
        c, s = np.array(chain, np.int64).reshape(-1, 2), self.skip[:, :2]
        self.src, self.dst = np.concatenate([c[:, 0], c[:, 1], s[:, 0], s[:, 1]]), np.concatenate([c[:, 1], c[:, 0], s[:, 1], s[:, 0]])
        n, m = len(c), len(s)
        self.back = np.r_[np.arange(n) + n, np.arange(n), 2 * n + m + np.arange(m), 2 * n + np.arange(m)]
        #: Which potential an edge has: 0 and 1 the transitions and their transpose, 2 + kind a skip potential.
        self.kind = np.r_[np.zeros(n, np.int64), np.ones(n, np.int64), 2 + self.skip[:, 2], 2 + self.skip[:, 2]]


def beliefs(scores: np.ndarray, graph: Graph, trans: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Loopy sum-product: beliefs (n, k) of the nodes and, for each skip edge, that of both ends having the same label.

    Without cycles enough rounds are exact. skip: log potential of equal labels, for each kind of link.
    """
    n, k = scores.shape
    log_phi = scores - scores.max(1, keepdims=True)
    potentials = np.exp(np.stack([trans, trans.T, *(w * np.eye(k) for w in skip)]))
    message = np.full((len(graph.src), k), 1.0 / k)

    def gathered() -> np.ndarray:
        return log_phi + np.stack([np.bincount(graph.dst, np.log(message[:, c]), n) for c in range(k)], 1) if len(message) else log_phi

    def without_answer() -> np.ndarray:
        """What each edge's source knows but for what the edge's other end has told it."""
        out = gathered()[graph.src] - np.log(message[graph.back])
        return np.exp(out - out.max(1, keepdims=True))

    for _ in range(rounds if len(message) else 0):
        known = without_answer()
        new = np.empty_like(message)
        for p, potential in enumerate(potentials):
            of = graph.kind == p
            new[of] = known[of] @ potential
        new = np.maximum(new / new.sum(1, keepdims=True), 1e-30)
        done = np.abs(new - message).max() < 1e-6
        message = 0.5 * message + 0.5 * new if len(graph.skip) else new
        if done:
            break
    b = gathered()
    b = np.exp(b - b.max(1, keepdims=True))
    agree = np.zeros(len(graph.skip))
    if len(graph.skip):
        known = without_answer()[-2 * len(graph.skip) :].reshape(2, -1, k)
        both = known[0][:, :, None] * known[1][:, None] * potentials[2 + graph.skip[:, 2]]
        agree = np.trace(both, axis1=1, axis2=2) / both.sum((1, 2))
    return b / b.sum(1, keepdims=True), agree


def train(texts: list[str]) -> Field:
    """The field from texts, labelled by the base patterns: first the chain, exactly, then the skip potentials.

    A token without a base span that is linked to one with a span has no known label, as the patterns may have missed it:
    it counts neither for nor against. For the skip potentials the own features of one end of each link are hidden, so that
    a potential grows as far as the other end's label tells the hidden one's: gradient steps on the links' observed less
    expected agreement, with a weak prior.
    """
    docs = [(t, toks) for t in texts if (toks := tokens(t))]
    k = len(KINDS) + 1
    start = np.full(LINKS, SKIP)
    if not docs:
        return Field(Model(np.zeros((FEATURES, k)), np.zeros((k, k))), start)
    features = np.concatenate([_features(t, toks) for t, toks in docs])
    labels = np.concatenate([_gold(toks, base_spans(t)) for t, toks in docs])
    graph = Graph([toks for _, toks in docs], [_links(toks) for _, toks in docs])
    known = np.ones(len(labels), bool)
    for a, b in ((0, 1), (1, 0)):
        i, j = graph.skip[:, a], graph.skip[:, b]
        known[i[(labels[i] == 0) & (labels[j] > 0)]] = False
    first = np.flatnonzero([not x.joined for _, toks in docs for x in toks])
    chain = fit(features, None, labels, np.diff(np.r_[first, len(labels)]), FEATURES, k, rounds=60, weight=known.astype(float))
    skip = start.copy()
    both = known[graph.skip[:, 0]] & known[graph.skip[:, 1]]
    if both.any():
        scores = chain.weights[features].sum(1)
        scores[graph.skip[both, 1]] = 0
        kind, observed = graph.skip[both, 2], labels[graph.skip[both, 0]] == labels[graph.skip[both, 1]]
        count = np.bincount(kind, minlength=LINKS)
        for _ in range(STEPS):
            gap = np.bincount(kind, observed - beliefs(scores, graph, chain.trans, skip, 4)[1][both], LINKS)
            skip += RATE * (gap / np.maximum(count, 1) - PRIOR * (skip - start) / np.maximum(1, count / 20))
    return Field(chain, skip)


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    docs = [tokens(t) if _CANDIDATE.search(t) else [] for t in texts]
    graph = Graph(docs, [_links(toks) for toks in docs])
    if not graph.n:
        return [(b, b) for b in base]
    features = np.concatenate([_features(t, toks) for t, toks in zip(texts, docs, strict=True) if toks])
    belief, _ = beliefs(field.chain.weights[features].sum(1), graph, field.chain.trans, field.skip)
    label, sure = belief.argmax(1), belief.max(1) >= BELIEF
    out, first = [], 0
    for b, toks in zip(base, docs, strict=True):
        taken = _gold(toks, b) if toks else ()
        added: list[list[int]] = []
        for k, t in enumerate(toks):
            y = int(label[first + k])
            if y and t.candidate and sure[first + k] and not taken[k]:
                if added and t.joined and added[-1][1] == y - 1 and added[-1][3] == k - 1:
                    added[-1][2], added[-1][3] = t.end, k
                else:
                    added.append([t.start, y - 1, t.end, k])
        first += len(toks)
        out.append((b, sorted(b + [(s, k, e) for s, k, e, _ in added])))
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of overlapping spans, as the first one's kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def model_for(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field from at most `sample` documents with candidate tokens, by hash of doc_id; never held-out ones."""
    rows = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct().withColumn("all", F.lit(1))
    return train([t for _, t in texts_of(docs, [r["doc_id"] for r in smallest(rows, "all", sample)])])


#: Characters of texts whose tokens are on one graph, so that memory follows the longest text and not the batch.
CHARS = 2_000_000


def _found(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    out, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHARS:
            out += find(part, field)
            part, size = [], 0
    return out + find(part, field)


def _spans(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _found([t or "" for t in batch.column("text").to_pylist()], shared.value)
        counts = [[sum(k == x for _, x, _ in b) for b, _ in found] for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(said(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([said(a) for _, a in found], pa.string())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )


def detect(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs (columns doc_id and text).

    Null texts count as empty: no spans. Null or repeated ids give a row each. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or model_for(docs))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _spans(it, shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """docs with all spans masked in text and n_chars, where there is such a column, set anew.

    Null texts stay null and empty ones empty. Null ids and repeated rows stay, a row each; other columns, whatever their
    names, are passed on; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or model_for(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = [None if t is None else mask(t, a) for t, (_, a) in zip(texts, _found([t or "" for t in texts], shared.value), strict=True)]
            cols = {"text": pa.array(new, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in new], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols.get(c, batch.column(c)) for c in batch.schema.names], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
