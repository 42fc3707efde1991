"""Exact Jaccard self-join of documents on word shingles, by prefixes under several global token orders.

A pair with enough in common shares a token among the first p = n - ceil(t * n) + 1 of each set, whatever total order
of tokens is taken. Here every order puts the frequent tokens last, by levels of their counts; within a level each order goes by a hash of
its own.
Candidates meet in the first order's prefixes, must meet in the other orders' prefixes too, and are then verified on
the whole sets. Documents with equal sets are one node; of large prefix groups each member first meets a few pivots,
and only members that are still in different components meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import MOST_IDS, bit_of, bitmap, components, has_bit, hot_join, narrow, ready, table

WORDS = 5
PERCENT = 75
#: Tokens held as frequent at most (5 MB on the driver and in a broadcast). Any choice gives the same result.
FREQUENT = 1 << 19
#: Occurrences from which a token counts as frequent: within one flush of a task for it to be reported at all (tokens
#: outside COUNTED), and in all.
LOCAL_COUNT, TOTAL_COUNT = 3, 5
#: Share of the hash space in which every token is counted: prefixes take theirs from there unless most tokens are frequent.
COUNTED = 0.3
#: Tokens that a task holds before it flushes its counts; rows of sorted tokens or pairs that it holds at once.
FLUSH, PART = 1_000_000, 1 << 17
#: Bytes whose words are hashed at once; a longer word is hashed by itself.
SPAN = 1 << 20
#: Members that each member of a larger group meets at first.
PIVOTS = 8
#: Tokens by which a member of a larger group tells where else it meets another.
TOKENS = 16
#: Members of a block of a larger group that is still in several components.
BLOCK = 256
#: Up to this size all pairs of a prefix group are candidates at once.
SMALL_GROUP = 4
_U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15) * _U(seed + 1)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BYTE = mix(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], _U), 99)  # A-Z as a-z


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse for SPAN places: 16 MB for each worker, however long the texts are."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[_U(1), np.full(SPAN, x, _U)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, and how many words each text has.

    data: UTF-8 bytes; offsets: where each text begins, and the end. Words stand between ASCII white spaces and text
    ends; their hash is that of a polynomial over their bytes, taken from running sums over SPAN bytes at most; a word
    of more bytes has a hash of its own kind.
    """
    space = _SPACE[data]
    head, tail = ~space, ~space
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    open_, close = np.r_[True, space[:-1]], np.r_[space[1:], True]
    open_[first] = close[last] = True
    head &= open_
    tail &= close
    head, tail = np.flatnonzero(head), np.flatnonzero(tail)
    h = np.empty(len(head), _U)
    up, down = _powers()
    at = 0
    while at < len(head):
        begin = int(head[at])
        upto = int(np.searchsorted(tail, begin + SPAN))
        if upto > at:
            i, j = head[at:upto] - begin, tail[at:upto] - begin
            with np.errstate(over="ignore"):
                run = np.cumsum(_BYTE[data[begin : begin + int(j[-1]) + 1]] * up[: int(j[-1]) + 1])
                x = run[j] - np.where(i > 0, run[i - 1], _U(0))
                h[at:upto] = mix(x * down[i] + (j - i).astype(_U))
        else:
            upto = at + 1
            h[at] = xxhash.xxh3_64_intdigest(data[begin : int(tail[at]) + 1].tobytes().lower())
        at = upto
    return h, np.diff(np.searchsorted(head, offsets))


def shingle_sets(texts: list[bytes] | tuple[np.ndarray, np.ndarray], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; of the whole text if it has fewer words."""
    if isinstance(texts, list):
        texts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    w, counts = word_hashes(*texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(w) - k + 1), k, _U)
        for i in range(k):
            h = h * _U(0x100000001B3) + w[i : i + len(h)]
        h = mix(h)
        out = []
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= k:
                s = np.sort(h[end - n : end - k + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
            else:
                x = np.full(min(n, 1), n, _U)
                for i in range(n):
                    x = x * _U(0x100000001B3) + w[end - n + i : end - n + i + 1]
                out.append(mix(x, 7))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


class Frequent:
    """Levels of the frequent tokens, 0 for all others; a table of flags by low bits answers for most tokens."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        self.tokens, self.levels = tokens, levels
        self.flags = np.zeros(1 << 23, bool)
        self.flags[tokens & _U((1 << 23) - 1)] = True

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), _U)
        at = np.flatnonzero(self.flags[s & _U((1 << 23) - 1)])
        if len(at):
            where = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
            out[at] = np.where(self.tokens[where] == s[at], self.levels[where], 0)
        return out


def prefix(s: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    """The first tokens of a set under one order: by level of frequency, then by the order's own hash."""
    p = prefix_length(len(s))
    if p >= len(s):
        return s
    key = mix(s, order) >> _U(6) | level << _U(58)
    return s[np.argpartition(key, p - 1)[:p]]


def _sets(batch: pa.RecordBatch, take=None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, set) of the rows, half a megabyte of text at once."""
    ids, texts = batch.column("doc_id"), batch.column("text")
    rows = range(batch.num_rows) if take is None else take
    held, size = [], 0
    for i in rows:
        held.append((ids[i].as_py(), (texts[i].as_py() or "").encode("utf-8", "surrogatepass")))
        size += len(held[-1][1])
        if size >= 1 << 19:
            yield from zip((x for x, _ in held), shingle_sets([t for _, t in held]), strict=True)
            held, size = [], 0
    if held:
        yield from zip((x for x, _ in held), shingle_sets([t for _, t in held]), strict=True)


def _sliced(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """A large batch in parts, which the JVM takes one at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


SURVEY = "doc_id long, n long, digest binary, token long, cnt long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; counts of the tokens of a flush that are frequent in it, or whose first hash is low."""
    held, size = [], 0
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("token", pa.int64()), ("cnt", pa.int64())])

    def flush() -> Iterator[pa.RecordBatch]:
        token, cnt = np.unique(np.concatenate(held), return_counts=True)
        keep = (cnt >= LOCAL_COUNT) | (mix(token, 0) < _U(int(COUNTED * 2**64)))
        token, cnt = token[keep], cnt[keep]
        none = pa.nulls(len(token), pa.int64())
        yield from _sliced(pa.RecordBatch.from_arrays([none, none, pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(cnt)], schema=schema))

    for batch in batches:
        ids, ns, digests = [], [], []
        for i, s in _sets(batch):
            ids.append(i)
            ns.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            held.append(s)
            size += len(s)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(ids), pa.int64()), pa.array([1] * len(ids), pa.int64())], schema=schema)
    if held:
        yield from flush()


def _index(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """(token, doc_id, n) for the first order's prefix; a set that the task has just had is not given again."""
    seen, often = set(), Frequent(*frequent.value)
    for batch in batches:
        tokens, ids, ns = [], [], []
        for i, s in _sets(batch):
            if len(s) and i is not None:
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if digest not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digest)
                    tokens.append(prefix(s, often.of(s), 0))
                    ids.append(i)
                    ns.append(len(s))
        if tokens:
            each = [len(t) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), each)), pa.array(np.repeat(np.array(ns, np.int32), each))], names=["token", "doc_id", "n"])


PAIRS = "token long, a long, b long, n int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from rows sorted by token and n.

    token null: a pair (a, b) that shares a prefix token and fits by size, each once for a flush. token not null: a
    member a of a large group; only its pairs with the pivots are among the pairs. Pivots are the members with the
    smallest hashes, so that groups with the same members have the same pivots, and the smallest sets, which are the
    most like all others where the members share a core. A group of more rows than are held at once goes on in the
    next rows: all of them, however few, are members of the large group and meet the pivots of its first rows.
    """
    schema = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    open_token, open_pivots = None, []  # the group that goes on, and (id, n) of its pivots

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal pairs, size
        if pairs:
            a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            pairs, size = [], 0
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            a, b = a[new], b[new]
            yield from _sliced(pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32())], schema=schema))

    def keep(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> None:
        nonlocal size
        ok = (np.minimum(nx, ny).astype(np.int64) * 100 >= PERCENT * np.maximum(nx, ny).astype(np.int64)) & (x != y)
        if ok.any():
            x, y = x[ok], y[ok]
            pairs.append((np.minimum(x, y), np.maximum(x, y)))
            size += len(x)

    def groups(t: np.ndarray, d: np.ndarray, n: np.ndarray, goes_on: bool) -> Iterator[pa.RecordBatch]:
        """goes_on: rows of the last token may follow in the next call, so that it is a large group whatever its size."""
        nonlocal open_token, open_pivots
        edge = np.flatnonzero(np.diff(t)) + 1
        start, stop = np.r_[0, edge], np.r_[edge, len(t)]
        count = stop - start
        is_large = count > SMALL_GROUP
        carried = open_token is not None and t[0] == open_token
        is_large[0] |= carried
        is_large[-1] |= goes_on
        large = np.repeat(is_large, count)
        for k in range(1, SMALL_GROUP):
            at = np.flatnonzero((t[k:] == t[:-k]) & ~large[k:])
            keep(d[at], d[at + k], n[at], n[at + k])
        at = np.flatnonzero(large)
        held = open_pivots if carried else []
        open_token, open_pivots = (t[-1], []) if goes_on else (None, [])
        if len(at):
            many = np.flatnonzero(is_large)
            group = np.repeat(np.arange(len(many)), count[many])
            for r in range(PIVOTS):
                h = mix(d[at].view(_U), 1000 + r)
                if r % 2:
                    h = h >> _U(32) | n[at].astype(_U) << _U(32)
                low = np.minimum.reduceat(h, np.r_[0, np.cumsum(count[many])[:-1]])
                pivot = np.zeros(len(many), np.int64)
                hit = np.flatnonzero(h == low[group])
                pivot[group[hit]] = at[hit]
                pid, pn = d[pivot], n[pivot]
                if carried:
                    pid[0], pn[0] = held[r]
                if goes_on:
                    open_pivots.append((pid[-1], pn[-1]))
                keep(pid[group], d[at], pn[group], n[at])
                if size >= FLUSH // 2:
                    yield from flush()
            yield from _sliced(pa.RecordBatch.from_arrays([pa.array(t[at]), pa.array(d[at]), pa.nulls(len(at), pa.int64()), pa.array(n[at])], schema=schema))
        if size >= FLUSH // 2:
            yield from flush()

    held: list[list[np.ndarray]] = []
    rows = 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate([h[k] for h in held]) for k in range(3)]

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("token", "doc_id", "n")])
        rows += batch.num_rows
        if rows < PART:
            continue
        cols = joined()
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # rows of the last token may follow in the next batch
        goes_on = not last
        last = last or rows
        yield from groups(*(c[:last] for c in cols), goes_on)
        held, rows = [[c[last:].copy() for c in cols]], rows - last
    if rows:
        yield from groups(*joined(), False)
    yield from flush()


def _sketches(batches: Iterator[pa.RecordBatch], frequent, bits) -> Iterator[pa.RecordBatch]:
    """Of the documents whose bit is set: size, prefixes under a second and third order as 32-bit hashes, and a bit set."""
    often = Frequent(*frequent.value)
    for batch in batches:
        rows = []
        for i, s in _sets(batch, has_bit(bits.value, batch.column("bit").to_numpy()).nonzero()[0]):
            if len(s) and i is not None:
                level = often.of(s)
                marks = np.zeros(1 << max(6, (len(s) * 8 - 1).bit_length()), np.uint8)
                marks[(s & _U(len(marks) - 1)).astype(np.int64)] = 1
                rows.append((i, len(s), *((prefix(s, level, k) >> _U(32)).astype(np.uint32).view(np.int32) for k in (1, 2)), np.packbits(marks).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["id", "n", "p", "q", "marks"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that meet in both other orders and whose bit sets allow for enough shared tokens."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        cols = [batch.column(c) for c in ("na", "nb", "pa", "pb", "qa", "qb", "ma", "mb")]
        for i in range(batch.num_rows):
            na, nb = cols[0][i].as_py(), cols[1][i].as_py()
            pa_, pb, qa, qb = (cols[k][i].values.to_numpy() for k in range(2, 6))
            if np.isin(pa_, pb).any() and np.isin(qa, qb).any():
                x, y = (np.frombuffer(cols[k][i].as_buffer(), np.uint8) for k in (6, 7))
                if len(x) != len(y):  # the longer is a refinement: fold it
                    x, y = (v.reshape(-1, min(len(x), len(y))) for v in (x, y))
                    x, y = np.bitwise_or.reduce(x, 0), np.bitwise_or.reduce(y, 0)
                both = int(np.bitwise_count(x & y).sum())
                most = both + min(na - int(np.bitwise_count(x).sum()), nb - int(np.bitwise_count(y).sum()))
                keep[i] = most * 100 >= PERCENT * (na + nb - most)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in "ab"], names=["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """The sets of the documents whose bit is set."""
    for batch in batches:
        take = has_bit(bits.value, batch.column("bit").to_numpy()).nonzero()[0]
        for at in range(0, len(take), 512):
            rows = [(i, s) for i, s in _sets(batch, take[at : at + 512]) if len(s) and i is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))], names=["id", "s"])


def _close(x: dict, y: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs, of one block (y None) or between two, that may link by sizes and bit sets and are not joined yet.

    A pair is given in the group of the smallest token that it is known to share (each row holds its smallest TOKENS
    tokens), so most pairs are given once, and none is lost.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    other = x if y is None else y

    def folded(d: dict, rows: np.ndarray, w: int) -> np.ndarray:
        """Bit sets as rows of 64-bit words, folded to w bits."""
        return np.array([np.bitwise_or.reduce(np.frombuffer(d["marks"][r], np.uint8).reshape(-1, w // 8), 0) for r in rows]).view(_U)

    for w in sorted(set(x["width"]) | set(other["width"])):
        for wx, wy in ((w, w), (w, 2 * w), (2 * w, w)):  # sizes of a pair differ by less than the factor 2
            i, j = np.flatnonzero(x["width"] == wx), np.flatnonzero(other["width"] == wy)
            if not len(i) or not len(j) or y is None and wx > wy:
                continue
            b, nb, cb = folded(other, j, w), other["n"][j], other["c"][j]
            spare_b = nb - np.bitwise_count(b).sum(1, dtype=np.int64)
            for r in i:  # a row against the block: memory for one copy of the block
                a, na = folded(x, np.array([r]), w)[0], x["n"][r]
                ok = (cb != x["c"][r]) & (np.minimum(na, nb) * 100 >= PERCENT * np.maximum(na, nb))
                if y is None and wx == wy:
                    ok &= j > r
                at = np.flatnonzero(ok)
                if len(at):
                    most = np.bitwise_count(a & b[at]).sum(1, dtype=np.int64) + np.minimum(na - int(np.bitwise_count(a).sum()), spare_b[at])
                    hit = j[at[most * 100 >= PERCENT * (na + nb[at] - most)]]
                    if len(hit):
                        mine, token = set(x["tokens"][r]), x["token"][0]
                        hit = np.array([q for q in hit if min(mine.intersection(other["tokens"][q]), default=token) >= token], np.int64)
                        out.append((np.full(len(hit), x["a"][r]), other["a"][hit]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of _close() within groups of equal token, lo and hi, from sorted rows; a group has two blocks at most."""
    held: pa.Table | None = None

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {k: t.column(k).to_numpy() for k in ("token", "lo", "hi", "side", "a", "n", "c")}
        marks, tokens = t.column("marks").to_pylist(), np.empty(len(t), object)
        tokens[:] = t.column("tokens").to_pylist()
        start = np.flatnonzero(np.r_[True, np.logical_or.reduce([np.diff(cols[k]) != 0 for k in ("token", "lo", "hi")])])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(start, np.r_[start[1:], len(t)], strict=True):
            rows = {k: v[s:e] for k, v in cols.items()} | {"tokens": tokens[s:e], "marks": np.array(marks[s:e], object), "width": np.array([8 * len(m) for m in marks[s:e]])}
            if e - s < 2 or (rows["c"] == rows["c"][0]).all():
                continue
            if rows["lo"][0] == rows["hi"][0]:
                found.append(_close(rows, None))
            else:
                x, y = ({k: v[rows["side"] == z] for k, v in rows.items()} for z in (0, 1))
                if len(x["a"]) and len(y["a"]):
                    found.append(_close(x, y))
        if found:
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        keys = [held.column(k).to_numpy() for k in ("token", "lo", "hi")]
        same = np.logical_and.reduce([k == k[-1] for k in keys]) if len(held) else np.zeros(0, bool)
        cut = int(np.argmax(same)) if len(held) else 0
        if cut:
            yield from solve(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and len(held):
        yield from solve(held)


def _candidates(docs: DataFrame, ids: DataFrame):
    """docs with the place of each doc_id in a bitmap of the ids, and the broadcast bitmap; other documents are to be skipped.

    With too many ids for a bitmap the documents are semi-joined with them instead, and the bitmap lets all pass.
    """
    n = ids.count()
    if n <= MOST_IDS:
        words = bitmap(ids, "id", n)
    else:
        docs, words = docs.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), np.full(1, 0xFFFFFFFF, np.uint32)
    return docs.withColumn("bit", bit_of(F.col("doc_id"), words)), docs.sparkSession.sparkContext.broadcast(words)


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b"))


SKETCH = "id long, n long, p array<int>, q array<int>, marks binary"


def _verified(pairs: DataFrame, docs: DataFrame, frequent, name: str) -> DataFrame:
    """(a, b, shared, sizes) of the pairs that the filters leave: of whole sets, shared tokens and the sum of sizes."""

    def both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(rows.select(F.col("id").alias(c), *(F.col(x).alias(f"{x[0]}{c}") for x in rows.columns if x != "id")), c)
        return pairs

    keyed, bits = _candidates(docs, _ids(pairs))
    left = narrow(both(pairs, keyed.mapInArrow(lambda it: _sketches(it, frequent, bits), SKETCH)), f"{name}-left", _may_link, "a long, b long")
    bits.unpersist()
    keyed, few = _candidates(docs, _ids(left))
    found = both(left, keyed.mapInArrow(lambda it: _whole(it, few), "id long, s array<long>")).select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), (F.size("sa") + F.size("sb")).cast("long").alias("sizes"))
    found = narrow(found, name)
    few.unpersist()
    return found


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (columns doc_id and text; others are ignored).

    Two documents link when 100 * shared >= 75 * union of their sets of 5-word shingles (64-bit hashes; a text with
    fewer words is one shingle). Null, empty and blank texts have no shingles and link with nothing. Rows with a
    null doc_id get a null component. Rows that repeat a doc_id are one node. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    surveyed = docs.mapInArrow(_survey, SURVEY)
    rows_of = F.when(F.col("token").isNull(), F.monotonically_increasing_id())  # a document's row stays one; tokens are summed
    counted = surveyed.withColumn("row", rows_of).groupBy("doc_id", "n", "digest", "token", "row").agg(F.sum("cnt").alias("cnt"))
    survey = narrow(counted.where(F.col("token").isNull() | (F.col("cnt") >= TOTAL_COUNT)), "survey")
    top = survey.where("token is not null").orderBy(F.desc("cnt"), "token").limit(FREQUENT)
    top = top.select("token", F.floor(F.log2("cnt") * 2).cast("int").alias("level")).toPandas()
    token = top["token"].to_numpy().view(_U)
    by = np.argsort(token)
    frequent = sc.broadcast((token[by], np.minimum(top["level"].to_numpy()[by], 62).astype(_U)))
    rows = survey.where("token is null").select("doc_id", "n", "digest")
    reps = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    named = narrow(hot_join(rows, reps, "digest", "doc_id", rows.count(), "left").select("doc_id", "n", "rep"), "named")

    index = docs.mapInArrow(lambda it: _index(it, frequent), "token long, doc_id long, n int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = narrow(index.repartition(parts, "token").sortWithinPartitions("token", "n", "doc_id"), "pairs", _pairs, PAIRS, compact=False)
    rep_of = named.where("rep is not null").select("doc_id", "rep").distinct()

    def represented(pairs: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(rep_of.select(F.col("doc_id").alias(c), F.col("rep").alias(f"r{c}")), c)
        return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()

    pairs = narrow(represented(found.where("token is null").select("a", "b").distinct()), "reps")
    big = found.where("token is not null")
    tested = _verified(pairs, docs, frequent, "tested")
    enough = F.col("shared") * 100 >= PERCENT * (F.col("sizes") - F.col("shared"))
    links = tested.where(enough).select("a", "b")
    comp = components(links)

    # Members of large groups that are still in different components meet in blocks of their groups. The members of a
    # group's largest component meet only those of the others, so that a group that is nearly one component, however
    # large, gives rows in proportion to its size times the others' blocks.
    rest = big.select("token", F.col("a").alias("doc_id")).join(rep_of, "doc_id").select("token", F.col("rep").alias("a")).distinct()
    rest = rest.join(comp, F.col("a") == F.col("node"), "left").select("token", "a", F.coalesce("component", "a").alias("c"))
    sizes = rest.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("size"))
    cuts = lambda k: F.ceil(k / BLOCK).cast("int")
    mixed = sizes.where("size > most").select("token", "main", (F.col("size") <= BLOCK).alias("one"), cuts(F.col("most")).alias("mains"), cuts(F.col("size") - F.col("most")).alias("others"))
    rest = narrow(hot_join(rest, mixed, "token", "a", big.count()), "rest")
    if rest.take(1):
        keyed, bits = _candidates(docs, rest.select(F.col("a").alias("id")))
        sketches = keyed.mapInArrow(lambda it: _sketches(it, frequent, bits), SKETCH).select(F.col("id").alias("a"), "n", "marks")
        own = F.collect_list("token").over(Window.partitionBy("a"))  # at most a document's prefix
        named_all = rest.withColumn("tokens", F.slice(F.sort_array(own), 1, TOKENS))
        is_main = F.col("c") == F.col("main")
        placed = named_all.join(sketches, "a").withColumn("cut", F.pmod(F.xxhash64("a"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
        # (lo, hi): blocks of others, the lower one first, or -1 - k for block k of the largest component and a block of
        # others; a group of BLOCK members at most is one block
        span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        with_main = lambda lo, hi, side: F.struct((-1 - lo).alias("lo"), hi.alias("hi"), F.lit(side).alias("side"))
        cut = F.col("cut")
        alone = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side")))
        meets = F.when(F.col("one"), alone).when(is_main, F.transform(span("others"), lambda k: with_main(cut, k, 0))).otherwise(
            F.concat(F.transform(span("mains"), lambda k: with_main(k, cut, 1)), F.transform(span("others"), lambda k: F.struct(F.least(cut, k).alias("lo"), F.greatest(cut, k).alias("hi"), (cut > k).cast("int").alias("side"))))
        )
        placed = placed.withColumn("at", F.explode(meets)).select("token", "at.lo", "at.hi", "at.side", "a", "n", "c", "marks", "tokens")
        near = placed.repartition(parts, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(_near, "a long, b long")
        more = narrow(near.distinct().join(pairs, ["a", "b"], "left_anti"), "more")
        bits.unpersist()
        extra = _verified(more, docs, frequent, "extra").where(enough).select("a", "b")
        comp = components(links.unionAll(extra))
    frequent.unpersist()
    return named.join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
