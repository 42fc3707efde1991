"""Packing of token sequences into as few bins as possible: best fit, then swap-based local search.

Only the histogram of lengths (at most `limit` numbers, whatever the input) reaches the driver. There bins are
held as patterns with a multiplicity. Best fit adds at most a few patterns for each length, so the plan that is
broadcast is bounded by the limit (some 5 * limit patterns), not by the rows. The pieces find their bins by their rank among pieces of equal length, with salted windows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice
from pathlib import Path
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import ready, table, written
from factloom.llm.token_counts import tokenizer_path

LIMIT = 4096
#: Tokenizer files for which WordIds gives the library's ids.
BY_WORDS = ("word_bpe_49k.json",)
#: Entries of a worker's word cache, some 200 bytes each; when it is full, the first ones stay, which are mostly the frequent ones.
CACHE_WORDS, KEPT_WORDS = 300_000, 150_000
#: Texts that are split into words at once.
TEXTS = 500
#: Exchanges that the local search looks at before it stops, on the driver.
WORK = 60_000_000
#: Rows of one salted rank window: a thousandth of all, between these bounds.
LEAST_ROWS, WINDOW_ROWS = 250, 50_000
#: Letters that are one word for the tokenizer and its normaliser only lower-cases, and marks that are another word.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?;:%&*$#|()"


class Merges:
    """The model's merges as arrays, for many words of one length at once.

    As in the library, each step of a word joins its leftmost pair of the lowest rank. The words that still have one have all
    made as many steps and so have equally many symbols.
    """

    #: Signs of a word at most, slots of the hash table of pairs, and the rank of what is no merge.
    MOST, SLOTS, NONE = 32, 1 << 20, 1 << 25

    def __init__(self, vocab: dict[str, int], merges: list, signs: dict[int, str], end: str):
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        self.first, self.last = (np.array([vocab[signs[b] + e] for b in range(256)], np.uint32) for e in ("", end))
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.keys, self.ranks = np.full(self.SLOTS, 0xFFFFFFFF, np.uint32), np.full(self.SLOTS, self.NONE, np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] != 0xFFFFFFFF:
                at = (at + 1) % self.SLOTS
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761) >> np.uint32(12)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << np.uint32(16) | b
        at = self._slot(keys)
        out, found = self.ranks[at], self.keys[at]
        other = found != keys  # free slots, and those of other pairs, behind which this one may stand
        out[other] = self.NONE
        open_ = np.nonzero(other & (found != 0xFFFFFFFF))
        at, keys = at[open_], keys[open_]
        while len(at):
            at = (at + 1) % self.SLOTS
            found = self.keys[at]
            same = found == keys
            out[tuple(x[same] for x in open_)] = self.ranks[at[same]]
            left = ~same & (found != 0xFFFFFFFF)
            at, keys, open_ = at[left], keys[left], tuple(x[left] for x in open_)
        return out

    def encode(self, words: np.ndarray) -> list[bytes]:
        """The ids of words of one length, from 1 to MOST bytes, a row of bytes for each."""
        flat = words.T
        symbols = np.concatenate([self.first[flat[:-1]], self.last[flat[-1:]]])
        ranks, live, out = self.rank(symbols[:-1], symbols[1:]), np.arange(len(words)), [b""] * len(words)
        while True:
            places = np.arange(len(ranks), dtype=np.int32)[:, None]
            least = (ranks << 5 | places).min(0) if len(ranks) else np.full(len(live), self.NONE << 5, np.int32)
            more = least < self.NONE << 5
            if not more.all():
                ids, size = symbols[:, ~more].T.astype("<u4").tobytes(), 4 * len(symbols)
                for k, i in enumerate(live[~more].tolist()):
                    out[i] = ids[k * size : (k + 1) * size]
                if not more.any():
                    return out
                symbols, ranks, live, least = symbols[:, more], ranks[:, more], live[more], least[more]
            at, row = least & 31, np.arange(len(live))
            symbols = np.where(places > at, symbols[1:], symbols[:-1])
            symbols[at, row] = self.joined[least >> 5]
            ranks = np.where(places[:-1] >= at, ranks[1:], ranks[:-1])
            for k in (at - 1, at):
                has = (k >= 0) & (k < len(ranks))
                i, j = k[has], row[has]
                ranks[i, j] = self.rank(symbols[i, j], symbols[i + 1, j])


class WordIds(dict):
    """Word -> its token ids as little-endian unsigned 32-bit bytes, words being split at spaces and line feeds.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words in turn;
    letters and the punctuation behind them are split as well. Arrow splits texts and finds their different words, so only
    these are looked up here one by one; new ones are encoded many at a time.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_path(name))
        self.bpe = self.model.model
        # the signs that stand for bytes: printable Latin-1 for itself, the others from U+0100 on, in order
        own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
        self.signs = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        parts = json.loads(Path(tokenizer_path(name)).read_bytes())
        self.as_is = rf"[^\x{{00}}-\x{{ff}}]|(?i:{'|'.join(re.escape(x['content']) for x in parts['added_tokens'])})"
        self.merges = Merges(parts["model"]["vocab"], parts["model"]["merges"], self.signs, parts["model"]["end_of_word_suffix"])

    def learn(self, words: pa.Array) -> None:
        """Encode these different words; those of letters must be lower-case."""
        plain = pc.match_substring_regex(words, f"^[{_LETTERS}]+$")
        odd = words.filter(pc.invert(plain)).to_pylist()
        for at in range(0, len(odd), 4000):
            part = odd[at : at + 4000]
            self.update(zip(part, self.encode(part), strict=True))
        words = words.filter(plain)
        if not len(words):
            return
        begin, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
        names, sizes = words.to_numpy(zero_copy_only=False), np.diff(begin)
        for size in np.unique(sizes).tolist():
            rows = np.nonzero(sizes == size)[0]
            if size <= Merges.MOST:
                self.update(zip(names[rows].tolist(), self.merges.encode(data[begin[rows][:, None] + np.arange(size)]), strict=True))
            else:
                for word in names[rows].tolist():
                    ids = [t.id for t in self.bpe.tokenize("".join(map(self.signs.__getitem__, word.encode())))]
                    self[word] = pack_ids(f"<{len(ids)}I", *ids)

    def found(self, words: pa.Array) -> list[bytes]:
        """The ids of each of these different words."""
        if len(self) > CACHE_WORDS:
            kept = dict(islice(self.items(), KEPT_WORDS))
            self.clear()
            self.update(kept)
        names = words.to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.get, names))
        if new := [k for k, ids in enumerate(out) if ids is None]:
            self.learn(words.take(pa.array(new)))
            for k in new:
                out[k] = self[names[k]]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        found = self.model.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        begin = np.cumsum([0, *(len(w) + 1 for w in words)])
        cut = np.searchsorted(np.array([x[0] for x in found.offsets], np.int64), begin)
        return [ids[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, ends = self.spread(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []

    def spread(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text behind the other, and where each text ends; what new words there are in these texts
        is held besides the cache.

        Latin-1 texts are lower-cased first, as the normaliser does it sign by sign and Arrow too; texts in which lower case
        stands or could make a special string stay as they are, and so do all others.
        """
        texts = pc.if_else(pc.match_substring_regex(texts, self.as_is), texts, pc.utf8_lower(texts))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.values.dictionary_encode()
        stems = words.dictionary
        plain = pc.match_substring_regex(stems, rf"^[{_LETTERS}]+[{re.escape(_MARKS)}]*$")
        stems = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(stems, _MARKS)), stems)
        marked = pc.indices_nonzero(pc.less(pc.binary_length(stems), pc.binary_length(words.dictionary)))
        marks = pc.replace_substring_regex(words.dictionary.take(marked), f"^[{_LETTERS}]+", "").dictionary_encode()
        stems = stems.dictionary_encode()
        found = self.found(stems.dictionary) + self.found(marks.dictionary) + [b""]
        mark = np.full(len(words.dictionary), len(found) - 1)
        mark[marked.to_numpy()] = len(stems.dictionary) + marks.indices.to_numpy()
        at = np.stack([stems.indices.to_numpy(), mark], 1)[words.indices.to_numpy()].ravel()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = sizes[at]
        ends = np.cumsum(each)
        places = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - each), each)
        places += np.arange(len(places))
        return np.frombuffer(b"".join(found), "<u4")[places], np.concatenate([[0], ends])[2 * lists.offsets.to_numpy()[1:].astype(np.int64)]


@cache
def word_ids(name: str) -> WordIds:
    """One for each worker process, which goes from task to task."""
    return WordIds(name)


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, limit: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words = word_ids(tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            rows = batch.slice(at, TEXTS)
            cols: list[list] = [[], [], [], [], []]
            found, ends = words.spread(pc.fill_null(rows.column(1), ""))
            begin = 0
            for i, stop in zip(rows.column(0).to_pylist(), ends.tolist(), strict=True):
                ids, begin = found[begin:stop].tobytes() + end, stop
                for k, start in enumerate(range(0, len(ids) // 4, limit)):
                    part = ids[4 * start : 4 * (start + limit)]
                    for col, x in zip(cols, (i, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of at most limit ids; null texts count as empty.

    An empty text is one piece with the end id alone. Null or repeated ids give the pieces of each row. Other columns are
    ignored; an empty table gives no rows. Only tokenizers of which WordIds knows that words are encoded one by one are taken.
    """
    if tokenizer not in BY_WORDS:
        raise ValueError(f"{tokenizer}: its ids are not known to be those of its words in turn; known: {', '.join(BY_WORDS)}")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _pieces(it, tokenizer, limit, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram of lengths: (pattern, how many bins have it), patterns long to short.

    Bins with equal contents are one entry, and a length goes to all bins of the tightest room at once.
    """
    rooms: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if not bins[room]:
            insort(rooms, room)
        bins[room].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length
                if left >= each:
                    put(limit - each * length, (length,) * each, left // each)
                if left % each:
                    put(limit - left % each * length, (length,) * (left % each), 1)
                break
            room = rooms[at]
            pattern, n = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            each = min(room // length, max(1, left // n))
            use = min(n, left // each)
            if n > use:
                put(room, pattern, n - use)
            put(room - each * length, pattern + (length,) * each, use)
            left -= use * each
    return [(p, n) for room in rooms for p, n in bins[room]]


def _choices(pattern: tuple[int, ...]) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """The different documents of a bin, and its different pairs of documents, by length."""
    times = Counter(pattern)
    one = sorted(times)
    return [(x,) for x in one], [(x, y) for i, x in enumerate(one) for y in one[i:] if x != y or times[x] > 1]


class _Receivers:
    """What each underfull bin could give back for documents that it gets: nothing, one document or two, as flat arrays."""

    def __init__(self) -> None:
        self.n = 0
        self.cols = np.zeros((4, 1024), np.int64)  # sum given back, number given back, fill of the bin, room (-1: gone)
        self.at: dict[tuple[int, ...], tuple[int, int]] = {}
        self.sets: list[tuple[tuple[int, ...], tuple[int, ...]]] = []

    def add(self, p: tuple[int, ...], limit: int) -> None:
        one, two = _choices(p)
        sets = [(), *one, *two]
        end = self.n + len(sets)
        while end > self.cols.shape[1]:
            self.cols = np.concatenate([self.cols, np.zeros_like(self.cols)], 1)
        fill = sum(p)
        self.cols[:, self.n : end] = [[sum(x) for x in sets], [len(x) for x in sets], [fill] * len(sets), [limit - fill] * len(sets)]
        self.at[p] = self.n, end
        self.sets += [(p, x) for x in sets]
        self.n = end

    def drop(self, p: tuple[int, ...]) -> None:
        start, end = self.at.pop(p)
        self.cols[3, start:end] = -(1 << 40)

    def best(self, a: tuple[int, ...], alone: bool) -> tuple | None:
        """(receiver, what a gives, what it gets back) with the largest raise of squared fill; alone: not a itself."""
        back, number, fill, room = self.cols[:, : self.n]
        if alone:
            start, end = self.at[a]
            held, room[start:end] = room[start:end].copy(), -(1 << 40)
        found, most, own = None, 0, sum(a)
        for gives, returned in zip(_choices(a), (2, 1), strict=True):  # two documents go for one at most
            if gives:
                gives = sorted(gives, key=sum)
                sums = np.array([0, *(sum(x) for x in gives)], np.int64)
                at = np.searchsorted(sums[1:], room + back, "right")  # the most that fits; 0: nothing
                net = sums[at] - back
                gain = np.where((net > 0) & (at > 0) & (number <= returned), net * (fill - own + net), 0)
                k = int(gain.argmax())
                if gain[k] > most:
                    most = int(gain[k])
                    found = self.sets[k][0], gives[at[k] - 1], self.sets[k][1]
        if alone:
            room[start:end] = held
        return found


def local_search(patterns: list[tuple[tuple[int, ...], int]], limit: int, work: int = WORK) -> list[tuple[tuple[int, ...], int]]:
    """Swap-based local search between underfull bins, until no step raises the squared fill any more.

    A step moves one or two documents from one bin to another, or exchanges one for one, one for two or two for one; what
    the receiver gains must fit its room and raise the sum of the two bins' squared fills. Bins give in order of fill, the
    emptiest first, and may receive from emptier and fuller ones; of all receivers the one with the largest raise is taken,
    and the step is done for as many bins with these contents as there are. Both bins' new contents stay in play, and
    a bin that empties is gone. work: exchanges that are looked at before the search stops wherever it is; a bin that is
    not improved stays as it is, so the bound costs sequences at most, never documents.
    """
    bins: Counter = Counter()
    for p, n in patterns:
        bins[tuple(sorted(p, reverse=True))] += n
    receivers = _Receivers()
    for p in sorted(bins):
        if sum(p) < limit:
            receivers.add(p, limit)
    least = sum(x * n for p, n in bins.items() for x in p) // -limit * -1

    def changed(p: tuple[int, ...], out: tuple[int, ...], back: tuple[int, ...]) -> tuple[int, ...]:
        left = list(p)
        for x in out:
            left.remove(x)
        return tuple(sorted([*left, *back], reverse=True))

    improved = True
    while improved and work > 0 and sum(bins.values()) > least:
        improved = False
        todo = [(sum(p), p) for p in receivers.at]
        heapq.heapify(todo)
        while todo and work > 0:
            _, a = heapq.heappop(todo)
            while bins.get(a) and work > 0:
                work -= receivers.n
                if (step := receivers.best(a, bins[a] == 1)) is None:
                    break
                b, out, back = step
                improved = True
                times = bins[a] // 2 if a == b else min(bins[a], bins[b])
                for p in (a, b):
                    bins[p] -= times
                for p in {a, b}:
                    if not bins[p]:
                        del bins[p]
                        receivers.drop(p)
                for p in (changed(a, out, back), changed(b, back, out)):
                    if p:
                        if not bins[p] and sum(p) < limit:
                            receivers.add(p, limit)
                            heapq.heappush(todo, (sum(p), p))
                        bins[p] += times
        if receivers.n > 4 * sum(e - s for s, e in receivers.at.values()):  # leave the bins that are gone behind
            live, receivers = sorted(receivers.at), _Receivers()
            for p in live:
                receivers.add(p, limit)
    return sorted(((p, n) for p, n in bins.items() if n), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first bin, ranks a bin, offset of the first): runs of ranks of a length."""
    used: Counter = Counter()
    out, bin_ = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            out.append((length, used[length], used[length] + n * each - 1, bin_, each, offset))
            used[length] += n * each
            offset += length * each
        bin_ += n
    return out


def _place(batches: Iterator[pa.RecordBatch], runs) -> Iterator[pa.RecordBatch]:
    keys, plan = runs.value
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
        _, first, _, bin_, each, offset = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1].T if len(rank) else np.zeros((6, 0), np.int64)
        at = rank - first
        yield batch.drop_columns(["_rank"]).append_column("sequence_id", pa.array(bin_ + at // each)).append_column("offset", pa.array(offset + length * (at % each)))


def pack(parts: DataFrame, limit: int = LIMIT, work: int = WORK) -> DataFrame:
    """parts with sequence_id and offset; lengths from 1 to limit, sequences of at most limit, gapless from 0.

    parts must be stable when read again (a written table). Ties of length are ranked by doc_id, piece and start.
    Repeated rows are packed each for itself. An empty table gives no rows.
    """
    spark = parts.sparkSession
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    plan = slots(local_search(best_fit(histogram, limit), limit, work)) if histogram else []
    most = max(LEAST_ROWS, min(WINDOW_ROWS, sum(histogram.values()) // 1000))
    common_lengths = [x for k, n in sorted(histogram.items()) if n > most for x in (F.lit(k), F.lit(-(-n // most)))]  # at most `limit` of them
    salts = F.coalesce(F.try_element_at(F.create_map(*common_lengths), F.col("length").cast("int")), F.lit(1)) if common_lengths else F.lit(1)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    key = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = salted.withColumn("_rank", F.row_number().over(key) - 1).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    runs = np.array(sorted(plan), np.int64).reshape(-1, 6)
    runs = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs))
    fields = ranked.select(*parts.columns, "_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    return ranked.select(*parts.columns, "_rank").mapInArrow(lambda it: _place(it, runs), fields.drop("_rank").schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, work: int = WORK) -> DataFrame:
    """Pieces of all docs with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows, nulls and empty tables as in pieces() and pack(). work bounds the local search on the driver.
    """
    ready(docs.sparkSession)
    return pack(written(pieces(docs, tokenizer, limit), "pieces"), limit, work)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
