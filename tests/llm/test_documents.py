"""Operators over documents against brute force and on odd inputs."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter

from factloom.llm import common, decontaminate, jaccard_join, language_id, license_scan, packing, pii, quality, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def prose(rng, n, vocabulary=WORDS):
    return " ".join(rng.choices(vocabulary, k=n))


# ---------------------------------------------------------------- packing


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_packing(rows, texts, limit):
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for i, text in texts:
        ids = ids_of(text)
        for k, s in enumerate(range(0, len(ids), limit)):
            part = ids[s : s + limit]
            want[i, k].append((s, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    return len(by)


def test_packing_of_odd_documents(docs, odd):
    rows = packing.pack_documents(docs(odd), limit=256).collect()
    check_packing(rows, odd, 256)


def test_packing_is_near_the_bound(docs):
    rng = random.Random(1)
    texts = [(i, prose(rng, rng.randint(1, 60))) for i in range(300)]  # no document fills half a sequence
    rows = packing.pack_documents(docs(texts), limit=128).collect()
    assert check_packing(rows, texts, 128) <= -(-sum(r.length for r in rows) // 128) + 1


def test_packing_of_an_empty_table(docs):
    assert packing.pack_documents(docs([])).count() == 0


def test_local_search_empties_bins():
    plan = [((6, 1), 1), ((5, 2), 1), ((3,), 1)]  # 17 in bins of 10: two are enough
    better = packing.local_search(plan, 10)
    assert sum(n for _, n in better) == 2
    assert sorted(x for p, n in better for x in p * n) == [1, 2, 3, 5, 6]


def bins_needed(lengths, limit):
    """The least number of bins, by trying all placements of the longest piece left."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[k]:
                left = list(rooms)
                left.remove(r)
                place(k + 1, [*left, r - lengths[k]])
        place(k + 1, [*rooms, limit - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_local_search_against_the_optimum():
    rng = random.Random(3)
    before = after = least = 0
    for _ in range(60):
        lengths = [rng.randint(14, 48) for _ in range(11)]
        plan = packing.best_fit({x: lengths.count(x) for x in set(lengths)}, 100)
        found = packing.local_search(plan, 100)
        assert sorted(x for p, n in found for x in p * n) == sorted(lengths) and all(sum(p) <= 100 for p, _ in found)
        counts = [sum(n for _, n in x) for x in (plan, found)]
        assert bins_needed(lengths, 100) <= counts[1] <= counts[0]
        before, after, least = before + counts[0], after + counts[1], least + bins_needed(lengths, 100)
    assert after - least <= (before - least) / 2  # at least half of what best fit is above the optimum


@pytest.mark.parametrize(("low", "high", "share"), [(300, 1400, 0.99), (600, 1100, 0.97), (1100, 1900, 0.975)])
def test_local_search_saves_bins(low, high, share):
    rng = random.Random(5)
    lengths = [rng.randint(low, high) for _ in range(3000)]
    plan = packing.best_fit({x: lengths.count(x) for x in set(lengths)}, 4096)
    found = packing.local_search(plan, 4096)
    assert sum(n for _, n in found) <= share * sum(n for _, n in plan)


def test_a_bound_on_the_search_costs_no_piece():
    rng = random.Random(6)
    lengths = [rng.randint(1100, 1900) for _ in range(500)]
    plan = packing.best_fit({x: lengths.count(x) for x in set(lengths)}, 4096)
    found = packing.local_search(plan, 4096, work=1)
    assert sorted(x for p, n in found for x in p * n) == sorted(lengths)


def test_packing_takes_no_other_tokenizer(docs):
    with pytest.raises(ValueError, match="piece_bpe_32k"):
        packing.pieces(docs([(1, "a")]), tokenizer="piece_bpe_32k.model")


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_keeps_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 100, 5000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.local_search(packing.best_fit(histogram, 100), 100)
    back = defaultdict(int)
    for p, n in plan:
        assert sum(p) <= 100
        for x in p:
            back[x] += n
    assert back == histogram
    ranks = defaultdict(list)
    for length, first, last, *_ in packing.slots(plan):
        ranks[length] += range(first, last + 1)
    assert all(sorted(v) == list(range(histogram[k])) for k, v in ranks.items())


def test_word_cache_gives_the_tokenizers_ids():
    words = packing.WordIds("word_bpe_49k.json")
    rng = random.Random(0)
    texts = ["".join(rng.choices([*"abcXYZé'ñ .,!\t́ßΣİ１½09\x1c<|>\n中", "<|endoftext|>", "'s", "'LL"], k=rng.randint(0, 30))) for _ in range(3000)]
    for text, got in zip(texts, words.ids(texts), strict=True):
        assert got + b"\x01\0\0\0" == ids_of(text).tobytes(), text


def test_plain_words_are_encoded_together():
    """New words of letters cost no call of the library each, whatever their case and the marks behind them."""
    words = packing.WordIds("word_bpe_49k.json")
    library, words.bpe = words.model, None
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("etaoinshrdluzqÉéßñ", k=rng.randint(1, 16))).capitalize() + rng.choice(["", "", ".", "),"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.ids(texts) == want


def test_a_full_word_cache_keeps_its_first_words(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    monkeypatch.setattr(packing, "KEPT_WORDS", 100)
    words = packing.WordIds("word_bpe_49k.json")
    texts = [f"the of {' '.join(chr(97 + k % 26) * (k // 26 + 1) for k in range(n, n + 40))}." for n in range(0, 1000, 40)]
    for text in ["the of", *texts]:
        assert words.ids([text])[0] == np.array(words.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(words) <= 300 + 43 and {"the", "of"} <= set(words)


# ---------------------------------------------------------------- shared tables


def test_shared_tables_have_no_checksum_files(docs):
    """Hadoop's local file system starts further children for these, each counting as a second executor."""
    rows = [(k, f"text {k}") for k in range(20)]
    found = common.written(docs(rows).repartition(5), "plain")
    assert sorted(map(tuple, found.select("doc_id", "text").collect())) == rows
    folder = Path(re.sub("^file:/+", "/", found.inputFiles()[0])).parent
    assert list(folder.glob("part-*.parquet")) and not list(folder.glob(".*.crc"))


def test_narrow_tables_come_from_workers_and_only_from_tasks_that_ended(docs, tmp_path, monkeypatch):
    rows = [(k, f"text {k}" if k % 3 else None) for k in range(40)]
    odd = docs(rows).repartition(5).selectExpr("doc_id", "text", "cast(doc_id as int) as i", "doc_id > 3 as big", "encode(text, 'UTF-8') as bytes", "array(doc_id) as a")
    want = sorted(map(tuple, odd.collect()), key=str)
    monkeypatch.setattr(common, "HELD_ROWS", 3)
    found = common.narrow(odd, "odd")
    folder = Path(re.sub("^file:/+", "/", found.inputFiles()[0])).parent
    assert all(re.fullmatch(r"part-\w+\.parquet", f.name) for f in folder.iterdir())
    next(folder.iterdir()).with_name("_left").write_bytes(next(folder.iterdir()).read_bytes())  # of a task that was repeated
    assert sorted(map(tuple, found.collect()), key=str) == want and found.dtypes == odd.dtypes
    assert common.narrow(odd.where("doc_id < 0"), "none").collect() == []
    monkeypatch.setattr(common, "_mounted", lambda spark: None)
    assert sorted(map(tuple, common.narrow(odd, "odd").collect()), key=str) == want


def test_narrow_tables_leave_no_shuffle_files(spark, docs):
    """Else the disk holds all shuffles of an operator until the driver collects its garbage."""
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    source = docs([(k, "text") for k in range(40)])
    before = set(re.findall(r"(\d+) ->", known.keys().mkString("", " -> ", " ->")))
    assert common.narrow(source.repartition(3, "doc_id").groupBy("doc_id").count(), "counts").count() == 40
    last = time.time() + 10
    while (left := set(re.findall(r"(\d+) ->", known.keys().mkString("", " -> ", " ->"))) - before) - {max(left, key=int, default=None)} and time.time() < last:
        time.sleep(0.1)
    assert len(left) <= 1  # of the count above
    assert spark.conf.get(common._CLEANUP) == "false"


# ---------------------------------------------------------------- token counts


def test_token_counts_and_cache(docs, odd, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in odd), key=str)
    for _ in range(2):  # the second time all come from the cache
        got = token_counts.count_tokens(docs(odd), "piece_bpe_32k.model", str(tmp_path / "cache")).collect()
        assert sorted(map(tuple, got), key=str) == want
    cache = docs([]).sparkSession.read.schema(token_counts.CACHE).parquet(str(tmp_path / "cache"))
    assert cache.count() == cache.select("digest").distinct().count() == len({t or "" for _, t in odd})
    more = [*odd, (77, "not seen before")]
    got = token_counts.count_tokens(docs(more), "piece_bpe_32k.model", str(tmp_path / "cache")).collect()
    assert len(got) == len(more) and {r.n_tokens for r in got if r.doc_id == 77} == {len(model.encode("not seen before"))}
    assert token_counts.count_tokens(docs([]), "piece_bpe_32k.model", str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- Jaccard join


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = {i: sets_of(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_join_against_all_pairs(docs, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)  # so that members of large groups meet in blocks
    rng = random.Random(seed)
    many = [f"w{k}" for k in range(400)]
    line = prose(rng, 30, many)
    texts = []
    for base in (prose(rng, n, many) for n in (3, 7, 12, 30, 60, 200)):
        words = base.split()
        for _ in range(14):  # near copies, some around the threshold, many of them in one group
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(many)
            texts.append(" ".join(w))
    texts += [line + " " + prose(rng, rng.randint(1, 40), many) for _ in range(25)]
    texts += [prose(rng, 50, many) for _ in range(20)] + ["", " ", "ONE two", "one TWO", "one\ttwo\x0b"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_documents(docs(rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize(("part", "batch"), [(7, 1), (29, 5), (19, 100), (1000, 13)])
def test_groups_of_more_rows_than_are_held_lose_no_member(monkeypatch, part, batch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "PART", part)
    rng = random.Random(part)
    groups = {t: rng.sample(range(1000), n) for t, n in enumerate([1, 2, 4, 5, 33, 61, 3, 20, 29, 28, 2, 1, 7, 8])}
    rows = sorted((t, 100, d) for t, ids in groups.items() for d in ids)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + batch]]), pa.array([r[2] for r in rows[k : k + batch]]), pa.array([r[1] for r in rows[k : k + batch]], pa.int32())], names=["token", "doc_id", "n"]) for k in range(0, len(rows), batch)]
    members, pairs = defaultdict(list), set()
    for b in jaccard_join._pairs(iter(batches)):
        for r in b.to_pylist():
            if r["token"] is None:
                pairs.add((r["a"], r["b"]))
            else:
                members[r["token"]].append(r["a"])
    for t, ids in groups.items():
        if t in members:  # a large group: all are members, and all meet the same pivot
            assert sorted(members[t]) == sorted(ids)
            assert any(all(x == y or (min(x, y), max(x, y)) in pairs for y in ids) for x in ids)
        else:
            assert len(ids) <= jaccard_join.SMALL_GROUP
            assert all((min(x, y), max(x, y)) in pairs for x in ids for y in ids if x != y)


def test_words_longer_than_the_span_and_across_it(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abC", k=rng.choice([1, 5, 40, 90]))) for _ in range(rng.randrange(30))) for _ in range(40)]
    monkeypatch.setattr(jaccard_join, "SPAN", 64)
    jaccard_join._powers.cache_clear()
    try:
        got = [set(x.tolist()) for x in jaccard_join.shingle_sets([t.encode() for t in texts])]
    finally:
        jaccard_join._powers.cache_clear()
    want = [sets_of(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    assert all(len(a & b) == len(x & y) for a, x in zip(got, want, strict=True) for b, y in zip(got, want, strict=True))


def test_jaccard_join_writes_no_tables_through_hadoop(docs, monkeypatch):
    """Hadoop's local file system starts a child for each file and folder, which counts as a second executor (3000 MB held twice)."""

    def refused(*_, **__):
        raise AssertionError("a table written by Spark's writer")

    monkeypatch.setattr(DataFrameWriter, "parquet", refused)
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 2)  # so that all tables are made
    rng = random.Random(8)
    copy, line = prose(rng, 40), prose(rng, 6)
    rows = [(k, copy + f" w{k}" * (k % 3 == 0)) for k in range(12)] + [(k, f"{line} {prose(rng, 5)}") for k in range(20, 30)]
    got = {r.doc_id: r.component_id for r in jaccard_join.join_documents(docs(rows)).collect()}
    sets = {k: set(jaccard_join.shingle_sets([t.encode()])[0].tolist()) for k, t in rows}
    want = {k: k for k in sets}
    for _ in sets:
        want |= {a: min(want[b] for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])) for a in sets}
    assert got == want and {got[k] for k in range(12)} == {0}


def test_jaccard_join_of_odd_documents(docs, odd):
    got = jaccard_join.join_documents(docs(odd)).collect()
    assert len(got) == len(odd)
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None)
    assert jaccard_join.join_documents(docs([])).count() == 0


# ---------------------------------------------------------------- decontamination


def test_decontamination_finds_planted_passages(spark, docs, odd):
    rng = random.Random(3)
    many = [f"w{k}x" for k in range(3000)]
    items = [(k, prose(rng, rng.randint(15, 50), many)) for k in range(20)]
    bench = spark.createDataFrame([*items, (None, "null id " * 9), (90, None), (91, ""), (92, "tiny item")], "item_id long, text string")
    rows, want = list(odd), set()
    for k, text in items:
        rows.append((100 + k, f"{prose(rng, 40, many)} {text.upper()}, {prose(rng, 40, many)}"))
        want.add((100 + k, k))
        words = text.split()
        words[0] = "changed"
        rows.append((200 + k, " ".join(words)))
        want.add((200 + k, k))
        rows.append((300 + k, f"{' '.join(words[: len(words) // 2])} {prose(rng, 40, many)}"))
    rows.append((400, "a tiny item"))
    want.add((400, 92))
    got = decontaminate.matches(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.similarity == 1.0 and r.start == 40 and r.hamming == 0 for r in got if 100 <= r.doc_id < 200)
    assert decontaminate.matches(docs([]), bench).count() == 0
    assert decontaminate.matches(docs(rows), bench.limit(0)).count() == 0


def test_decontamination_of_quotations_that_are_cut(spark, docs):
    rng = random.Random(8)
    many = [f"w{k}x" for k in range(400)]
    items = [(k, prose(rng, rng.randint(15, 60), many).lower().split()) for k in range(40)]

    def shingles(w):
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    def similarity(a, b):
        weight = lambda x: sum(map(len, x))
        return weight(shingles(a) & shingles(b)) / weight(shingles(a) | shingles(b))

    rows, want = [], set()
    for k, words in items:
        for r in range(30):
            foreign, m, best = rng.choices(many, k=len(words)), len(words), words
            for n in range(m - 1, 0, -1):
                cut = words[:n] + foreign[n:] if r % 2 else foreign[: m - n] + words[m - n :]
                if similarity(words, cut) < 0.75:
                    break
                best = cut
            rows.append((1000 * k + r, " ".join(best)))
            want.add((1000 * k + r, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(rows), bench).collect()}
    assert want <= got


def test_short_items_are_found_where_their_words_stand(spark, docs):
    bench = spark.createDataFrame([(92, "tiny item"), (93, "one"), (94, "now four words here")], "item_id long, text string")
    rows = [(1, "Tiny, item!"), (2, "tiny items"), (3, "this is a tiny item in a longer text"), (4, "tiny"), (5, "One."), (6, "and now four words here, and a tiny item")]
    assert {(r.doc_id, r.item_id, r.start, r.n_words, r.similarity) for r in decontaminate.matches(docs(rows), bench).collect()} == {(1, 92, 0, 2, 1.0), (3, 92, 3, 2, 1.0), (5, 93, 0, 1, 1.0), (6, 94, 1, 4, 1.0), (6, 92, 7, 2, 1.0)}


def brute_windows(rows, items):
    """(doc, item): (similarity, -start, -size, hamming) of the best window within the radius; and how many similar ones lie beyond it."""
    import xxhash

    def simhash(w):
        bits = np.array([[xxhash.xxh64_intdigest(x.encode(), seed=42) >> b & 1 for b in range(64)] for x in w])
        return sum(1 << b for b in range(64) if 2 * bits[:, b].sum() > len(w))

    def shingles(w):
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}

    weight = lambda x: sum(map(len, x))
    best, beyond = {}, 0
    for i, text in rows:
        w = text.lower().split()
        for k, item in items:
            t = item.lower().split()
            for s in range(1 - len(t), len(w)):
                win = w[max(s, 0) : s + len(t)]
                both = weight(shingles(win) & shingles(t))
                sim = both / (weight(shingles(win)) + weight(shingles(t)) - both)
                if sim >= 0.75:
                    far = (simhash(win) ^ simhash(t)).bit_count()
                    beyond += far > decontaminate.RADIUS
                    if far <= decontaminate.RADIUS:
                        best[i, k] = max(best.get((i, k), ()), (sim, -max(s, 0), -len(win), far))
    return best, beyond


def test_decontamination_against_all_windows(spark, docs):
    rng = random.Random(12)
    many = [f"w{k}x" for k in range(300)]
    items = [(k, prose(rng, rng.randint(12, 45), many)) for k in range(30)]
    items += [(30, " ".join(["so"] * 9 + ["it"] * 4)), (31, "a b c d e f a b c d e f a b c"), (32, items[0][1]), (33, items[1][1] + " tail")]
    rows = []
    for i in range(400):  # an item with one to three words changed, put in or left out, at the ends or inside foreign words
        w = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choices(many, k=rng.randrange(2))
        cut = rng.randrange(0, 3)
        w = w[cut:] if rng.random() < 0.3 else w
        rows.append((i, " ".join(rng.choices(many, k=rng.choice([0, 0, 3, 30])) + w + rng.choices(many, k=rng.choice([0, 0, 3, 30])))))
    want, beyond = brute_windows(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start, -r.n_words, r.hamming) for r in decontaminate.matches(docs(rows), bench).collect()}
    assert got.keys() == want.keys() and len(want) > 200
    assert all(np.isclose(got[k][0], want[k][0]) and got[k][1:] == want[k][1:] for k in want)
    assert beyond == 0  # no similar window lies beyond the radius here


def test_decontamination_of_repeated_ids_and_clashing_columns(spark, docs):
    bench = spark.createDataFrame([(1, "p q r s t u v w", 3, "x"), (1, "k l m n o p", 3, "x"), (2, "p q r s t u v w", 3, "x")], "item_id long, text string, doc_id long, m string")
    rows = [(5, "a p q r s t u v w"), (5, "k l m n o p"), (5, "k l m n o p"), (6, None)]
    got = sorted((r.doc_id, r.item_id, r.start) for r in decontaminate.matches(docs(rows), bench).collect())
    assert got == [(5, 1, 0), (5, 2, 1)]


def test_decontamination_runs_no_python(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = decontaminate.matches(docs([(1, "a")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- personal data


#: The contract's patterns, as they are stated.
STATED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_stated_patterns():
    rng = random.Random(15)
    for _ in range(6000):
        text = "".join(rng.choices(["a", "b.c", "@", "@", ".", "-", "+", "1", "255", "256", "0", "4111", "1111", " ", "(", ")", "%", "\n", "é", "10.0.0.1", "x@y.z", "+4712345678"], k=rng.randrange(14)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_long_runs_take_time_in_proportion():
    import time

    began = time.time()
    for run in ("a" * 1_000_000 + " x@y.zz", "9" * 1_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "a@" * 300_000, "a.b-" * 300_000 + "@c.de 1", "1 " * 400_000, "x1" * 500_000):
        pii.base_spans(run)
        pii.tokens(run)
    assert time.time() - began < 20
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)]


def test_personal_data_keeps_all_base_spans(docs, odd):
    rng = random.Random(5)
    bits = ["a.b@c.example.com", "10.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (386) 555-3733", "+47 12", "word", "é", "12", "\n", "x@y", "+1 (826) 555-4081 190.137.223.20"]
    texts = [(100 + k, " ".join(rng.choices(bits, k=rng.randint(0, 12)))) for k in range(200)]
    rows = [*odd, *texts]
    got = pii.detect(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != 6:
            text = dict(rows)[r.doc_id] or ""
            base = brute_spans(text)
            assert r.base_sha256 == hashlib.sha256(pii.said(base).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, x, _ in base) for k in range(4))
            assert set(pii.said(base).split(",")) - {""} <= set(r.spans.split(","))
    assert pii.detect(docs([])).count() == 0


def test_long_runs_without_white_space_are_split():
    run = "{" + ",".join(f'"k{k}":"user{k}@mail.example.com","n":{k}' for k in range(40)) + "}"
    assert len(run) > 400 and " " not in run
    for text in (run, f"call 12 {run} 34 now", "9" * 500):
        toks = pii.tokens(text)
        assert toks and all(text[t.start : t.end] == t.text for t in toks)
        assert [t.text for t in toks if "@" in t.text] == ([f"user{k}@mail.example.com" for k in range(40)] if "@" in text else [])
    assert [(t.start, t.end, t.candidate, t.joined) for t in pii.tokens("9" * 500)] == [(0, 500, True, False)]


def test_a_chain_holds_the_sentence_around_its_candidates():
    far = " ".join(f"w{chr(97 + k)}" for k in range(20))
    toks = pii.tokens(f"Not here. {far} call +1 (386) 555-3733 today. Nor this.\nNor this line")
    assert [t.text for t in toks] == [*far.split()[-11:], "call", "+1", "386", "555-3733", "today"]
    assert [t.joined for t in toks] == [False] + [True] * (len(toks) - 1)
    assert [t.text for t in toks if t.candidate] == ["+1", "386", "555-3733"]


def test_similar_tokens_are_linked():
    toks = pii.tokens("Call +1 (386) 555-3733 now. Mail A@b.co.\nOr 386 555-3733, or a@B.co, or 5553733 or 1 555-3733")
    at = {k: t.text for k, t in enumerate(toks)}
    assert {(at[i], at[j], kind) for i, j, kind in pii._links(toks)} >= {("555-3733", "555-3733", 0), ("A@b.co", "a@B.co", 0), ("386", "386", 0), ("555-3733", "5553733", 1)}


def linked(toks_per_doc, edges):
    """A graph of single tokens with the given chain (joined) and skip edges."""
    return pii.Graph([[pii.Token(0, 0, "", True, j) for j in doc] for doc in toks_per_doc], edges)


def test_skip_edges_make_repeats_agree():
    scores = np.array([[0.0, 3.0], [0.0, -0.5], [0.5, 0.0]])  # the second token repeats the first
    free = [[False] * 3]
    alone, _ = pii.beliefs(scores, linked(free, [[]]), np.zeros((2, 2)), np.array([1.5]))
    both, agree = pii.beliefs(scores, linked(free, [[(0, 1, 0)]]), np.zeros((2, 2)), np.array([1.5]))
    assert alone[1].argmax() == 0 and both[1].argmax() == 1 and agree[0] > 0.5
    assert np.allclose(alone[2], both[2])


def test_beliefs_are_exact_without_cycles():
    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    b, agree = pii.beliefs(scores, linked([[False, True, False]], [[(1, 2, 1)]]), trans, np.array([9.0, 1.5]), rounds=200)
    joint = np.exp(scores[0][:, None, None] + scores[1][None, :, None] + scores[2][None, None] + trans[:, :, None] + (1.5 * np.eye(2))[None])
    joint /= joint.sum()
    assert np.allclose(b, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-5)
    assert np.isclose(agree[0], np.trace(joint.sum(0)), atol=1e-5)


def test_the_field_adds_repeats_that_the_patterns_miss():
    """Numbers that stand in full once and again without the sign that the base pattern needs; other numbers stay out."""
    rng = random.Random(21)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    words = lambda n: prose(rng, n)

    def text(repeat):
        n = number()
        again = f"{words(4)} {n} {words(3)}." if repeat else f"{words(4)} {rng.randint(100, 999)} {words(3)}."
        return f"{words(5)} +1 {n} {words(4)}.\n{words(6)} {rng.randint(1, 99)} {words(2)}.\n{again}", n if repeat else None

    field = pii.train([text(k % 2)[0] for k in range(300)])
    assert (field.skip > 0).all()
    hit = wrong = total = 0
    for _ in range(100):
        t, n = text(True)
        [(base, every)] = pii.find([t], field)
        place = t.index("+1") + 2 + t[t.index("+1") + 2 :].index(n) + len(n)
        at = t.index(n, place)
        added = [x for x in every if x not in base]
        total += 1
        hit += any(k == 3 and s < at + len(n) and at < e for s, k, e in added)
        wrong += sum(not (s < at + len(n) and at < e) for s, k, e in added)
    assert hit >= 0.9 * total and wrong <= 0.05 * total


def test_mask():
    text = "mail a@b.co or 10.0.0.1."
    assert pii.mask(text, pii.base_spans(text)) == "mail [EMAIL] or [IP]."


# ---------------------------------------------------------------- learned models


def test_quality_learns_bad_lines(spark, docs, odd):
    rng = random.Random(7)
    rows = [(1000 + k, "\n".join(prose(rng, 12).capitalize() + "." if k % 3 else prose(rng, 12).upper() + "!!" for _ in range(5))) for k in range(300)]
    labels = spark.createDataFrame([(i, int((i - 1000) % 3 > 0), 0) for i, _ in rows] + [(None, 1, 0), (1000, None, 0)], "doc_id long, quality int, toxic int")
    table = docs([*rows, *odd])
    model = quality.model_for(table, labels)
    got = quality.score(table, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert held and all((r.score >= quality.THRESHOLD) == ((r.doc_id - 1000) % 3 > 0) for r in held)
    assert {r.held_out for r in got if r.doc_id is not None} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r.score >= quality.THRESHOLD for r in got)
    assert quality.score(docs([]), model).count() == 0


def test_language_of_words_and_documents(docs, odd):
    rng = random.Random(9)
    vocabulary = {"en": ["the", "that", "with", "having", "which"], "de": ["und", "der", "nicht", "schön", "werden"], "fr": ["que", "les", "être", "dans", "vous"]}
    rows = [(1000 + k, prose(rng, 30, vocabulary[lang]), lang) for k in range(240) for lang in [sorted(vocabulary)[k % 3]]]
    mixed = [(5000, prose(rng, 40, vocabulary["de"]) + " " + prose(rng, 10, vocabulary["fr"]), None)]
    got = language_id.identify(docs([*rows, *mixed, *((i, t, None) for i, t in odd)])).collect()
    assert len(got) == len(rows) + 1 + len(odd)
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want)
    assert {r.lang_pred for r in got if r.doc_id == 5000} == {"de"}
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(docs([])).count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    from factloom.llm import crf

    rng = np.random.default_rng(0)
    for block in (2, 3, 32):
        crf.BLOCK, before = block, crf.BLOCK
        lengths = np.array([0, 1, 5, 7, 2, 0, 4])
        scores, trans = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
        post, logz, pair = crf.posteriors(scores, lengths, trans, pairwise=True)
        crf.BLOCK = before
        at, pairs = 0, np.zeros((3, 3))
        for q, n in enumerate(lengths):
            total, single, double = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
            for y in itertools.product(range(3), repeat=int(n)):
                w = np.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
                total += w
                for i in range(n):
                    single[i, y[i]] += w
                for i in range(n - 1):
                    double[y[i], y[i + 1]] += w
            assert np.isclose(logz[q], np.log(total)) and np.allclose(post[at : at + n], single / total)
            pairs += double / total
            at += n
        assert np.allclose(pair, pairs)


# ---------------------------------------------------------------- license scan


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(k, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(docs, odd):
    rng = random.Random(11)
    lines = ["Licensed under CC BY-NC 4.0.", "All rights reserved", "ALL, RIGHTS\nRESERVED", "GNU General Public License", "Released under the MIT License.", "cc", "by", "General-Public LICENSE cc-by", "é", "rights all reserved", "KK"]
    rows = [*odd, *((100 + k, (prose(rng, rng.randint(0, 90)) + " ").join(rng.choices(lines, k=rng.randint(1, 5)))) for k in range(150))]
    got = license_scan.scan(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id]), texts[r.doc_id]
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate(LOWER))
            blocks = [set(words[k : k + license_scan.BLOCK]) for k in range(0, max(1, len(words) - license_scan.STEP), license_scan.STEP)]
            want = {label for label, t in license_scan.TEMPLATES.items() for b in blocks if len(b & set(t.split())) >= license_scan.CONTAINMENT * len(set(t.split()))}
            assert set(r.labels.split(",")) - {""} == want | (set(r.base_labels.split(",")) - {""})
    assert license_scan.scan(docs([])).count() == 0


def test_license_scan_with_whole_texts_as_templates(docs):
    rng = random.Random(17)
    many = [f"v{k}" for k in range(900)]
    templates = {"long": " ".join(rng.sample(many, 150)), "short": "this is a short notice"}
    body = templates["long"].split()
    rows = [(1, prose(rng, 500) + " " + " ".join(body) + " " + prose(rng, 77)), (2, prose(rng, 33) + " " + " ".join(body[:-10])), (3, " ".join(body[:120])), (4, "x This is a SHORT notice"), (5, "")]
    assert {r.doc_id: r.labels for r in license_scan.scan(docs(rows), templates=templates).collect()} == {1: "long", 2: "long", 3: "", 4: "short", 5: ""}


def test_license_scan_runs_no_python(docs):
    plan = license_scan.scan(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
