"""Embeddings, pages, components and the pipeline."""

import random

import numpy as np
import pytest

from factloom.llm import common, embedding_dedup, html_text


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + k, 501 + k) for k in range(20)] + [(700, k) for k in range(701, 760)] + [(5, 5), (5, 5), (None, 3)]
    root = {}
    for a, b in edges:
        if a is not None:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    common.ready(spark)
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == root
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "LOCAL_EDGES", 40)  # so that no task has all edges
    monkeypatch.setattr(common, "HOT_ROWS", 10)  # so that hubs are dealt out
    test_components(spark)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = [(k % 3 if k % 2 else 0, k) for k in range(200)] + [(None, 1), (9, 2)]
    right = [(0, "a"), (1, "b"), (9, "c"), (7, "d")]
    a, b = spark.createDataFrame(left, "k long, v long"), spark.createDataFrame(right, "k long, w string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.hot_join(a, b, "k", "v", len(left), how).select("k", "v", "w").collect()), key=str)
        assert got == sorted(map(tuple, a.join(b, "k", how).select("k", "v", "w").collect()), key=str)


def test_samples_are_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from factloom.llm import training

    rows = spark.createDataFrame([(k, "often" if k % 50 else "rare") for k in range(3000)], "doc_id long, label string")
    got = {(r["label"], r["doc_id"]) for r in training.smallest(rows, "label", 100)}
    by = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))).collect()
    assert got == {(g, r.doc_id) for g in ("often", "rare") for r in sorted((r for r in by if r.label == g), key=lambda r: (r.h, r.doc_id))[:100]}
    texts = training.texts_of(spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c" * 99), (4, "d")], "doc_id long, text string"), [1, 2, 3], chars=9)
    assert texts == [(1, "a"), (3, "c" * 9)]


def test_bitmap_never_loses_an_id(spark):
    from pyspark.sql import functions as F

    ids = spark.range(0, 30000, 7)
    bits = common.bitmap(ids, "id")
    p = np.array([r.p for r in spark.range(30000).select(common.bit_of(F.col("id"), bits).alias("p")).collect()])
    hit = common.has_bit(bits, p)
    assert hit[::7].all() and hit.mean() < 0.2


def brute_links(rows):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    ids = sorted(unit)
    links = {i: {j for j in ids if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.9} for i in ids}
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    return {i: (len(links[i]), root[i]) for i in ids}


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # so that groups are cut into blocks
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 24))
    rows = [(k, (centres[k % 6] + 0.05 * rng.normal(size=24)).tolist()) for k in range(150)] + [(200 + k, rng.normal(size=24).tolist()) for k in range(60)] + [(300, centres[0].tolist()), (301, centres[0].tolist()), (302, [1.0, 2.0]), (303, [2.0, 4.0])]
    odd = [(400, None), (401, []), (402, [0.0] * 24), (403, [float("nan")] * 24), (404, [None] * 24), (405, [float("inf")] + [1.0] * 23)]
    table = spark.createDataFrame([(i, v, 0, "x", 9) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, bucket string, n long")
    got = {r.vec_id: r for r in embedding_dedup.dedup(table).collect()}
    want = brute_links([(i, np.array(v, np.float32)) for i, v in rows])
    assert len(got) == len(rows) + len(odd)
    assert sum(got[i].n_links for i in want) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert {i: got[i].component_id for i in want} == {i: r for i, (_, r) in want.items()}
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert embedding_dedup.dedup(table.limit(0)).count() == 0


def test_equal_vectors_and_repeated_ids_are_one_class(spark):
    e = np.eye(4)
    rows = [(k, e[0].tolist()) for k in range(40)] + [(5, e[0].tolist()), (50, (2 * e[0]).tolist()), (51, (e[0] + 0.1 * e[1]).tolist()), (52, e[2].tolist()), (53, [-0.0, 0.0, 1.0, 0.0]), (None, e[0].tolist()), (60, None), (60, None)]
    got = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert all(by[k] == (41, 0, k == 0) for k in [*range(40), 50, 51]) and by[52] == (1, 52, True) and by[53] == (1, 52, False)
    assert by[None] == (0, None, False) and by[60] == (0, 60, True)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = rng.normal(size=x.shape)
    o -= (o * x).sum(1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    a, b = embedding_dedup.codes(x), embedding_dedup.codes(0.9 * x + np.sqrt(1 - 0.81) * o)
    met = np.zeros(len(x), bool)
    for t in range(a.shape[1]):
        for p in range(a.shape[2]):
            met |= (a[:, t, p] == b[:, t, 0]) | (a[:, t, 0] == b[:, t, p])
    assert met.mean() >= 0.9


def test_hadamard():
    h = embedding_dedup.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


PAGE = '<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu %s</a></ul></nav><div class="ad">Buy <div>now</div> this</div><article><h1>Head &amp; line</h1><p><b>One\n two<br>three<p>Four&nbsp;five</p><div class="comments"><p>nice</p></div></article><footer>&copy; x</footer></body></html>'


def test_main_text_of_marked_pages(spark):
    rows = [(1, "https://h.example/a/1", PAGE % "x"), (2, "https://h.example/a/2", PAGE % "y"), (3, None, None), (4, "http://[bad", ""), (None, "https://h.example/a/3", "<p>x"), (6, "https://h.example/z", (PAGE % "z")[:-200]), (1, "https://h.example/a/1", PAGE % "x")]
    table = spark.createDataFrame([(*r, 5, ["q"]) for r in rows], "page_id long, url string, html string, key long, lines array<string>")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(table).collect()]
    text = "Head & line\nOne two three\nFour five"
    assert len(got) == len(rows) and got.count((1, text, len(text))) == 2 and (2, text, len(text)) in got and (3, "", 0) in got and (4, "", 0) in got and (None, "x", 1) in got
    assert html_text.extract(table.limit(0)).count() == 0


def test_shared_lines_of_a_host_go(spark):
    page = lambda k: f"<div>Welcome to us</div><p>Story {k} begins</p><p>and ends {k}</p><div>Imprint and terms</div>"
    rows = [(k, f"https://h.example/news/{k}", page(k)) for k in range(12)] + [(99, "https://other.example/", page(99))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story {k} begins\nand ends {k}" for k in range(12))
    assert got[99].startswith("Welcome to us")  # alone on its host


def test_unmarked_lines_beside_a_main_region(spark):
    page = lambda k: f"<div>We use biscuits</div><article><h2>Teaser {k}</h2></article><div>Body {k} begins</div><div>and goes on {k}</div><div>Imprint and terms</div>"
    rows = [(k, f"https://h.example/news/{k}", page(k)) for k in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Teaser {k}\nBody {k} begins\nand goes on {k}" for k in range(6)}


def test_long_menus_and_notices_beside_copies_go(spark):
    menu = "".join(f"<div>Menu {k}</div>" for k in range(10))
    rows = [(k, f"https://h.example/{k:02}", f"{menu}<p>Own {k}</p><p>End {k}</p>") for k in range(4)]
    rows += [(k, f"https://c.example/{k:02}", f"<div>Notice</div><p>Story {k // 4 * 4}</p>") for k in range(10, 22)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Own {k}\nEnd {k}" for k in range(4)} | {k: f"Story {k // 4 * 4}" for k in range(10, 22)}


@pytest.mark.parametrize("together", [3, 1000])
def test_near_pages_are_no_copies(spark, monkeypatch, together):
    monkeypatch.setattr(html_text, "TOGETHER", together)
    rng = random.Random(together)
    rows = []
    for host, end in zip("abcd", (150, 151, 190, 240), strict=True):
        while len(rows) < end:
            digest = rng.randrange(5)
            rows += [(k, host, f"/{k:03}", [k], digest) for k in range(len(rows), len(rows) + rng.choice([1, 1, 2, 40]))]
    rows += [(k, "e", f"/{k:03}", [k], 7) for k in range(len(rows), len(rows) + 20)]  # copies only
    groups = []
    for r in rows:
        if not groups or (groups[-1][-1][1], groups[-1][-1][4]) != (r[1], r[4]):
            groups.append([])
        groups[-1].append(r)
    want = set()
    for g, members in enumerate(groups):
        near = [groups[x][-1 if x < g else 0] for x in (g - 2, g - 1, g + 1, g + 2) if 0 <= x < len(groups)]
        want |= {(m[0], n[0]) for m in members for n in near if n[1] == m[1]}
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "key long, host string, path string, lines array<long>, digest long")
    got = [(r.key, r.other[0]) for r in html_text.near_pages(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_votes_delete_lines_inside_articles_and_marks_do_not_need_them(spark):
    """Against brute force: alignments with the two pages on either side, half of the votes outside, all four inside."""
    rng = random.Random(8)
    notice = ["We use biscuits", "All rights of this site", "Write to us"]
    pages = []
    for k in range(40):
        inside = [(f"Story {k} {j}", html_text.MAIN) for j in range(3)]
        if k < 25:
            inside.insert(rng.randrange(4), ("Subscribe to our letter", html_text.MAIN))  # on every page: a notice
        elif rng.random() < 0.4:
            inside.insert(rng.randrange(4), ("A line that articles quote", html_text.MAIN))
        outside = [(x, html_text.OTHER) for x in notice if rng.random() < 0.7] + [(f"Body {k}", html_text.OTHER)]
        pages.append((f"/{k:02}", inside, outside))
    html_of = lambda p: f"<nav>Menu {p[0]}</nav><article>{''.join(f'<p>{t}</p>' for t, _ in p[1])}</article>{''.join(f'<div>{t}</div>' for t, _ in p[2])}<div class=ad>Ad {p[0]}</div>"
    table = spark.createDataFrame([(k, f"http://h.example{p[0]}", html_of(p)) for k, p in enumerate(pages)], "page_id long, url string, html string")
    want, marks_only = {}, {}
    for k, (_, inside, outside) in enumerate(pages):
        own = inside + outside
        votes = [html_text.common([t for t, _ in own], [t for t, _ in pages[x][1] + pages[x][2]]) for x in (k - 2, k - 1, k + 1, k + 2) if 0 <= x < len(pages)]
        n = [sum(i in v for v in votes) for i in range(len(own))]
        gone = {i for i, (_, kind) in enumerate(own) if 2 * n[i] >= len(votes) and kind == html_text.OTHER or n[i] == 4}
        want[k], marks_only[k] = ("\n".join(t for i, (t, _) in enumerate(own) if i not in x) for x in (gone, set()))
    assert {r.page_id: r.text for r in html_text.extract(table).collect()} == want
    assert {r.page_id: r.text for r in html_text.extract(table, differencing=False).collect()} == marks_only
    assert not any("Subscribe" in want[k] for k in range(3, 22)) and any("articles quote" in t for t in want.values())


def test_quotes_that_are_never_closed_and_long_pages(spark):
    rows = [(1, "http://a.example/", '<p>a</p><a title="foo>bar</a><p>z</p>'), (2, "http://a.example/", "<p data=it's>one</p><p class='x'>two"), (3, "http://a.example/", "<div>" + "".join(f"<p>line {k} of many</p>" for k in range(30000)) + "</div>"), (4, "http://a.example/", "x" * 500000), (5, "http://a.example/", "<" * 20000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "a\nbar\nz" and got[2] == "one\ntwo" and got[3].count("\n") == 29999 and got[4] == "x" * 500000


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(4)

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        at = html_text.common(a, b)
        assert at == sorted(set(at)) and len(at) == brute(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in at)


def test_pipeline_stages(spark, tmp_path, odd):
    import corpus_pipeline as p

    rng = random.Random(13)
    many = [f"word{k}" for k in range(500)]
    sentence = lambda n: " ".join(rng.choices(many, k=n)).capitalize() + "."
    item = " ".join(rng.choices(many, k=30))
    good = [(1000 + k, "\n".join(sentence(12) for _ in range(4))) for k in range(80)]
    rows = [*odd, *good, *((2000 + k, good[k][1]) for k in range(5)), *((3000 + k, "\n".join(sentence(9).upper() + "!!" for _ in range(4))) for k in range(40)), (4000, f"{sentence(12)}\n{item.capitalize()}.\n{sentence(12)}"), (4001, f"{sentence(12)}\n{sentence(12)} mail me@mail.example.com")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 3000 <= i < 4000 else 1, 0) for i, _ in rows if i and i >= 1000], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/out{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out{k}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if k == 0:
            assert not any(i and 3000 <= i < 4000 for i in ids) and {i for i, _ in good} <= ids
        if k == 1:
            assert {i for i, _ in good} <= ids and not any(i and 2000 <= i < 3000 for i in ids)
        if k == 2:
            assert 4000 not in ids and docs.count() == before.count() - 1
        if k == 3:
            assert docs.where("doc_id = 4001 and text like '%[EMAIL]'").count() == 1 and docs.count() == before.count()
    assert {i for i, _ in good} <= ids and docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert p.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_keeps_every_text_of_a_repeated_id(spark, tmp_path):
    import corpus_pipeline as p

    long = lambda w, n=12: " ".join(f"{w}{k}" for k in range(n))
    rows = [(5, long("a"), 1), (5, long("b"), 2), (7, long("c"), 3), (None, long("d"), 4), (None, long("c"), 5), (9, long("b"), 6), (8, "", 7), (8, "", 8), (None, None, 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for i, t, k in rows], "doc_id long, text string, lang string, source string, _row long")
    got = p.keep_one_of_each_group(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r._row for r in got.collect()) == [1, 2, 3, 4, 7, 8, 9]


def test_pipeline_of_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as p

    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, token long, component_id long, item_id long, spans string, length long, start long, row long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("none", []), ("some", [(1, "a text of some words, with a@b.co inside", "en", "s", 9, 0.5, 1, 2, 3, "x", 4, 5, 6), (2, None, None, None, None, None, None, None, None, None, None, None, None)])):
        docs = spark.createDataFrame(rows, columns)
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
        packed = p.pack_sequences(spark, p.mask_personal_data(spark, docs, str(tmp_path)), str(tmp_path))
        assert packed.count() == len(rows), name
