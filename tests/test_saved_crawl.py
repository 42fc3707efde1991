"""Crawl over saved bodies against a sequential crawl, robots files by origin."""

import random
import re

from factloom.functions import urls
from factloom.operators import crawl

KINDS = ["/om-oss", "/produkt", "/x", "/jobb", "/nyhet", "/referanse"]


def test_crawl_is_that_of_each_site_alone(spark):
    rng = random.Random(6)
    bodies, starts = {}, []
    for s in range(25):
        pages = [f"https://h{s}.no/"] + [f"https://h{s}.no{rng.choice(KINDS)}/{k}" for k in range(8)]
        for p in pages[: rng.randint(1, 9)]:
            links = rng.choices([*pages, "/x/99", "https://other.no/om-oss", "http://h1.no/"], k=rng.randrange(6))
            bodies[p] = "".join(f'<a href="{x}">x</a>' for x in links)
        starts.append((s, pages[0]))

    def kind(url):
        target = re.sub("^https://[^/]+", "", url)
        return crawl.ORDER.index(next((k for k, p in urls.LINK_KINDS.items() if re.search(p, target)), "other"))

    want = {}
    for s, first in starts:
        seen = [first] if first in bodies else []
        while seen and len(seen) < 3:
            found = []
            for turn, page in enumerate(seen):
                links = list(dict.fromkeys(u for x in re.findall('href="([^"]*)"', bodies[page]) if (u := urls.safe_url(urls.resolve(page, x), urls.hosts_of(f"h{s}.no")))))
                found += [(kind(u), turn, at, u) for at, u in enumerate(links) if u in bodies and u not in seen]
            if not found:
                break
            seen.append(min(found)[3])
        want |= {(s, u): n for n, u in enumerate(seen)}
    got = crawl.crawl(spark.createDataFrame(starts, "k int, url string"), spark.createDataFrame(list(bodies.items()), "url string, html string"), "k")
    assert {(r.k, r.url): r.turn for r in got.collect()} == want and max(want.values()) == 2


def test_robots_of_each_origin(spark):
    robots = spark.createDataFrame([("https://a.no", bytearray(b"User-agent: *\nDisallow: /hemmelig")), ("https://b.no", None), ("https://c.no", bytearray(b"\xff\xfe"))], "origin string, body binary")
    pages = spark.createDataFrame([(1, "https://A.no/x"), (2, "https://a.no/hemmelig/1"), (3, "https://b.no/hemmelig"), (4, "https://d.no/"), (5, "https://c.no/")], "id int, url string")
    got = {r.id: r.allowed for r in crawl.robots_decisions(pages, "url", robots).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: None}
