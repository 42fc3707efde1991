"""Rules of acquiring pages."""

from factloom.functions import crawl


def test_robots():
    assert crawl.robots_allow(None, "https://a.no/x") and crawl.robots_allow(b"<html>x", "https://a.no/x") and not crawl.robots_allow(b"User-agent: *\nDisallow: /x", "https://a.no/x/y") and crawl.robots_allow(b"\xff\xfe", "https://a.no/") is None
    assert crawl.advertised_sitemaps(b"Sitemap: https://www.a.no/s.xml\nsitemap: https://b.no/s.xml", "a.no") == ["https://www.a.no/s.xml"]


def test_sitemaps():
    body = b'<urlset xmlns="http://x"><url><loc>https://a.no/produkt</loc></url><url><loc> https://a.no/personvern </loc></url><url><loc>http://a.no/z</loc></url></urlset>'
    assert crawl.sitemap_links(body, "a.no") == ["https://a.no/personvern", "https://a.no/produkt"]
    assert crawl.sitemap_links(b"<!DOCTYPE x>" + body, "a.no") == [] and crawl.sitemap_links(b"<a", "a.no") == []


def test_redirect_chains():
    hop = lambda a, b, s=301: {"from": a, "to": b, "http_status": s}
    ok = [hop("https://a.no/", "https://new.no/")]
    assert crawl.chain_fault(ok, "https://a.no/", "https://new.no/", "www.a.no") is None
    assert crawl.chain_fault([hop("https://a.no/x", "https://new.no/")], "https://a.no/x", "https://new.no/", "a.no") and crawl.chain_fault([hop("https://a.no/", "https://new.no/", 302)], "https://a.no/", "https://new.no/", "a.no")
    assert crawl.chain_fault([*ok, hop("https://new.no/", "https://other.no/")], "https://a.no/", "https://other.no/", "a.no") and crawl.chain_fault(ok, "https://a.no/", "https://new.no/", "a.no", frozenset(["new.no"])) and crawl.chain_fault([], "https://a.no/", "https://a.no/", "a.no")
    assert crawl.chain_fault([*ok, hop("https://new.no/", "/hjem")], "https://a.no/", "https://new.no/hjem", "a.no") is None


def test_link_order():
    u = lambda *p: [f"https://example.no/{x}" for x in p]
    assert crawl.content_order(u("tjenester/a", "tjenester/b", "karriere", "siste-nytt")) == u("tjenester/a", "karriere", "siste-nytt", "tjenester/b")
    assert crawl.content_order(u("referanser", "prosjekter", "tjenester/bygg", "referanser/")) == u("tjenester/bygg", "referanser", "prosjekter")
    assert crawl.domain_hypotheses("Fjordheim Bygg AS") == ["https://fjordheimbygg.no/", "https://fjordheimbygg.com/", "https://fjordheim-bygg.no/", "https://fjordheim-bygg.com/"]
    assert sorted(["https://x.no/", "https://fjordheim.no/"], key=lambda x: crawl.discovery_rank("Fjordheim AS", x))[0] == "https://fjordheim.no/"
