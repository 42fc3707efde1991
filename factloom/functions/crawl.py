"""Rules of acquiring pages: robots files, sitemaps, redirect chains, domain hypotheses, link budgets."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

from factloom.functions import text, urls

#: Caps of a sitemap, of sitemaps of a site, of a redirect chain, and the codes that move for good.
SITEMAP_ELEMENTS, SITEMAPS, HOPS, PERMANENT = 15_000, 2, 3, (301, 308)
_DIRECTIVE = re.compile(rb"^[ \t]*(?:user-agent|allow|disallow|sitemap|crawl-delay|request-rate)[ \t]*:", re.I | re.M)
_PAGE = re.compile(rb"\s*<(?:!doctype\s+html|html[\s>])", re.I)


def robots_allow(body: bytes | None, url: str, agent: str = "*") -> bool | None:
    """Whether a robots file allows a page; no file or a web page in its place has no rules; null: not readable."""
    if body is None or _PAGE.match(body.removeprefix(b"\xef\xbb\xbf")) and not _DIRECTIVE.search(body):
        return True
    try:
        lines = body.decode("utf-8").splitlines()
    except UnicodeDecodeError:
        return None
    rules = RobotFileParser()
    rules.parse(lines)
    return rules.can_fetch(agent, url)


def advertised_sitemaps(body: bytes, host: str) -> list[str]:
    """At most two sitemap addresses of a robots file, on the same host or its www alias."""
    found = re.findall(r"^\s*sitemap\s*:\s*(\S+)", body.decode("utf-8", "replace"), re.I | re.M)
    fine = [u for u in map(urls.safe_url, found) if u and urlsplit(u).hostname in urls.hosts_of(host)]
    return list(dict.fromkeys(fine))[:SITEMAPS]


def sitemap_links(body: bytes, host: str, prefix: str = "/") -> list[str]:
    """Addresses of a sitemap under a path prefix, legal pages first; entities and oversized files are refused."""
    if b"<!DOCTYPE" in body.upper() or b"<!ENTITY" in body.upper():
        return []
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return []
    elements = list(root.iter())
    if len(elements) > SITEMAP_ELEMENTS:
        return []
    found = [urls.safe_url((e.text or "").strip(), urls.hosts_of(host)) for e in elements if e.tag.rsplit("}", 1)[-1] == "loc"]
    inside = [u for u in dict.fromkeys(found) if u and urlsplit(u).path.startswith(prefix)]
    return sorted(inside, key=lambda u: not re.search(urls.LINK_KINDS["legal"], urlsplit(u).path.lower()))


def chain_fault(chain: list[dict], requested: str, effective: str, registered_host: str, denied: frozenset[str] = frozenset()) -> str | None:
    """Why a redirect chain does not lead from the registered site to its successor; null: it does.

    chain: hops with from, to and http_status. Moves are permanent; the host changes at most once, from the root of the
    registered host, to a public host that nobody's tenants share; afterwards only that host or its www alias follows.
    """
    if not 1 <= len(chain) <= HOPS:
        return "not one to three hops"
    at, crossed = requested, None
    for hop in chain:
        if hop["from"] != at or hop["http_status"] not in PERMANENT:
            return "a hop does not follow or is not permanent"
        target = urls.safe_url(urljoin(at, hop["to"]))
        if target is None:
            return "a destination is not allowed"
        here, there = urlsplit(at).hostname or "", urlsplit(target).hostname or ""
        if there not in urls.hosts_of(crossed or here):
            if crossed or here not in urls.hosts_of(registered_host):
                return "the chain leaves the successor"
            if urlsplit(at).path not in ("", "/", "/robots.txt") or urlsplit(at).query:
                return "a page moved, not the site"
            own = urls.registrable(there)
            if own is None or own in denied or re.fullmatch(r"[\d.]+|localhost", there):
                return "the destination is not a site of one owner"
            crossed = there
        at = target
    return None if at == effective else "the chain ends elsewhere"


def domain_hypotheses(name: str, endings: tuple[str, ...] = (".no", ".com")) -> list[str]:
    """Addresses that a legal name suggests: its words together and joined by hyphens."""
    words = [w for w in re.split(r"[^a-z0-9]+", text.ascii_fold(re.sub(r"\s+(?:AS|ASA|ANS|DA|SA|ENK|NUF)$", "", name.strip(), flags=re.I))) if w]
    stems = dict.fromkeys(x for x in ("".join(words), "-".join(words)) if 3 <= len(x) <= 63)
    return [f"https://{s}{e}/" for s in stems for e in endings]


def discovery_rank(name: str, link: str) -> tuple:
    """Sort key of a discovered link: hosts with a word of the name first, newsrooms last, legal pages before others."""
    p = urlsplit(link)
    host = (p.hostname or "").lower()
    named = any(t in host.replace("-", "") for t in urls.name_tokens(name) if t not in urls.GENERIC)
    return not named, bool(re.search(r"news|presse?\b|nyhet", host + p.path)), not re.search(urls.LINK_KINDS["legal"], p.path.lower()), link


def content_order(links: list[str]) -> list[str]:
    """Links by turns of product, careers, news and other pages, each page once; showcases follow the products."""
    groups: dict[str, list[str]] = {k: [] for k in ("product", "career", "news", "other")}
    shows: list[str] = []
    seen = set()
    for link in links:
        if (key := urls.page_key(link)) in seen:
            continue
        seen.add(key)
        p = urlsplit(link)
        target = (p.path + (f"?{p.query}" if p.query else "")).lower()
        kind = next((k for k in ("product", "career", "news") if re.search(urls.LINK_KINDS[k], target)), None)
        (groups[kind or "other"] if kind or not re.search(urls.LINK_KINDS["showcase"], target) else shows).append(link)
    groups["product"] += shows
    turns = max(map(len, groups.values()), default=0)
    return [g[k] for k in range(turns) for g in groups.values() if k < len(g)]
