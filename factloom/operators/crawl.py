"""Crawl rules over saved bodies: robots files by origin, and the pages that a bounded crawl of each company's site visits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import htmlx, urls
from factloom.functions.crawl import robots_allow
from factloom.session import shared_dir, small

#: Pages of a site that are visited at most, and the kinds of links in the order in which they are followed.
MOST_PAGES = 3
ORDER = ("legal", "product", "showcase", "career", "news", "other")


def origin(url: str) -> F.Column:
    return F.regexp_extract(F.lower(F.col(url)), r"^(https?://[^/?#]+)", 1)


def robots_decisions(pages: DataFrame, url: str, robots: DataFrame, agent: str = "*") -> DataFrame:
    """pages with allowed: what the saved robots file of the page's origin says; null if that file can't be read.

    robots: origin, body (binary; null where there is none, which allows all). Each file is parsed once for each batch of pages,
    and pages of an origin whose file was never asked for are not allowed.
    """

    @F.pandas_udf(T.BooleanType())
    def allowed(bodies: pd.Series, links: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for body, link in zip(bodies, links, strict=True):
            key = (body, link)
            if key not in known:
                known[key] = robots_allow(None if body is None else bytes(body), link, agent)
            out.append(known[key])
        return pd.Series(out, dtype=object)

    side = small(robots.select(F.lower("origin").alias("_o"), "body", F.lit(True).alias("_asked")).dropDuplicates(["_o"]))
    both = pages.withColumn("_o", origin(url)).join(side, "_o", "left")
    said = F.when(F.col("_asked"), allowed("body", F.col(url))).otherwise(F.lit(False))
    return both.select(*pages.columns, said.alias("allowed"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def site_links(sources: pd.Series, pages: pd.Series) -> pd.Series:
    """Safe addresses on the page's own host or its www alias, in page order, each once."""
    out = []
    for source, page in zip(sources, pages, strict=True):
        hosts = urls.hosts_of(urls.host_of(page)) if page else set()
        found = (urls.safe_url(urls.resolve(page, link), hosts) for _, tag, link in htmlx.links(source) if tag == "a") if source and hosts else ()
        out.append(list(dict.fromkeys(u for u in found if u)))
    return pd.Series(out)


def crawl(starts: DataFrame, bodies: DataFrame, key: str, most: int = MOST_PAGES) -> DataFrame:
    """(key, url, turn): the pages that are visited of each company, from its start page on, `most` at most.

    starts: key, url. bodies: url, html. Each turn visits the saved page that the pages visited so far link to, by kind of
    link in ORDER, then by the turn and place where it was first linked; pages that are not saved are passed over, and none is
    visited twice. A turn is one join for all companies.
    """
    shared_dir(starts.sparkSession)
    saved = bodies.select("url", "html").dropDuplicates(["url"])
    visited = starts.select(key, "url").dropDuplicates([key]).join(saved.select("url"), "url", "left_semi").select(key, "url", F.lit(0).alias("turn")).checkpoint()
    for turn in range(1, most):
        linked = visited.join(saved, "url").select(key, "turn", F.posexplode(site_links("html", "url")).alias("at", "url"))
        fresh = linked.join(visited.select(key, "url"), [key, "url"], "left_anti").join(saved.select("url"), "url", "left_semi")
        kind = urls.link_kind(F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1))
        rank = F.coalesce(*(F.when(kind == k, F.lit(n)) for n, k in enumerate(ORDER)), F.lit(len(ORDER)))
        chosen = fresh.groupBy(key).agg(F.min_by("url", F.struct(rank.alias("rank"), "turn", "at")).alias("url"))
        visited = visited.unionByName(chosen.select(key, "url", F.lit(turn).alias("turn"))).checkpoint()
    return visited
