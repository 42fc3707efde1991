"""Main text of web pages by nearest-URL page differencing.

Pages of a host are sorted by URL path, and each is compared with its near pages: the NEAR groups before and behind it,
a group being pages side by side with equal unmarked lines, as copies tell nothing about what the site repeats. The
page's unmarked lines and those of a near page are aligned by their longest common subsequence; an alignment is a vote to
delete the lines that are shared: menus, notices and footers that a site repeats. Outside article and main elements half of
the votes delete a line; inside them all of 2 * NEAR votes are needed, as articles quote each other. Lines of elements that
are marked as menus, adverts, forms or comments go even if not shared, as these differ from page to page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import ready, small, table, written

#: Elements by their part in a page.
RAW = frozenset("script style noscript template iframe svg math textarea select option button object head title".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th wbr option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?=>|\Z)|[^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: What a line is: of the main region, of a marked element, or of neither.
MAIN, MARK, OTHER = 0, 1, 2


def _is_marked(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in BOILERPLATE or tag == "header" and not in_main:
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and MARKED.search(value) or name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, MAIN, MARK or OTHER) of each block with text, in page order; unclosed and stray tags are forgiven."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    state = {"main": 0, "kind": OTHER}
    marked: list[str] = []  # the marked element that is open, and open elements of its name inside
    raw = ""

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, MARK if marked else MAIN if state["main"] else OTHER))

    for m in _TOKEN.finditer(page or ""):
        tag = m[2]
        if not tag:
            if not raw and (m[0][0] != "<" or m[0] == "<"):
                buffer.append(m[0])
            continue
        tag = tag.lower()
        if raw:
            raw = "" if m[1] and tag == raw else raw
            continue
        if not m[1] and tag in RAW:
            raw = "" if m[3].rstrip().endswith("/") and tag in ("svg", "math") else tag
            buffer.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        elif tag in SPACED:
            buffer.append(" ")
        if tag in VOID or tag in ("html", "body"):
            continue
        if m[1]:
            if marked and tag == marked[0]:
                flush()
                marked.pop()
            elif tag in ("article", "main"):
                state["main"] = max(0, state["main"] - 1)
        elif marked:
            if tag == marked[0]:
                marked.append(tag)
            elif tag in ("article", "main") and marked[0] in ("nav", "header") and not state["main"]:
                marked.clear()  # a menu that was never closed
                state["main"] += 1
        elif _is_marked(tag, m[3], state["main"] > 0):
            flush()
            marked.append(tag)
        elif tag in ("article", "main") or 'role="main"' in m[3]:
            state["main"] += 1 if tag in ("article", "main") else 0
    flush()
    return out


def common(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence with b (Hunt and Szymanski; equal heads and tails first)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        places[b[j]].append(j)
    ends: list[int] = []
    chain: list[tuple | None] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k] = j
                chain[k] = link
    middle, link = [], chain[-1] if chain else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


#: Groups of pages on either side that a page is compared with.
NEAR = 2


def main_text(page: list[tuple[str, int]], deleted: set[int]) -> str:
    """The lines that are neither deleted nor marked; deleted: places among the unmarked lines."""
    return "\n".join(text for k, (text, _) in enumerate(_needed(page)) if k not in deleted)


def _hash(text: str, kind: int) -> int:
    """63 bits of a line's hash, and in the lowest bit whether it is of the main region."""
    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) & ~1 | (kind == MAIN)) - (1 << 63)


def _needed(page: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The lines that main_text() can keep: those that are not marked."""
    return [x for x in page if x[1] != MARK]


def _digest(page: list[tuple[str, int]]) -> int:
    """Equal for pages with the same unmarked lines."""
    return xxhash.xxh64_intdigest("\n".join(t for t, _ in _needed(page)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path or "/"
    except ValueError:
        return "", url or ""


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        where = [_address(u) for u in batch.column("url").to_pylist()]
        pages = [lines(p) for p in batch.column("html").to_pylist()]
        found, digests = [[_hash(t, kind) for t, kind in _needed(p)] for p in pages], [_digest(p) for p in pages]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([h for h, _ in where]), pa.array([p for _, p in where]), pa.array(found, pa.list_(pa.int64())), pa.array(digests, pa.int64())], names=["key", "host", "path", "lines", "digest"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the place in it, the group of copies, and whether the row is the group's first or last here."""
    part, at, run, before, held = TaskContext.get().partitionId(), 0, -1, None, None

    def done(held: tuple, after: tuple | None) -> pa.RecordBatch:
        batch, at, runs, first, pages = held
        n = len(pages)
        last = [a != b for a, b in zip(pages, [*pages[1:], after], strict=True)]
        for name, values in (("part", np.full(n, part, np.int64)), ("at", np.arange(at, at + n)), ("run", np.array(runs, np.int64)), ("first", np.array(first, bool)), ("last", np.array(last, bool))):
            batch = batch.append_column(name, pa.array(values))
        return batch

    for batch in batches:
        pages = list(zip(batch.column("host").to_pylist(), batch.column("digest").to_pylist(), strict=True))
        if not pages:
            continue
        if held:
            yield done(held, pages[0])
        runs, first = [], []
        for page in pages:
            first.append(page != before)
            run += first[-1]
            runs.append(run)
            before = page
        held = batch, at, runs, first, pages
        at += len(pages)
    if held:
        yield done(held, None)


#: So many rows of a long group of copies meet the pages before and behind it in one place.
TOGETHER = 1000


def near_pages(rows: DataFrame) -> DataFrame:
    """(key, lines, other): each page's lines with those of a page of each group near it on its host, by URL path.

    rows: key, host, path, lines, digest. A global order by host and path gives a number to every group of copies, most
    often a single page; pages meet the last page of each of the NEAR groups before and the first of each behind by an
    equi-join, so that no host stands in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "host", "path", "key").sortWithinPartitions("host", "path", "key")
    numbered = written(ordered.mapInArrow(_numbered, "key long, host string, path string, lines array<long>, digest long, part long, at long, run long, first boolean, last boolean"), "url-order")
    # a row for each partition; its first group may go on with the last one of the partition before
    page, order = F.struct("host", "digest"), Window.orderBy("part")
    size = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), (F.max("run") + 1).alias("runs"), F.min_by(page, "at").alias("head"), F.max_by(page, "at").alias("tail"))
    size = size.withColumn("on", F.coalesce(F.col("head") == F.lag("tail").over(order), F.lit(False)))
    sums = order.rowsBetween(Window.unboundedPreceding, 0)
    base = size.select("part", "n", "on", F.coalesce(F.lead("on").over(order), F.lit(False)).alias("next_on"), (F.sum("n").over(sums) - F.col("n")).alias("base"), (F.sum(F.col("runs") - F.col("on").cast("long")).over(sums) - F.col("runs")).alias("runs_before"))
    first = F.col("first") & ~((F.col("at") == 0) & F.col("on"))
    last = F.col("last") & ~((F.col("at") == F.col("n") - 1) & F.col("next_on"))
    placed = numbered.join(F.broadcast(base), "part").select((F.col("at") + F.col("base")).alias("no"), (F.col("run") + F.col("runs_before")).alias("run"), first.alias("first"), last.alias("last"), "key", "host", "path", "lines")
    # long groups, at most one for each TOGETHER rows, are dealt out by the number of the row
    long = placed.groupBy("run").agg(F.min("no").alias("low"), F.max("no").alias("high")).where(F.col("high") - F.col("low") >= TOGETHER)
    long = F.broadcast(written(long.select("run", F.expr(f"low div {TOGETHER}").alias("low"), F.expr(f"high div {TOGETHER}").alias("high")), "copies"))
    zero = F.lit(0).cast("long")
    own = placed.join(long, "run", "left").select("run", F.when(F.col("low").isNull(), zero).otherwise(F.expr(f"no div {TOGETHER}")).alias("deal"), "key", "host", "lines")
    # the lines of a group's first page go to the groups before, those of its last page to the groups behind
    to = F.array_compact(F.array(*(F.when(F.col(end), F.col("run") + d * n) for n in range(1, NEAR + 1) for end, d in (("first", -1), ("last", 1)))))
    sent = placed.where("first or last").select(F.col("host").alias("h"), F.col("lines").alias("other"), F.explode(to).alias("run"))
    sent = sent.join(long, "run", "left").withColumn("deal", F.explode(F.when(F.col("low").isNull(), F.array(zero)).otherwise(F.sequence("low", "high")))).drop("low", "high")
    return own.join(sent, ["run", "deal"]).where("host = h").select("key", "lines", "other")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shared): a vote for each pair of pages; 2 * place of a shared line, and 1 if it is of the main region."""
    for batch in batches:
        votes = []
        for own, other in zip(batch.column("lines").to_pylist(), batch.column("other").to_pylist(), strict=True):
            votes.append([2 * k + (own[k] & 1) for k in common([x >> 1 for x in own], [x >> 1 for x in other])])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(votes, pa.list_(pa.int32()))], names=["key", "shared"])


def _deleted(pairs: DataFrame) -> DataFrame:
    """(key, deleted): the places of lines that enough votes delete, for the pages that have any."""
    votes = pairs.mapInArrow(_aligned, "key long, shared array<int>").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("shared")).alias("all"))  # 2 * NEAR votes at most
    times = lambda x: F.size(F.filter("all", lambda y: y == x))
    goes = lambda x: F.when(x % 2 == 0, 2 * times(x) >= F.col("n")).otherwise((times(x) == F.col("n")) & (F.col("n") >= 2 * NEAR))
    return votes.select("key", F.transform(F.filter(F.array_distinct("all"), goes), lambda x: F.shiftright(x, 1)).alias("deleted")).where(F.size("deleted") > 0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(lines(p), set(d or ())) for p, d in zip(batch.column("html").to_pylist(), batch.column("deleted").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (columns page_id, url and html).

    Null or empty html gives an empty text; pages without a usable URL are of one nameless host; a page alone on its
    host, or there with copies only, has no shared lines. Repeated rows and null ids give a row each. Other columns are
    ignored; an empty table gives no rows. differencing=False leaves only what marks decide, to measure what alignments do.
    """
    ready(pages.sparkSession)
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    if differencing:
        hashes = keyed.mapInArrow(_hashes, "key long, host string, path string, lines array<long>, digest long").dropDuplicates(["key"])
        deleted = small(written(_deleted(near_pages(hashes)), "deleted", compact=True))
    else:
        deleted = keyed.sparkSession.createDataFrame([], "key long, deleted array<int>")
    return keyed.join(deleted, "key", "left").select("page_id", "url", "html", "deleted").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
