"""Independent audits of published claims against stored bodies, one for each method, in SQL functions.

Nothing here uses the extractors or their gates: a claim is supported only if the cited body is stored under its digest, the
cited span stands at its place, and the rules of the claim's method, written a second time, hold on them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Column]]

#: Hosts of social platforms, career words of a path, codes of a permanent move, hops of a chain.
SOCIAL_HOST = r"^(?:www\.|m\.|mobile\.|[a-z]{2}(?:-[a-z]{2})?\.)?(?:facebook|fb|linkedin|instagram|twitter|x|youtube|tiktok)\.com$"
CAREER = "job|career|karriere|stilling|ledig|rekrutter"
PERMANENT, HOPS = (301, 308), 3
_NUMBER = r"(?i)org[a-z]*\.?\s*(?:nr|nummer|no|number)\.?\s*:?\s*(?:NO\s*)?([0-9]{3}[ .]?[0-9]{3}[ .]?[0-9]{3})(?![0-9])"


def _shown(markup: Column) -> Column:
    """The text between tags, in single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"(?U)\s+", " "))


def _holds_name(said: Column, name: Column) -> Column:
    safe = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|#-])", r"\\$1")
    return F.rlike(said, F.concat(F.lit(r"(?iuU)(?<!\w)"), safe, F.lit(r"(?!\w)")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _only_number(said: Column, subject: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit(_NUMBER), F.lit(1)), _digits))
    return (F.size(found) == 1) & F.array_contains(found, subject)


def _json(doc: str, path: str | Column) -> Column:
    """The value at a path, which may be a column."""
    return F.call_function("get_json_object", F.col(doc), F.lit(path) if isinstance(path, str) else path)


def _said(value: Column) -> Column:
    """A JSON value's text without the quotes."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def _host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1)


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def _letters(text: Column) -> Column:
    """Lower-case ASCII letters and digits, Norwegian letters spelled out, without a legal form at the end."""
    plain = F.regexp_replace(F.translate(F.regexp_replace(F.lower(text), "æ", "ae"), "øåéèóòüöäáàñç", "oaeeoouoaaanc"), r"\s+(?:as|asa|ans|da|nuf|sa|ab|ltd|inc)\.?$", "")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def _registry() -> Rules:
    row = lambda path: _json("body", path)
    return [("the row is another company's", row("$.organisation_number") == F.col("subject")), ("the row does not say so", row(F.col("locator")) == _said(F.col("value_json")))]


def _accounts() -> Rules:
    filing = F.regexp_extract("locator", r"^(\$\[[0-9]+\])", 1)
    at = lambda rest: _json("body", F.concat(filing, F.lit(rest)))
    return [
        ("the filing is another company's", at(".virksomhet.organisasjonsnummer") == F.col("subject")), ("the filing has no currency", at(".valuta").rlike("^[A-Z]{3}$")), ("the amount is no number", F.col("value_json").rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")),
        ("the filing does not say so", _json("body", F.col("locator")).try_cast("decimal(38,6)") == F.col("value_json").try_cast("decimal(38,6)")),
    ]


def _posting() -> Rules:
    said = lambda path: _json("body", path)
    return [("the posting is not active", said("$.status") == "ACTIVE"), ("the posting is another employer's", (said("$.employer.orgnr") == F.col("subject")) | (said("$.employer.parent") == F.col("subject"))), ("the posting does not say so", said(F.col("locator")) == _said(F.col("value_json")))]


def _structured() -> Rules:
    number = F.coalesce(*(F.get_json_object("span", p) for p in ("$.identifier.value", "$.identifier", "$.taxID", "$.vatID")))
    return [("the object carries another number", F.regexp_replace(F.upper(number), "^NO|MVA$|[^0-9A-Z]", "") == F.col("subject")), ("the object does not say so", _json("span", F.col("locator")) == _said(F.col("value_json")))]


def _operator() -> Rules:
    said = _shown(F.col("span"))
    return [("the block does not name the company", _holds_name(said, F.col("name"))), ("the block has no number or another one", _only_number(said, F.col("subject"))), ("the block asks or quotes", ~said.rlike(r"[?\"“”«»]")), ("the block is too long", F.length(said) <= 1500)]


def _statement() -> Rules:
    said = _said(F.col("value_json"))
    return [("the statement does not stand in the span", F.contains(_shown(F.col("span")), said)), ("the statement does not open with the name", F.startswith(F.lower(said), F.lower(F.regexp_replace("name", r"\s+(?:AS|ASA)$", "")))), ("the statement quotes, doubts or asks", ~said.rlike(r"(?iu)[?:\"“”«»]|\b(?:not|ikke|never|aldri|if|hvis|said|sier)\b"))]


def _social() -> Rules:
    handle = F.regexp_extract("span", r"^https?://[^/]+/(?:company/|channel/|user/|c/)?@?([^/?#]+)", 1)
    return [("the address is no platform's", _host(F.col("span")).rlike(SOCIAL_HOST)), ("the handle is not that of the claim", F.endswith(F.lower(_said(F.col("value_json"))), F.lower(handle))), ("the handle does not hold the name", (F.length(_letters(F.col("name"))) >= 3) & F.contains(_letters(handle), _letters(F.col("name"))))]


def _website() -> Rules:
    said = _shown(F.col("body"))
    return [("the site is not the registered one", _bare(_host(_said(F.col("value_json")))) == _bare(F.regexp_replace("registered", r"^https?://|/.*$", ""))), ("the page names neither number nor company", F.contains(_digits(said), F.col("subject")) | _holds_name(said, F.col("name"))), ("the page names another number", F.forall(F.regexp_extract_all(said, F.lit(_NUMBER), F.lit(1)), lambda n: _digits(n) == F.col("subject")))]


def _career() -> Rules:
    url = _said(F.col("value_json"))
    return [("the link leaves the host", _bare(_host(url)) == _bare(_host(F.col("source_url")))), ("the path is no career page's", F.regexp_extract(F.lower(url), r"^https?://[^/]+(/[^?#]*)", 1).rlike(CAREER)), ("the source does not link it", F.contains(F.col("body"), F.regexp_extract(url, r"^https?://[^/]+(/.*)$", 1)))]


def _dated() -> Rules:
    at = F.get_json_object("value_json", "$.published_at")
    return [("the time does not stand in the span", F.contains(F.col("span"), at)), ("the headline does not stand in the span", F.contains(_shown(F.col("span")), F.get_json_object("value_json", "$.headline"))), ("the time is no date", F.substring(at, 1, 10).try_cast("date").isNotNull())]


#: The audit of each method: rules that must hold, the first that does not is the reason.
AUDITS: dict[str, Callable[[], Rules]] = {
    "registry_row_v1": _registry, "official_accounts_v1": _accounts, "posting_employer_v1": _posting, "exact_identifier_jsonld_v1": _structured, "explicit_subject_html_v1": _operator, "registry_linked_business_statement_v1": _statement,
    "social_profile_link_v1": _social, "registry_host_corroboration_v1": _website, "career_role_link_v1": _career, "careers_page_url_v1": _career, "dated_article_datetime_v1": _dated,
}


def audit(claims: DataFrame, snapshots: DataFrame, subjects: DataFrame) -> DataFrame:
    """claim_id, subject, method, reason: why a claim is not supported, null if it is.

    claims: claim_id, subject, method, value_json, locator, content_sha256, span_start, span (null where the body as a whole is
    cited), source_url. snapshots: content_sha256, body. subjects: subject, name, registered. Bodies are joined by digest and
    hashed again; a claim whose body or company is missing is not supported.
    """
    bodies = snapshots.select("content_sha256", "body").dropDuplicates(["content_sha256"])
    rows = claims.join(bodies, "content_sha256", "left").join(subjects.select("subject", "name", "registered").dropDuplicates(["subject"]).withColumn("_known", F.lit(True)), "subject", "left")
    placed = F.col("span").isNull() | (F.substr("body", F.col("span_start") + 1, F.length("span")) == F.col("span"))
    shared = [("the body is not stored", F.col("body").isNotNull()), ("the stored body is not the cited one", F.sha2(F.col("body").cast("binary"), 256) == F.col("content_sha256")), ("no such company", F.col("_known")), ("the span is not at its place", placed), ("no auditor for the method", F.col("method").isin(*AUDITS))]
    first = lambda rules: F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in rules), F.lit(None).cast("string"))
    own = F.lit(None).cast("string")
    for method, rules in AUDITS.items():
        own = F.when(F.col("method") == method, first(rules())).otherwise(own)
    return rows.select("claim_id", "subject", "method", F.coalesce(first(shared), own).alias("reason"))


def chain_reasons(hops: DataFrame, key: str) -> DataFrame:
    """(key, reason) of redirect chains: null if it leads by permanent moves, each from where the last one went, to one new host.

    hops: key, hop (from 0), source, target, http_status; requested and effective addresses are those of the first and last hop.
    """
    ordered = F.array_sort(F.collect_list(F.struct("hop", "source", "target", "http_status")))  # more than HOPS of them is a fault
    g = hops.groupBy(key).agg(ordered.alias("h"))
    n = F.size("h")
    linked = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i >= n) | (F.get("h", i)["source"] == F.get("h", i - 1)["target"]))
    hosts = F.array_distinct(F.concat(F.array(_bare(_host(F.get("h", F.lit(0))["source"]))), F.transform("h", lambda x: _bare(_host(x["target"])))))
    secure = F.forall("h", lambda x: x["target"].startswith("https://"))
    faults = [("too many hops", n <= HOPS), ("hops are missing or repeated", F.transform("h", lambda x: x["hop"].cast("int")) == F.sequence(F.lit(0), n - 1)), ("a hop starts elsewhere", linked), ("a move is not permanent", F.forall("h", lambda x: x["http_status"].isin(*PERMANENT))), ("a target is not secure", secure), ("the host changes more than once", F.size(hosts) <= 2)]
    return g.select(key, F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in faults), F.lit(None).cast("string")).alias("reason"))


def recall(expected: DataFrame, published: DataFrame, audited: DataFrame, key: Sequence[str]) -> DataFrame:
    """key and outcome of every expected fact: found and supported, found without support, or missed."""
    ok = published.join(audited.select("claim_id", F.col("reason").isNull().alias("ok")), "claim_id", "left").groupBy(*key).agg(F.max(F.coalesce("ok", F.lit(False))).alias("ok"))
    return expected.select(*key).distinct().join(ok, list(key), "left").select(*key, F.when(F.col("ok"), "supported").when(F.col("ok").isNotNull(), "unsupported").otherwise("missed").alias("outcome"))


def reuse(previous: DataFrame, snapshots: DataFrame, subjects: DataFrame) -> DataFrame:
    """The prior claims, after an audit of each against the stored bodies; one that is not supported refuses the whole run."""
    bad = audit(previous, snapshots, subjects).where("reason is not null").take(1)
    if bad:
        raise ValueError(f"a prior claim is not supported: {bad[0].asDict()}")
    return previous
