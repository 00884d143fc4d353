"""Scans of script texts for request urls, their methods, headers and parameters, for assets and base urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.matches import NAME_START, WORD_START, around, matches, once, record
from brindle.functions.urls import asset_type, is_asset_url, is_base_url, is_request_url, normal_base, path_params, query_params, url_confidence, url_kind
from brindle.operators.order import first_wins

_URL = r"([\"'`])([^\"'`\r\n]{1,2048})"
_WORD = WORD_START

# The five scans in their order; group numbers of method and url.
SCANS = (
    ("text:fetch", _WORD + r"fetch\s*\(\s*" + _URL + r"\1", 0, 2),
    ("text:method-call", r"(?i)" + NAME_START + r"(?:axios|[A-Za-z_$][A-Za-z0-9_$]*)\.(get|post|put|patch|delete|head|options)\s*\(\s*" + _URL + r"\2", 1, 3),
    ("text:jquery-method", r"(?i)(?:(?<=[A-Za-z0-9_])\$|" + _WORD + r"jQuery)\.(get|post)\s*\(\s*" + _URL + r"\2", 1, 3),
    ("text:xhr-open", r"(?i)\.open\s*\(\s*([\"'`])(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\1\s*,\s*([\"'`])([^\"'`\r\n]{1,2048})\3", 2, 4),
    ("text:config-url", _WORD + r"url\s*:\s*" + _URL + r"\1", 0, 2),
)
#: What a text must have for a scan to find anything.
_GATES = ("fetch", r"(?i)\.(?:get|post|put|patch|delete|head|options)\s*\(", r"(?i)(?:\$|jQuery)\.(?:get|post)", r"(?i)\.open\s*\(", r"url\s*:")
# What names a method, where headers and bodies stand, and the keys in them.
METHOD = r"(?i)" + _WORD + r"(?:method|type)\s*:\s*[\"'`]?([A-Za-z]+)"
HEADERS, HEADER = r"(?is)" + _WORD + r"headers\s*:\s*\{(.{0,700}?)\}", r"[\"']?([A-Za-z][A-Za-z0-9_-]{1,80})[\"']?\s*:"
BODY = r"(?is)" + _WORD + r"(?:data|body|params|query)\s*:\s*(.{0,900})"
QUOTED_KEY, BARE_KEY = r"[\"']([A-Za-z_$][A-Za-z0-9_$.-]{0,100})[\"']\s*:", NAME_START + r"([A-Za-z_$][A-Za-z0-9_$.-]{0,100})\s*:"
SCRIPT_SOURCE = r"(?i)<script\b[^>]*\bsrc\s*=\s*([\"'])([^\"']{1,2048})\1"
QUOTED_FILE = r"(?i)([\"'`])([^\"'`\s]{1,2048}\.(?:js|mjs|css|map)(?:\?[^\"'`\s]*)?)\1"
BASE_SETTING = _WORD + r"(baseUrl|baseURL|apiBase|apiHost|gateway|domainName)\s*:\s*([\"'`])([^\"'`\r\n]{1,2048})\2"
MOST, BEFORE, AFTER = 500, 400, 1200
RESERVED = ("url", "method", "type", "headers", "data", "body", "params")
#: What stands in a header's or a text's lower case, and the signal it gives.
MARKERS = (("authorization", "authorization"), ("bearer", "Bearer"), ("jwt", "JWT"), ("x-token", "x-token"), ("token", "token"))


def method_in(window: Column) -> Column:
    return F.nullif(F.regexp_extract(window, METHOD, 1), F.lit(""))


def headers_in(window: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_extract(window, HEADERS, 1), F.lit(HEADER), F.lit(1)))


def body_params_in(window: Column) -> Column:
    """Quoted keys, then bare keys, of what follows each data, body, params or query."""
    found = F.regexp_extract_all(window, F.lit(BODY), F.lit(1))
    quoted = lambda b: F.regexp_extract_all(b, F.lit(QUOTED_KEY), F.lit(1))
    bare = lambda b: F.filter(F.regexp_extract_all(b, F.lit(BARE_KEY), F.lit(1)), lambda n: ~n.isin(*RESERVED))
    return F.array_distinct(F.flatten(F.transform(found, lambda b: F.concat(quoted(b), bare(b)))))


def auth_signals(headers: Column, *texts: Column, more: Column | None = None) -> Column:
    """Signals in order, each once: of the headers, then of the texts, then of ``more`` texts (an array)."""
    of_header = F.flatten(F.transform(headers, lambda h: F.filter(F.array(
        F.when(F.lower(h) == "authorization", "Authorization"), F.when(F.contains(F.lower(h), F.lit("token")), h)), lambda s: s.isNotNull())))
    marked = lambda t: [F.when(F.contains(F.lower(t), F.lit(m)), signal) for m, signal in MARKERS]
    found = [of_header, F.array(*(x for t in texts for x in marked(t)))]
    if more is not None:
        found.append(F.flatten(F.transform(more, lambda t: F.array(*marked(t)))))
    return F.array_distinct(F.filter(F.concat(*found), lambda s: s.isNotNull()))


def text_calls(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, ord, source, url, method, window, kind, confidence of request urls in texts; ``MOST`` for each script at most.

    All scans of a text are one array of it, which is filtered and cut in its row: nothing is shuffled.
    """
    content = F.col("_t")

    def hits(n: int) -> Column:
        source, pattern, method, url = SCANS[n]
        groups = {"url": url} | ({"method": method} if method else {})
        found = F.coalesce(F.when(content.rlike(_GATES[n]), matches(content, pattern, **groups)), F.array())
        return F.transform(found, lambda m, i: record(
            ord=i + n * 1_000_000, source=F.lit(source), url=m["url"], named=m["method"] if method else F.lit(None).cast("string"), at=m["at"]))

    rows = once(scripts.select("script_id", F.coalesce(F.col(text), F.lit("")).alias("_t")), _m=F.concat(*map(hits, range(len(SCANS)))))
    good = F.filter("_m", lambda m: is_request_url(m["url"]) & (url_kind(m["url"]) == "api"))
    rows = rows.filter(F.size("_m") > 0).select("script_id", "_t", F.explode(F.slice(good, F.lit(1), F.lit(MOST))).alias("m"))
    rows = once(rows, window=around(content, F.col("m.at"), BEFORE, AFTER)).select("script_id", "m.ord", "m.source", "m.url", "m.named", "window")
    calls = once(rows, method=F.upper(F.coalesce("named", method_in(F.col("window")), F.lit("GET")))).drop("named").withColumn("kind", F.lit("api"))
    return calls.withColumn("confidence", url_confidence(F.col("url"), F.col("kind"), "medium", "low"))


def text_endpoints(scripts: DataFrame, text: str = "content") -> DataFrame:
    """Calls with headers, parameters and auth (the first signal); the first of each method, url and source stays."""
    calls = once(text_calls(scripts, text), headers=headers_in(F.col("window")))
    calls = once(calls, params=_named_params(calls))
    calls = once(calls, auth=F.get(auth_signals(F.col("headers"), F.col("url"), F.col("window")), F.lit(0))).drop("window")
    return first_wins(calls, ["script_id", "method", "url", "source"], "ord")


def _named_params(calls: DataFrame) -> Column:
    body = F.when(F.col("method") == "GET", "query").otherwise("body")

    def named(names: Column, location: Column, source: str) -> Column:
        return F.transform(names, lambda n: record(name=n, location=location, source=F.lit(source)))

    return F.concat(
        named(path_params(F.col("url")), F.lit("path"), "url"), named(query_params(F.col("url")), F.lit("query"), "url"),
        named(body_params_in(F.col("window")), body, "text-body"), named(F.col("headers"), F.lit("header"), "text-header"))


def text_params(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, api, name, location, source: parameters of the calls; the first of each location, api and name stays."""
    calls = once(text_calls(scripts, text), headers=headers_in(F.col("window")))
    found = _named_params(calls)
    rows = calls.select("script_id", "ord", F.col("url").alias("api"), F.posexplode(found).alias("pos", "p"))
    rows = rows.select("script_id", "ord", "pos", "api", "p.name", "p.location", "p.source")
    return first_wins(rows, ["script_id", "location", "api", "name"], ["ord", "pos"]).drop("ord", "pos")


def text_assets(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, url, type, source: script sources, then quoted file names; the first of each stays."""
    content = F.coalesce(F.col(text), F.lit(""))
    sources = F.regexp_extract_all(content, F.lit(SCRIPT_SOURCE), F.lit(2))
    quoted = F.regexp_extract_all(content, F.lit(QUOTED_FILE), F.lit(2))
    named = lambda urls, source: F.transform(urls, lambda u: record(url=u, source=F.lit(source)))
    found = F.filter(F.concat(named(sources, "text:script-src"), named(quoted, "text:quoted-asset")), lambda a: is_asset_url(a["url"]))
    rows = scripts.select("script_id", F.posexplode(F.slice(found, F.lit(1), F.lit(MOST))).alias("ord", "a"))
    rows = rows.select("script_id", "ord", "a.url", "a.source").withColumn("type", asset_type(F.col("url")))
    return first_wins(rows, ["script_id", "type", "url", "source"], "ord")


def text_base_urls(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, value, source: base urls that settings name; the first of each value stays."""
    found = matches(F.coalesce(F.col(text), F.lit("")), BASE_SETTING, offsets=False, name=1, value=3)
    rows = scripts.select("script_id", found.alias("_m")).select("script_id", F.posexplode("_m").alias("ord", "m"))
    rows = rows.select("script_id", "ord", normal_base(F.col("m.value")).alias("value"), F.concat(F.lit("text:"), "m.name").alias("source"))
    return first_wins(rows.filter(is_base_url(F.col("value"))), ["script_id", "value"], "ord")


__all__ = ["auth_signals", "body_params_in", "headers_in", "method_in", "text_assets", "text_base_urls", "text_calls", "text_endpoints", "text_params"]
