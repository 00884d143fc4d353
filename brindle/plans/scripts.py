"""Queries over scripts: sources, scans, calls, assets and urls, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import urls
from brindle.functions.text import line_count
from brindle.operators import bases, calls, chunks, scan, tokens
from brindle.plans import made_scripts as made
from brindle.plans.analyze import analyze
from brindle.sources import scripts as source


def script_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = made.table(spark, sf_dir, "pages").withColumnRenamed("html", "content")
    return source.with_script(pages).select("page_id", F.size("script_blocks").alias("n_blocks"), "script")


SCRIPT_BLOCKS = r"""
with b as (select page_id, html, list_filter(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1), lambda x: regexp_matches(x, '\S')) as l from pages)
select page_id, cast(len(l) as int) as n_blocks, case when len(l) > 0 then array_to_string(l, chr(10)) else html end as script from b
"""


def content_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.diagnostics(made.table(spark, sf_dir, "pages"), "html").drop("url", "html")


CONTENT_DIAGNOSTICS = r"""
with b as (select page_id, html, list_filter(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1), lambda x: regexp_matches(x, '\S')) as l from pages),
s as (select *, case when len(l) > 0 then array_to_string(l, chr(10)) else html end as t from b),
h as (select *, length(t) - length(ltrim(t, ' ' || chr(9) || chr(10) || chr(13))) as lead from s)
select page_id, cast(length(html) as int) as raw_length, cast(length(t) as int) as script_length, cast(len(l) as int) as block_count, len(l) > 0 as extracted,
  false as has_bom, cast(lead as int) as leading_space, cast(unicode(substr(t, lead + 1, 1)) as int) as first_code_point,
  case when regexp_matches(substr(t, lead + 1, 1), '[$_A-Za-z]') then 'identifier' when substr(t, lead + 1, 1) = '<' then 'html' else 'other' end as first_kind,
  starts_with(substr(t, lead + 1, 64), '<') as looks_like_html, regexp_matches(substr(t, lead + 1, 64), '^[\[{]') as looks_like_json,
  0 as nul_count, cast(length(html) - length(replace(html, chr(65533), '')) as int) as replacement_count from h
"""


def content_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return made.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text, 256).alias("sha256"), line_count(text).alias("n_lines"), F.char_length(text).alias("n_chars"))


CONTENT_SUMMARY = r"""
select doc_id, sha256(text) as sha256, cast(case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + 1 end as int) as n_lines,
  cast(length(text) as int) as n_chars from documents
"""


def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 4
    rows = made.table(spark, sf_dir, "pages").select(
        "page_id", F.when(n == 0, "not a url").when(n == 1, "").otherwise(F.col("url")).alias("url"), F.when(n.isin(1, 2), "  ").otherwise(F.col("html")).alias("content"))
    return source.requests(rows).select("page_id", "origin", "error")


REQUEST_CHECK = """
select page_id, case when page_id % 4 in (0, 3) then 'content' when page_id % 4 = 2 then 'url' end as origin,
  case when page_id % 4 = 0 then 'url must be a URL' when page_id % 4 = 1 then 'content or url is required' end as error from pages
"""


def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    url = (F.when(k == 0, F.concat(F.lit("/static/p"), "p_partkey")).when(k == 1, F.concat(F.lit("/api/p/"), "p_partkey")).when(k == 2, F.concat(F.lit("https://h.example/"), "p_name"))
           .when(k == 3, F.concat(F.lit("/x/"), "p_size", F.lit(".PNG?v=1"))).when(k == 4, F.lit("mailto:a@b.c")).when(k == 5, F.col("p_size").cast("string"))
           .when(k == 6, F.concat(F.lit("/js/"), "p_partkey", F.lit(".js"))).otherwise(F.concat(F.lit("//cdn.example/"), "p_partkey", F.lit(".js"))))
    rows = made.table(spark, sf_dir, "part").select("p_partkey", url.alias("url"))
    kind = urls.url_kind(F.col("url"))
    return rows.select("p_partkey", urls.is_request_url(F.col("url")).alias("is_request"), kind.alias("kind"), urls.url_confidence(F.col("url"), kind).alias("confidence"))


URL_CLASSIFY = """
select p_partkey, p_partkey % 8 not in (4, 5) as is_request, case when p_partkey % 8 in (0, 3, 6) then 'asset' else 'api' end as kind,
  case when p_partkey % 8 in (0, 3, 6, 4, 5) then 'low' when p_partkey % 8 = 2 then 'medium' else 'high' end as confidence from part
"""


def path_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("/o/${o.key}/:part/"), "o_orderkey", F.lit("?s="), "o_orderstatus", F.lit("&&p&c="), "o_custkey")
    rows = made.table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))
    one = rows.select("o_orderkey", F.lit("path").alias("location"), F.posexplode(urls.path_params(F.col("url"))).alias("pos", "name"))
    return one.unionByName(rows.select("o_orderkey", F.lit("query").alias("location"), F.posexplode(urls.query_params(F.col("url"))).alias("pos", "name")))


PATH_QUERY_PARAMS = """
select o_orderkey, v.location, cast(v.pos as int) as pos, v.name from orders,
  (values ('path', 0, 'o.key'), ('path', 1, 'part'), ('query', 0, 's'), ('query', 1, 'p'), ('query', 2, 'c')) v(location, pos, name)
"""


def text_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.text_endpoints(made.fetches(spark, sf_dir)).select("script_id", "source", "url", "method", "kind", "confidence", F.array_join("headers", ",").alias("headers"), "auth")


TEXT_ENDPOINTS = """
select cast(o_orderkey as varchar) as script_id, 'text:fetch' as source, '/api/orders/' || o_orderkey || '?status=' || o_orderstatus as url, 'POST' as method,
  'api' as kind, 'medium' as confidence, 'X-Token' as headers, 'X-Token' as auth from orders
"""


def text_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.text_params(made.fetches(spark, sf_dir)).select("script_id", "api", "name", "location", "source")


TEXT_PARAMS = """
select cast(o_orderkey as varchar) as script_id, '/api/orders/' || o_orderkey || '?status=' || o_orderstatus as api, v.name, v.location, v.source from orders,
  (values ('status', 'query', 'url'), ('total', 'body', 'text-body'), ('note', 'body', 'text-body'), ('X-Token', 'header', 'text-header')) v(name, location, source)
"""


def text_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.text_assets(made.loaders(spark, sf_dir)).select("script_id", "url", "type", "source")


TEXT_ASSETS = """
select cast(p_partkey as varchar) as script_id, '/lib/' || p_partkey || '.js' as url, 'script' as type, s.source from part, (values ('text:script-src'), ('text:quoted-asset')) s(source)
union all select cast(p_partkey as varchar), './' || p_size || '.css', 'style', 'text:quoted-asset' from part
union all select cast(p_partkey as varchar), '.js', 'script', 'text:quoted-asset' from part where false
"""


def text_base_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.text_base_urls(made.settings(spark, sf_dir)).select("script_id", "value", "source")


TEXT_BASE_URLS = "select cast(s_suppkey as varchar) as script_id, 'https://s' || s_suppkey || '.example/v1' as value, 'text:baseURL' as source from supplier"


def client_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.client_calls(made.clients(spark, sf_dir)).select("script_id", "source", "method", "url", "kind", "confidence")


CLIENT_CALLS = """
select cast(c_custkey as varchar) as script_id, 'axios.get' as source, 'GET' as method, '/api/customers/' || c_custkey as url, 'api' as kind, 'high' as confidence from customer
union all select cast(c_custkey as varchar), 'http.post', 'POST', '/api/v2/segments/' || c_mktsegment, 'api', 'high' from customer
union all select cast(c_custkey as varchar), '$.ajax', 'PUT', '/api/ajax/' || c_custkey, 'api', 'high' from customer
union all select cast(c_custkey as varchar), 'jQuery.get', 'GET', '/jq/${who}', 'api', 'high' from customer
"""


def _shapes_sql() -> str:
    lit = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {', '.join(lit(x) for x in shape)})" for i, shape in enumerate(made.SHAPES))
    key = lambda c: f"replace({c}, '{{k}}', cast(o_orderkey as varchar))"
    return (f"select cast(o_orderkey as varchar) as script_id, {key('content')} as content, source, method, {key('url')} as url, params, headers, signals from orders "
            f"join (values {rows}) s(i, content, source, method, url, params, headers, signals) on o_orderkey % {len(made.SHAPES)} = i")


def call_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls.client_calls(made.shapes(spark, sf_dir))
    names = F.array_join(F.array_sort(F.transform("params", lambda p: p["name"])), ",")
    return found.select("script_id", "source", "method", "url", names.alias("params"), F.array_join("headers", ",").alias("headers"), F.array_join("auth", ",").alias("signals"))


CALL_SHAPES = f"with c as ({_shapes_sql()}) select script_id, source, method, url, params, headers, signals from c where url is not null"


def call_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls.call_auth(calls.client_calls(made.shapes(spark, sf_dir)))
    return found.select("script_id", F.array_join("auth", ",").alias("signals"))


CALL_SIGNALS = f"with c as ({_shapes_sql()}) select script_id, signals from c where signals <> ''"


def call_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.call_params(calls.client_calls(made.clients(spark, sf_dir))).select("script_id", "api", "name", "location", "source")


CALL_PARAMS = """
select cast(c_custkey as varchar) as script_id, '/api/v2/segments/' || c_mktsegment as api, 'q' as name, 'body' as location, 'value' as source from customer
union all select cast(c_custkey as varchar), '/api/ajax/' || c_custkey, 'id', 'body', 'object' from customer
union all select cast(c_custkey as varchar), '/jq/${who}', 'who', 'path', 'url' from customer
"""


def analyze_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(made.shapes(spark, sf_dir).withColumn("url", F.lit(None).cast("string")))["endpoints"].select("script_id", "method", "url", "confidence", "evidence")


ANALYZE_ENDPOINTS = f"""
with c as ({_shapes_sql()})
select script_id, method, url, 'high' as confidence, case when contains(content, url) then content else method || ' ' || url end as evidence from c where url is not null
"""


def analyze_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(made.shapes(spark, sf_dir).withColumn("url", F.lit(None).cast("string")))["summary"]
    puts = F.coalesce(F.try_element_at("api_method_counts", F.lit("PUT")), F.lit(0).cast("long"))
    return found.select("script_id", "api_count", "resolved_api_count", "asset_count", "auth_count", puts.alias("put_count"))


ANALYZE_SUMMARY = f"""
with c as ({_shapes_sql()})
select script_id, cast(url is not null as bigint) as api_count, 0 as resolved_api_count, 0 as asset_count,
  case when coalesce(signals, '') = '' then 0 else len(string_split(signals, ',')) end as auth_count, cast(coalesce(method = 'PUT', false) as bigint) as put_count from c
"""


def token_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brackets of pages: level, partner and bracket around each."""
    signs = F.filter(F.split("html", ""), lambda c: c.isin(*"()[]{}"))
    rows = made.table(spark, sf_dir, "pages").select(F.col("page_id").alias("script_id"), F.posexplode(signs).alias("pos", "s"))
    return tokens.nested(rows).select(F.col("script_id").alias("page_id"), "pos", "s", "level", "mate")


TOKEN_NESTING = r"""
with c as (select page_id, regexp_extract_all(html, '[\[\](){}]') as l from pages),
t as (select page_id, unnest(range(len(l))) as pos, unnest(l) as s from c),
d as (select *, cast(sum(case when s in ('(', '[', '{') then 1 else -1 end) over (partition by page_id order by pos) as int) as after from t),
v as (select *, case when s in ('(', '[', '{') then after - 1 else after end as level from d),
m as (select *, case when s in ('(', '[', '{') then lead(pos) over w else lag(pos) over w end as other, case when s in ('(', '[', '{') then s || lead(s) over w else lag(s) over w || s end as pair
  from v window w as (partition by page_id, level order by pos))
select page_id, cast(pos as int) as pos, s, level, cast(case when pair in ('()', '[]', '{}') then other end as int) as mate from m
"""


def forwarder_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.client_calls(made.forwarders(spark, sf_dir)).select("script_id", "source", "method", "url", "confidence")


FORWARDER_CALLS = f"""
with recursive f as (select c_custkey, c_nationkey % {made.HOPS} as hops, i, case when i = 0 then 'axios' else 'f' || (i - 1) end as via from customer, range({made.HOPS}) r(i) where i <= c_nationkey % {made.HOPS}),
k as (select c_custkey, hops, i, 'f' || i as name from f where via = 'axios' union all select f.c_custkey, f.hops, f.i, 'f' || f.i from k join f on f.c_custkey = k.c_custkey and f.via = k.name)
select cast(c_custkey as varchar) as script_id, name as source, 'POST' as method, '/c/' || c_custkey as url, 'high' as confidence from k where i = hops
union all select cast(c_custkey as varchar), 'put', 'PUT', '/p/' || c_custkey, 'high' from customer
"""


def inlined_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.client_calls(made.helpers(spark, sf_dir)).select("script_id", "source", "method", "url")


INLINED_CALLS = f"""
with recursive p as (select o_orderkey, 0 as i, '/o/' || o_orderkey as made from orders union all select o_orderkey, i + 1, made || '/' || (i + 1) from p where i < o_orderkey % {made.HOPS})
select cast(o_orderkey as varchar) as script_id, 'fetch' as source, 'PUT' as method, made || '?s=${{state}}' as url from p where i = o_orderkey % {made.HOPS}
union all select cast(o_orderkey as varchar), 'axios', 'GET', '/o/all' from orders
"""


def base_url_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made.hosts(spark, sf_dir)
    facts = calls.script_facts(rows)
    found = bases.base_urls(facts, rows)
    return calls.with_base_url(calls.client_calls(rows), found).join(found.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_bases")), "script_id").select("script_id", "resolved_url", "base_url", "n_bases")


BASE_URL_SETS = """
with s as (select s_suppkey, s_nationkey, s_suppkey % 2 = 0 as own, s_suppkey % 2 <> 0 and s_suppkey % 3 <> 0 as unknown from supplier),
b as (select *, (case when own then 'http:' else 'https:' end) || (case when own or unknown then '//in' || s_nationkey || '.example' else '//out.example/v1' end) as base from s)
select cast(s_suppkey as varchar) as script_id, base || '/ping' as resolved_url, base as base_url, case when unknown then 2 else 1 end as n_bases from b
"""


def fetch_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.client_calls(made.fetches(spark, sf_dir)).select("script_id", "source", "method", "url", "confidence")


FETCH_CALLS = """
select cast(o_orderkey as varchar) as script_id, 'fetch' as source, 'POST' as method, '/api/orders/' || o_orderkey || '?status=' || o_orderstatus as url, 'high' as confidence from orders
"""


def xhr_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    opens = calls.headers_of_opens(calls.xhr_events(made.requests_by_hand(spark, sf_dir)), ["script_id", "object"])
    return opens.select("script_id", "object", "method", "url", F.array_join("headers", ",").alias("headers"))


XHR_CALLS = "select cast(s_suppkey as varchar) as script_id, 'x' as object, 'PUT' as method, '/s/' || s_suppkey as url, 'X-Token,Accept' as headers from supplier"


def xhr_headers_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of one request object for each user: purchases open it, the others set headers."""
    opened = F.col("event_type") == "purchase"
    rows = made.table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("ord"), F.when(opened, F.concat(F.lit("/p/"), "event_id")).alias("url"),
        F.when(~opened, F.concat("event_type", (F.col("event_id") % 3).cast("string"))).alias("header"))
    return calls.headers_of_opens(rows, ["user_id"]).select("user_id", "ord", "url", F.array_join(F.array_sort("headers"), ",").alias("headers"))


XHR_HEADERS_ASOF = """
with e as (select user_id, event_id as ord, case when event_type = 'purchase' then '/p/' || event_id end as url,
  case when event_type <> 'purchase' then event_type || event_id % 3 end as header from events),
g as (select *, count(url) over (partition by user_id order by ord) as g from e),
h as (select *, list(header) filter (where header is not null) over (partition by user_id order by g range between unbounded preceding and current row) as l from g)
select user_id, ord, url, coalesce(array_to_string(list_sort(list_distinct(l)), ','), '') as headers from h where url is not null
"""


def base_url_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = made.settings(spark, sf_dir)
    rows = calls.with_base_url(calls.client_calls(scripts), scan.text_base_urls(scripts))
    return rows.select("script_id", "url", "base_url", "resolved_url", "confidence", F.array_join("notes", ",").alias("notes"))


BASE_URL_ENRICH = """
select cast(s_suppkey as varchar) as script_id, '/ping/' || s_nationkey as url, 'https://s' || s_suppkey || '.example/v1' as base_url,
  'https://s' || s_suppkey || '.example/v1/ping/' || s_nationkey as resolved_url, 'high' as confidence, 'resolved-from-static-base-url' as notes from supplier
union all select cast(s_suppkey as varchar), 'https://other.example/x', null, null, 'medium', '' from supplier
"""


def chunk_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.chunk_assets(made.loaders(spark, sf_dir)).select("script_id", "url", "type", "chunk_name")


CHUNK_ASSETS = """
select cast(p_partkey as varchar) as script_id, 'assets/js/c' || p_partkey || '.h' || p_size || '.js' as url, 'script' as type, 'c' || p_partkey as chunk_name from part
union all select cast(p_partkey as varchar), 'assets/js/vendor.beef.js', 'script', 'vendor' from part
"""


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_files(calls.script_facts(made.loaders(spark, sf_dir))).select("script_id", "url", "type", "chunk_name", "source")


CHUNK_FILES = f"select *, 'webpack-runtime-return' as source from ({CHUNK_ASSETS})"


def auth_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    headers = F.when(k == 0, F.array(F.lit("Authorization"), F.lit("X-My-Token"))).otherwise(F.array().cast("array<string>"))
    text = F.when(k == 1, F.concat(F.lit("Bearer "), "c_name")).otherwise(F.col("c_name"))
    return made.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(scan.auth_signals(headers, text), ",").alias("signals"))


AUTH_SIGNALS = "select c_custkey, case c_custkey % 3 when 0 then 'Authorization,X-My-Token' when 1 then 'Bearer' else '' end as signals from customer"

QUERIES = {
    "script_blocks": (script_blocks, SCRIPT_BLOCKS), "content_diagnostics": (content_diagnostics, CONTENT_DIAGNOSTICS), "content_summary": (content_summary, CONTENT_SUMMARY),
    "request_check": (request_check, REQUEST_CHECK), "url_classify": (url_classify, URL_CLASSIFY), "path_query_params": (path_query_params, PATH_QUERY_PARAMS),
    "text_endpoints": (text_endpoints, TEXT_ENDPOINTS), "text_params": (text_params, TEXT_PARAMS), "text_assets": (text_assets, TEXT_ASSETS), "text_base_urls": (text_base_urls, TEXT_BASE_URLS),
    "client_calls": (client_calls, CLIENT_CALLS), "fetch_calls": (fetch_calls, FETCH_CALLS), "xhr_calls": (xhr_calls, XHR_CALLS), "xhr_headers_asof": (xhr_headers_asof, XHR_HEADERS_ASOF),
    "token_nesting": (token_nesting, TOKEN_NESTING), "forwarder_calls": (forwarder_calls, FORWARDER_CALLS), "inlined_calls": (inlined_calls, INLINED_CALLS), "base_url_sets": (base_url_sets, BASE_URL_SETS),
    "call_shapes": (call_shapes, CALL_SHAPES), "call_signals": (call_signals, CALL_SIGNALS), "call_params": (call_params, CALL_PARAMS),
    "analyze_endpoints": (analyze_endpoints, ANALYZE_ENDPOINTS), "analyze_summary": (analyze_summary, ANALYZE_SUMMARY), "base_url_enrich": (base_url_enrich, BASE_URL_ENRICH), "chunk_assets": (chunk_assets, CHUNK_ASSETS), "chunk_files": (chunk_files, CHUNK_FILES), "auth_signals": (auth_signals, AUTH_SIGNALS),
}
