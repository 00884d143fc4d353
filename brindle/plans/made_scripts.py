"""Scripts spelled from table rows, so that what is found in them follows from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.order import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch with a method, a header and a body for each order."""
    content = F.concat(F.lit("fetch('/api/orders/"), "o_orderkey", F.lit("?status="), "o_orderstatus", F.lit(
        "', {method: 'POST', headers: {'X-Token': t}, body: {total: 1, note: n}});"))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("script_id"), content.alias("content"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant, an alias of a client, and calls through both, for each customer."""
    content = F.concat(F.lit("const B = '/api';\nconst C = B + '/v2';\nconst http = axios.create({});\naxios.get(B + '/customers/"), "c_custkey", F.lit(
        "');\nhttp.post(C + '/segments/"), "c_mktsegment", F.lit("', q);\n$.ajax({url: B + '/ajax/"), "c_custkey", F.lit("', type: 'put', data: {id: 1}});\njQuery.get('/jq/' + who);"))
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(F.col("c_custkey").cast("string").alias("script_id"), content.alias("content"))


#: Scripts of many shapes, with ``{k}`` for a key, and what is called in each: source, method, url, names of parameters, headers, signals.
SHAPES = (
    ("fetch('/a/{k}', {\n  method: 'POST',\n  headers: {'X-Token': t, Accept: 'x'},\n  body: {id: {n: 1}, note}\n});", "fetch", "POST", "/a/{k}", "Accept,X-Token,id,note", "X-Token,Accept", "X-Token,x-token,token"),
    ("const B = '/v2';\n$.ajax({data: {uid: 1}, url: B + '/b/{k}', type: 'put'});", "$.ajax", "PUT", "/v2/b/{k}", "uid", "", ""),
    ("const API: string = import.meta.env.API || '/api';\naxios.post(API + '/c/{k}', {role: r, uid}, {headers: {Authorization: 'x'}});", "axios.post", "POST", "/api/c/{k}", "Authorization,role,uid", "Authorization", "Authorization,authorization"),
    ("const P = '/p';\nconst svc = axios.create({});\nconst id = '7';\nsvc.get(`${P}/d/{k}/${id}?v=${x}`, {params: {verbose: true}});", "svc.get", "GET", "/p/d/{k}/7?v=${x}", "v,verbose,x,x", "", ""),
    ("axios({headers: {A: 1}, url: '/e/{k}', data: JSON.stringify({a: 1}), method: 'delete'});", "axios", "DELETE", "/e/{k}", "A,JSON.stringify()", "A", ""),
    ("// fetch('/no/{k}')\n/* axios.get('/no2') */ fetch(\"/f/{k}?p=1&q=2\");", "fetch", "GET", "/f/{k}?p=1&q=2", "p,q", "", ""),
    ("let r = new XMLHttpRequest();\nr.open('PATCH', '/g/{k}/:part');\nr.setRequestHeader('Authorization', a);", "r.open", "PATCH", "/g/{k}/:part", "part", "Authorization", "Authorization,authorization"),
    ("$.ajax({url: \"/h/{k}\", data: '{\"seat\":\"' + $(\"#s\").val() + '\",\"row\":\"' + z + '\"}', type: \"post\"});", "$.ajax", "POST", "/h/{k}", "row,seat", "", ""),
    ("const h = axios;\nconst g = h;\ng.put('/i/{k}', payload);", "g.put", "PUT", "/i/{k}", "payload", "", ""),
    ("cache.get('/z/{k}'); fetch(cond ? '/y/{k}' : '/w'); h.open('GET', '/v');", None, None, None, None, None, None),
)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of some shape for each order."""
    shape = F.element_at(F.array(*(F.lit(s[0]) for s in SHAPES)), (F.col("o_orderkey") % len(SHAPES) + 1).cast("int"))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("script_id"), F.replace(shape, F.lit("{k}"), F.col("o_orderkey").cast("string")).alias("content"))


#: Functions of a chain at most.
HOPS = 6


def _chain(parts: list, key: Column) -> Column:
    """The first ``key`` of ``parts``, joined."""
    return F.array_join(F.slice(F.array(*parts), F.lit(1), key), "\n")


def forwarders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of functions that forward to a client, as long as the customer's nation says, one that forwards to nobody, and calls of both."""
    hops = F.col("c_nationkey") % HOPS
    links = [F.lit(f"const f{i} = (c) => {'axios' if i == 0 else f'f{i - 1}'}(c);") for i in range(HOPS)]
    content = F.concat(
        F.lit("function g(c) { return other(c); }\nf"), hops, F.lit("({ url: '/c/"), "c_custkey", F.lit("', method: 'post', data: { segment: '"), "c_mktsegment", F.lit("' } });\ng({ url: '/g/"), "c_custkey", F.lit("' });\n"),
        _chain(links, hops + 1), F.lit("\nconst put = (u, b) => axios.put(u, b);\nput('/p/"), "c_custkey", F.lit("', { k: 1 });"))
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey").select(F.col("c_custkey").cast("string").alias("script_id"), content.alias("content"))


def helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that build a url out of each other's results, as many as the line count of an order's key says, and a call with the last."""
    hops = F.col("o_orderkey") % HOPS
    links = [F.lit("function p0(x) { return '/o/' + x; }")] + [F.lit(f"function p{i}(y) {{ return p{i - 1}(y) + '/{i}'; }}") for i in range(1, HOPS)]
    content = F.concat(_chain(links, (hops + 1).cast("int")), F.lit("\nfetch(p"), hops, F.lit("('"), "o_orderkey", F.lit("') + '?s=' + state, { method: 'PUT' });\nconst all = { url: p0('all'), method: 'get' };\naxios(all);"))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("script_id"), content.alias("content"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base url that depends on the script's own host, which half of the suppliers have."""
    content = F.concat(F.lit("var how = location.protocol;\nuse({ baseUrl: how + ('h"), "s_suppkey", F.lit(".example' === window.location.host ? '//in"), "s_nationkey", F.lit(".example' : '//out.example/v1/') });\nfetch('/ping');"))
    url = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("http://h"), "s_suppkey", F.lit(".example/a.js"))).when(F.col("s_suppkey") % 3 == 0, F.lit("https://else.example/a.js"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("script_id"), url.alias("url"), content.alias("content"))


def requests_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request object with a header before and one after its opening, for each supplier."""
    content = F.concat(F.lit("var x = new XMLHttpRequest();\nx.setRequestHeader('X-Token', t);\nx.open('PUT', '/s/"), "s_suppkey", F.lit(
        "');\nx.setRequestHeader('Accept', 'n"), "s_nationkey", F.lit("');"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("script_id"), content.alias("content"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base url and two calls for each supplier."""
    content = F.concat(F.lit("cfg = {baseURL: 'https://s"), "s_suppkey", F.lit(".example/v1/'};\nfetch('/ping/"), "s_nationkey", F.lit("');\nfetch('https://other.example/x');"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("script_id"), content.alias("content"))


def loaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk loader and a script element for each part."""
    content = F.concat(F.lit('function u(e) { return p + "assets/js/" + e + "." + {"c'), "p_partkey", F.lit('": "h'), "p_size", F.lit(
        '", "vendor": "beef"}[e] + ".js" }\n<script src="/lib/'), "p_partkey", F.lit('.js"></script> import("./'), "p_size", F.lit('.css");'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("script_id"), content.alias("content"))


def found_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings spelled from line items: one script for each supplier."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_suppkey").cast("string").alias("script_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("c"), "l_returnflag").alias("category"), F.concat(F.lit("t"), "l_linestatus").alias("type"),
        F.concat(F.lit("v"), F.lpad((F.col("l_partkey") % 700).cast("string"), 4, "0")).alias("value"),
        F.when(F.col("l_linenumber") == 1, "high").when(F.col("l_linenumber") < 4, "medium").otherwise("low").alias("severity"),
        F.when(F.col("l_quantity") > 25, 0.75).otherwise(0.5).alias("confidence"),
        F.when(F.col("l_discount") > 0.05, "string").otherwise("api").alias("source"), F.concat(F.lit("e  "), (F.col("l_linenumber") % 3).cast("string")).alias("evidence"))


__all__ = ["HOPS", "clients", "fetches", "forwarders", "found_rows", "helpers", "hosts", "loaders", "requests_by_hand", "settings", "shapes", "table"]
