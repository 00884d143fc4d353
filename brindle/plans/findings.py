"""Queries over rules, findings, secrets, reviews and results, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import redacted
from brindle.operators import calls, order, output, rules, secrets
from brindle.plans import made_scripts as made


def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    url = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("/admin/", "/internal?x=", "/api/deleteUser", "/v1/export", "/x/debug", "/plain/"))), (k + 1).cast("int")), "o_orderkey")
    apis = made.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("script_id"), F.lit(0).alias("ord"), url.alias("url"))
    return rules.risks(apis).select("script_id", "type", "severity", "evidence")


RISK_RULES = """
with u as (select o_orderkey, ['/admin/', '/internal?x=', '/api/deleteUser', '/v1/export', '/x/debug', '/plain/'][o_orderkey % 6 + 1] || o_orderkey as url from orders)
select cast(o_orderkey as varchar) as script_id, r.type, 'medium' as severity, url as evidence from u, (values
  ('admin-api', '(?i)/(admin|manage|system|console)(/|$|\\?)'), ('internal-api', '(?i)/(internal|private|actuator)(/|$|\\?)'), ('debug-endpoint', '(?i)/(debug|__debug|devtools)(/|$|\\?)'),
  ('destructive-api', '(?i)/(delete|remove|destroy|drop|truncate)([A-Z/?_-]|$)'), ('export-api', '(?i)/(export|download)([A-Z/?_-]|$)')) r(type, p)
where regexp_matches(url, replace(r.p, '\\\\', '\\'))
"""


#: Values that a rule takes, and some that none takes; the key of the row follows.
VALUES = ("AKIA1234567890ABCDE", "Bearer abcdefghijkl", "/api/v1/", "https://x.test.example/", "roles of ", "oss-cn.aliyuncs.com/", "b.s3-eu.amazonaws.com/", "cos.ap.myqcloud.com/",
          "wx0123456789abcdef", "tencentcloud ", "app.js.map", "webpackHotUpdate", "http://10.0.0.", "192.168.1.", "client_id=", "query Q { ", "/graphql", "/admin/", "plain ", "")


def finding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.element_at(F.array(*map(F.lit, VALUES)), (F.col("o_orderkey") % len(VALUES) + 1).cast("int")), F.col("o_orderkey").cast("string"))
    rows = made.table(spark, sf_dir, "orders").select("o_orderkey", F.lit("").alias("name"), value.alias("value"))
    return rules.matched_rules(rows).select("o_orderkey", "rule", "category", "type", "severity", "confidence", "value")


def _rules_sql() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({i}, {lit(c)}, {lit(t)}, {lit(s)}, {f}, {lit(v.replace(chr(92) + 'z', '$'))})" for i, (c, t, s, f, v, _) in enumerate(rules.FINDING_RULES) if v]
    values = "[" + ", ".join(map(lit, VALUES)) + "]"
    return (f"with v as (select o_orderkey, {values}[o_orderkey % {len(VALUES)} + 1] || o_orderkey as value from orders) "
            "select o_orderkey, r.rule, r.category, r.type, r.severity, cast(r.confidence as double) as confidence, value from v, (values " + ", ".join(rows)
            + ") r(rule, category, type, severity, confidence, p) where regexp_matches(value, r.p)")


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    name = F.element_at(F.array(*(F.lit(x) for x in ("accessToken", "userPwd", "ossBucket", "redirectUrl", "title"))), (k + 1).cast("int"))
    value = F.when(F.col("c_custkey") % 7 == 0, "changeme").otherwise(F.col("c_name"))
    rows = made.table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), value.alias("value"))
    return rules.matched_rules(rows).select("c_custkey", "type", "value")


NAME_RULES = """
select c_custkey, r.type, c_name as value from customer, (values (0, 'token'), (1, 'password'), (2, 'aliyun-oss'), (2, 'aws-s3'), (3, 'dynamic-request-target')) r(k, type)
where c_custkey % 5 = r.k and c_custkey % 7 <> 0
"""


def finding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rules.ranked_findings(made.found_rows(spark, sf_dir), per_type=20, per_category=30, total=50)
    return ranked.select("script_id", "ord", "category", "type", "value", "severity", "confidence", "source")


_FOUND_SQL = """
f as (select cast(l_suppkey as varchar) as script_id, l_orderkey * 8 + l_linenumber as ord, 'c' || l_returnflag as category, 't' || l_linestatus as type,
  'v' || lpad(cast(l_partkey % 700 as varchar), 4, '0') as value, case when l_linenumber = 1 then 'high' when l_linenumber < 4 then 'medium' else 'low' end as severity,
  case when l_quantity > 25 then 0.75 else 0.5 end as confidence, case when l_discount > 0.05 then 'string' else 'api' end as source, 'e ' || l_linenumber % 3 as evidence from lineitem)
"""
FINDING_TOPK = "with" + _FOUND_SQL + """,
d as (select *, case severity when 'high' then 3 when 'medium' then 2 else 1 end as s, case source when 'api' then 5 else 1 end as p from f
  qualify row_number() over (partition by script_id, category, type, source, value, case when source = 'string' then '' else evidence end order by ord) = 1),
a as (select * from d qualify row_number() over (partition by script_id, category, type order by s desc, confidence desc, p, value, ord) <= 20),
b as (select * from a qualify row_number() over (partition by script_id, category order by s desc, confidence desc, p, value, ord) <= 30),
c as (select * from b qualify row_number() over (partition by script_id order by s desc, confidence desc, p, value, ord) <= 50)
select script_id, ord, category, type, value, severity, cast(confidence as double) as confidence, source from c
"""


def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made.table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.snippet(F.col("text"), F.lit("en")).alias("evidence"))


EVIDENCE_SNIPPETS = """
with p as (select doc_id, text, instr(text, 'en') - 1 as pos, length(text) as n from documents),
q as (select *, greatest(pos - 220, 0) as a, least(pos + 222, n) as b from p)
select doc_id, case when pos >= 0 then case when a > 0 then '...' else '' end || substr(text, a + 1, b - a) || case when b < n then '...' else '' end end as evidence from q
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("script_id"), F.col("text").alias("content"))


def secret_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_candidates(_texts(spark, sf_dir))
    return found.groupBy("script_id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"), F.max("id").alias("id"))


def _secrets_sql() -> str:
    one = lambda kind, pattern: (f"select cast(doc_id as varchar) as script_id, '{kind}' as type, unnest(regexp_extract_all(text, '" + pattern.replace("'", "''") + "', 1)) as v from documents")
    return "with m as (" + " union all ".join(one(k, p) for k, _, p in secrets.SECRET_RULES) + ") select script_id, type, count(*) as n, max(v) as value, max(sha256(v)) as id from m group by all"


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_candidates(_texts(spark, sf_dir), reach=20).filter("type = 'token'")
    first = order.first_wins(found, ["script_id"], "at")
    return first.select("script_id", "line", F.char_length("context").alias("context_chars"))


SECRET_LINES = r"""
with t as (select doc_id, text, '(?i)(?s)^(.*?)\b(?:token|secret|passwd|password|api[_-]?key)\s*[=:]\s*["'']([^"''\r\n]{8,200})["'']' as p from documents),
p as (select doc_id, length(text) as n, regexp_extract(text, p, 1) as head, length(regexp_extract(text, p, 2)) as v from t where regexp_matches(text, p)),
q as (select *, greatest(length(head) - 20, 0) as a, least(length(head) + v + 20, n) as b from p)
select cast(doc_id as varchar) as script_id, cast(length(head) - length(replace(head, chr(10), '')) + 1 as int) as line,
  cast(b - a + case when a > 0 then 3 else 0 end + case when b < n then 3 else 0 end as int) as context_chars from q
"""


def hidden_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.table(spark, sf_dir, "documents").select("doc_id", secrets.hidden_text(F.col("text")).alias("shown"))


def _hidden_sql() -> str:
    text = "text"
    for pattern, shown in secrets.HIDDEN:
        text = f"regexp_replace({text}, '" + pattern.replace("'", "''") + "', '" + shown.replace("$", chr(92)) + "', 'g')"
    return f"with t as (select doc_id, {text} as t from documents) select doc_id, case when length(t) > 12000 then substr(t, 1, 12000) || '... [truncated ' || (length(t) - 12000) || ' chars]' else t end as shown from t"


def redacted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.table(spark, sf_dir, "conversations").select("conv_id", "turn", redacted(F.col("text")).alias("shown"))


REDACTED_TURNS = "select conv_id, turn, case when length(text) > 16 then substr(text, 1, 8) || '...' || right(text, 4) else text end as shown from conversations"


def enclosing_function_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of one script for each user: purchases define a function, errors are candidates."""
    rows = made.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("script_id"), F.floor(F.col("event_id") / 20).cast("long").alias("line"), "event_id", "event_type")
    lines = rows.filter("event_type = 'purchase'").groupBy("script_id", "line").agg(F.concat(F.lit("f"), F.max("event_id")).alias("name"))
    candidates = rows.filter("event_type = 'error'").select("script_id", "line", "event_id")
    return secrets.enclosing_function(candidates, lines, 40)


ENCLOSING_FUNCTION_ASOF = """
with e as (select cast(user_id as varchar) as script_id, event_id // 20 as line, event_id, event_type from events),
l as (select script_id, line, 'f' || max(event_id) as name from e where event_type = 'purchase' group by all)
select c.script_id, c.line, c.event_id, max_by(l.name, l.line) as function from e c left join l on l.script_id = c.script_id and l.line between c.line - 39 and c.line
where c.event_type = 'error' group by all
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("type"), F.lit("medium").alias("severity"), F.col("source").alias("value"))


def review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = made.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("is_secret"), F.when(F.col("toxic") == 1, "bearer").otherwise("").alias("secret_type"),
        F.when(F.col("toxic") == 1, "high").alias("severity"), (F.col("quality") * 1.5).alias("confidence"))
    return secrets.reviewed_secrets(_candidates(spark, sf_dir), reviews).select("doc_id", "type", "severity", "value", "confidence", "source")


REVIEW_JOIN = """
select d.doc_id, case when toxic = 1 then 'bearer' else lang end as type, case when toxic = 1 then 'high' else 'medium' end as severity, d.source as value,
  cast(1.0 as double) as confidence, 'llm+regex' as source from documents d join labels l using (doc_id) where quality = 1
"""


def review_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, passed = secrets.allowed(_candidates(spark, sf_dir), "type", ["en", "de"])
    both = taken.withColumn("path", F.lit("review")).unionByName(passed.withColumn("path", F.lit("pass")))
    return both.select("doc_id", "path")


REVIEW_ALLOWLIST = "select doc_id, case when coalesce(lang in ('en', 'de'), false) then 'review' else 'pass' end as path from documents"


def review_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    rows = order.batches(rows, ["user_id"], ["event_id"], 5).withColumn("failed", (F.col("event_type") == "error") & (F.col("event_id") % 7 == 0))
    return secrets.settled_batches(rows, ["user_id"]).select("user_id", "event_id", "batch", "outcome")


REVIEW_FAILURE = """
with b as (select *, (row_number() over (partition by user_id order by event_id) - 1) // 5 as batch from events),
f as (select user_id, min(batch) as first from b where event_type = 'error' and event_id % 7 = 0 group by 1)
select user_id, event_id, cast(batch as int) as batch, case when batch >= first then 'kept' else 'reviewed' end as outcome from b left join f using (user_id)
"""


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    apis = made.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("script_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("/api/"), "o_orderkey").alias("url"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://h.example/api/"), "o_orderkey")).alias("resolved_url"),
        F.when(F.col("o_orderstatus") == "F", "POST").alias("method"), F.lit("fetch").alias("source"), F.lit("api").alias("kind"), F.lit("high").alias("confidence"))
    return apis, apis.select("script_id", "ord", F.lit("low").alias("severity"))


def endpoint_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint findings for some apis, two of them for others, and findings of other types that don't count."""
    apis, _ = _results(spark, sf_dir)
    k = F.col("ord")
    shown = F.coalesce("resolved_url", "url")
    one = lambda rows, kind, value, evidence, pos: rows.select("script_id", F.lit("api").alias("source"), F.lit(kind).alias("type"), value.alias("value"), evidence.alias("evidence"), (k * 10 + pos).alias("ord"))
    found = one(apis.filter(k % 3 == 0), "api-endpoint", shown, F.concat(F.lit("E"), k), 0).unionByName(one(apis, "role-admin-auth", F.col("url"), F.lit("no"), 9))
    found = found.unionByName(one(apis.filter(k % 6 == 0), "api-endpoint", shown, F.lit("late"), 1)).unionByName(one(apis.filter(k % 5 == 0), "api-endpoint", F.col("url"), F.lit("U"), 2))
    return output.endpoints(apis, found).select("script_id", "url", "method", "evidence")


ENDPOINT_EVIDENCE = """
with a as (select cast(o_custkey as varchar) as script_id, o_orderkey as k, '/api/' || o_orderkey as url, case when o_orderstatus = 'F' then 'POST' end as method from orders)
select script_id, url, method, case when k % 6 = 0 then 'late' when k % 5 = 0 then 'U' when k % 3 = 0 then 'E' || k
  else coalesce(method, 'GET') || ' ' || case when k % 2 = 0 then 'https://h.example' else '' end || url end as evidence from a
"""


def leak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of line items, some of them endpoints or secrets already."""
    found = made.found_rows(spark, sf_dir)
    n = F.substring("value", 2, 4).cast("int") % 3
    found = found.withColumns({
        "category": F.when(F.col("category") == "cA", "API 信息").when(F.col("category") == "cN", "敏感凭据").otherwise("GraphQL"),
        "type": F.when(F.col("type") == "tO", "api-endpoint").otherwise(F.col("type")), "value": F.concat(F.when(n == 0, "https://x/").when(n == 1, "/dev/").otherwise("/plain/"), "value"),
        "source": F.when(F.col("source") == "string", "secret").when(F.col("ord") % 2 == 0, "api").otherwise("identifier")})
    own = made.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("script_id"))
    held = own.select("script_id", F.lit(0).cast("long").alias("ord"), F.lit("tF").alias("type"), F.lit("/plain/v0008").alias("value"), F.lit("high").alias("severity"),
                      F.lit(0.75).alias("confidence"), F.lit("regex").alias("source"), F.lit("e  1").alias("evidence"))
    apis = own.select("script_id", F.explode(F.array(F.lit("https://x/v0003"), F.lit("/dev/v0001"))).alias("url"), F.lit(None).cast("string").alias("resolved_url"))
    return output.leaks(held, found, apis).select("script_id", "ord", "category", "type", "value", "source", "evidence")


LEAK_ROWS = "with" + _FOUND_SQL.replace("'e ' ||", "'e  ' ||") + """,
g as (select script_id, ord, case category when 'cA' then 'API 信息' when 'cN' then '敏感凭据' else 'GraphQL' end as category, case type when 'tO' then 'api-endpoint' else type end as type,
  ['https://x/', '/dev/', '/plain/'][cast(substr(value, 2) as int) % 3 + 1] || value as value, case when source = 'string' then 'secret' when ord % 2 = 0 then 'api' else 'identifier' end as source, evidence from f),
s as (select cast(s_suppkey as varchar) as script_id, 0 as ord, '敏感凭据' as category, 'tF' as type, '/plain/v0008' as value, 'regex' as source, 'e  1' as evidence from supplier),
r as (select 0 as branch, * from s union all select 1, * from g where category <> 'GraphQL'
  and (category <> 'API 信息' or (type <> 'api-endpoint' and source <> 'api' and value not in ('https://x/v0003', '/dev/v0001') and not starts_with(value, '/plain/')))
  and not (source = 'secret' and category = '敏感凭据' and type = 'tF' and value = '/plain/v0008' and evidence = 'e  1'))
select script_id, ord, category, type, value, source, evidence from r
qualify row_number() over (partition by script_id, category, type, value, evidence order by branch, ord) = 1
"""


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of line items; one api, one file and one secret for each supplier."""
    found = made.found_rows(spark, sf_dir).withColumns({
        "category": F.when(F.col("category") == "cA", "API 信息").when(F.col("category") == "cN", "敏感凭据").otherwise("路由信息"),
        "source": F.when(F.col("source") == "string", "secret").when(F.col("type") == "tF", "asset").otherwise("identifier")})
    own = made.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("script_id"), F.lit("api").alias("kind"), F.lit("tF").alias("type"), F.lit("v0007").alias("value"))
    return output.group_counts(found, own, own, own)


GROUP_COUNTS = "with" + _FOUND_SQL + """,
g as (select script_id, category = 'cA' as e, source = 'api' and type = 'tF' as s, source = 'string' as secret, category = 'cN' as guarded, source = 'string' and type = 'tF' and value = 'v0007' as sure from f),
r as (select script_id, 'endpoints' as section from g where e union all select script_id, 'scripts' from g where s
  union all select script_id, 'exposures' from g where not e and not s and (sure or (not secret and not guarded))
  union all select cast(s_suppkey as varchar), x from supplier, (values ('endpoints'), ('scripts'), ('exposures')) v(x))
select script_id, section, count(*) as n from r group by all
"""


def api_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apis of orders, in a text that has the url of every other one."""
    k = F.col("o_orderkey")
    url = F.concat(F.lit("/api/"), k)
    rows = made.table(spark, sf_dir, "orders").select(k.cast("string").alias("script_id"), k.alias("ord"), url.alias("url"), F.when(k % 2 == 0, F.concat(F.lit("call "), url, F.lit(" now"))).otherwise("").alias("content"))
    one = F.struct(F.lit("token").alias("name"), F.lit("body").alias("location"), F.lit("object").alias("source"))
    apis = rows.select("script_id", "ord", "url", F.lit(None).cast("string").alias("resolved_url"), F.lit("PUT").alias("method"), F.lit("high").alias("confidence"), F.array(one).alias("params"), F.array(F.lit("X-Role")).alias("headers"))
    return rules.api_findings(rules.with_api_evidence(apis, rows)).select("script_id", "category", "type", "value", "severity", "confidence", "source", "evidence")


API_FINDINGS = """
with a as (select cast(o_orderkey as varchar) as script_id, o_orderkey as k, '/api/' || o_orderkey as url from orders)
select script_id, v.category, v.type, case v.value when '' then url else v.value end as value, v.severity, cast(v.confidence as double) as confidence, 'api' as source,
  case v.type when 'api-endpoint' then case when k % 2 = 0 then 'call ' || url || ' now' else 'PUT ' || url end when 'gateway-or-api-base' then url else url || ':' || v.value end as evidence
from a, (values ('API 信息', 'api-endpoint', '', 'medium', 0.9), ('API 信息', 'gateway-or-api-base', '', 'medium', 0.7), ('敏感凭据', 'token', 'token', 'high', 0.75),
  ('权限信息', 'role-admin-auth', 'X-Role', 'medium', 0.7)) v(category, type, value, severity, confidence)
"""


def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name, a call of a client and a request to a target that a name gives, for each customer."""
    content = F.concat(F.lit("const apiToken = 's3cr3tvalue';\nuseQuery(q);\nfetch(redirectUrl + '/x'); // "), "c_custkey")
    rows = order.dealt(made.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").cast("string").alias("script_id"), content.alias("content"))
    return rules.text_findings(rows).select("script_id", "category", "type", "value", "severity", "source", "evidence")


TEXT_FINDINGS = """
with t as (select cast(c_custkey as varchar) as script_id, 'const apiToken = ''s3cr3tvalue'';' || chr(10) || 'useQuery(q);' || chr(10) || 'fetch(redirectUrl + ''/x''); // ' || c_custkey as c from customer)
select script_id, v.category, v.type, v.value, v.severity, v.source, coalesce(v.evidence, c) as evidence from t, (values ('敏感凭据', 'token', 's3cr3tvalue', 'high', 'identifier', null),
  ('GraphQL', 'graphql-client-call', 'useQuery', 'medium', 'call', 'call:useQuery'), ('路由信息', 'dynamic-request-target', null, 'medium', 'call', null)) v(category, type, value, severity, source, evidence)
"""


def asset_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = made.table(spark, sf_dir, "part")
    assets = parts.select(F.col("p_partkey").cast("string").alias("script_id"), F.lit(0).alias("ord"), F.concat(F.lit("/a/"), "p_partkey", F.lit(".js.map")).alias("url"), F.lit("c").alias("chunk_name"), F.lit("chunk").alias("source"))
    return rules.asset_findings(assets).select("script_id", "category", "type", "value", "severity", "confidence", "source", "evidence")


ASSET_FINDINGS = """
select cast(p_partkey as varchar) as script_id, v.category, v.type, '/a/' || p_partkey || '.js.map' as value, v.severity, cast(v.confidence as double) as confidence, 'asset' as source,
  coalesce(v.evidence, '/a/' || p_partkey || '.js.map') as evidence from part,
  (values ('webpack模块', 'hidden-asset', 'low', 0.85, 'chunk'), ('调试信息', 'source-map', 'medium', 0.8, null)) v(category, type, severity, confidence, evidence)
"""


def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    apis, _ = _results(spark, sf_dir)
    per = output.counts_by(apis, "method")
    return per.select("script_id", F.coalesce(F.element_at("counts", "POST"), F.lit(0)).alias("n_post"), F.coalesce(F.element_at("counts", "UNKNOWN"), F.lit(0)).alias("n_unknown"))


METHOD_COUNTS = """
select cast(o_custkey as varchar) as script_id, count(*) filter (where o_orderstatus = 'F') as n_post, count(*) filter (where o_orderstatus <> 'F') as n_unknown from orders group by 1
"""


def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    apis, findings = _results(spark, sf_dir)
    scripts = made.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("script_id"))
    found = findings.withColumn("severity", F.when(F.col("ord") % 5 == 0, "high").otherwise("low"))
    return output.summary(scripts, apis, found, apis.filter("ord % 4 = 0"))


ANALYSIS_SUMMARY = """
select cast(c_custkey as varchar) as script_id, count(o_orderkey) as endpoint_count, count(o_orderkey) filter (where o_orderkey % 2 = 0) as resolved_count, count(o_orderkey) as leak_count,
  count(o_orderkey) filter (where o_orderkey % 5 = 0) as high_count, count(o_orderkey) filter (where o_orderkey % 4 = 0) as js_file_count
from customer left join orders on o_custkey = c_custkey group by c_custkey
"""


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file, a hidden one found twice, a rule's finding about a file, and a finding that is about none."""
    parts = made.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string").alias("script_id")
    assets = parts.select(key, F.lit(0).alias("ord"), F.concat(F.lit("/a/"), "p_size", F.lit(".js")).alias("url"), F.lit("script").alias("type"), F.lit(None).cast("string").alias("chunk_name"), F.lit("chunk").alias("source"))
    one = lambda kind, category, value, source: parts.select(
        key, F.lit(1).alias("ord"), F.lit(kind).alias("type"), F.lit(category).alias("category"), value.alias("value"), F.lit(source).alias("source"), F.lit(0.5).alias("confidence"), F.lit("e").alias("evidence"))
    hidden = one("hidden-asset", "webpack模块", F.concat(F.lit("/b/m-"), "p_size", F.lit("-abcdef1.0123abcd.css")), "asset")
    found = hidden.unionByName(hidden).unionByName(one("gateway-or-api-base", "API 信息", F.lit("/api/x.js"), "asset")).unionByName(one("source-map", "调试信息", F.lit("/y.js.map"), "string"))
    return output.js_files(assets, found).select("script_id", "url", "type", "chunk_name", "source", "confidence", "evidence")


FILE_ROWS = """
select cast(p_partkey as varchar) as script_id, '/a/' || p_size || '.js' as url, 'script' as type, null as chunk_name, 'chunk' as source, cast(0.85 as double) as confidence, null as evidence from part
union all select cast(p_partkey as varchar), '/b/m-' || p_size || '-abcdef1.0123abcd.css', 'style', 'm-' || p_size || '-abcdef1', 'webpack-runtime', 0.5, 'e' from part
union all select cast(p_partkey as varchar), '/api/x.js', 'asset', null, 'webpack-runtime', 0.5, 'e' from part
"""

def function_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of made-up scripts with the function around them, the apis and the headers near them."""
    content = F.concat(F.lit("function login"), "c_custkey", F.lit("(a) {\r\n  fetch('/api/in/"), "c_custkey", F.lit("');\n}\nconst go = async (x) => {\n  send('Bearer abcdefghijklmnop"), "c_custkey", F.lit("');\n}"))
    rows = order.dealt(made.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").cast("string").alias("script_id"), content.alias("content"))
    found = secrets.nearby_apis(secrets.secret_candidates(rows), calls.client_calls(rows))
    found = found.select("script_id", "type", "value", "line", F.array_join("nearby", ",").alias("nearby"), F.array_join("headers", ",").alias("headers"))
    return secrets.enclosing_function(found, secrets.function_lines(rows))


FUNCTION_CONTEXTS = """
select cast(c_custkey as varchar) as script_id, 'bearer-token' as type, 'abcdefghijklmnop' || c_custkey as value, 5 as line, 'GET /api/in/' || c_custkey as nearby, 'Bearer' as headers, 'go' as function from customer
"""


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates of one script for each source, labels as answers."""
    rows = made.table(spark, sf_dir, "documents").select(
        F.col("source").alias("script_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("type"), F.lit("low").alias("severity"), F.col("doc_id").cast("string").alias("value"), F.lit("e").alias("evidence"))
    said = made.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("is_secret"), F.lit("").alias("secret_type"), F.lit(None).cast("string").alias("severity"), F.lit(0.5).alias("confidence"))
    none = spark.createDataFrame([], rules.FINDING)
    sure, _, counts = secrets.reviewed(rows, none, said, spark.createDataFrame([], "id string, is_risk boolean, category string, type string, severity string, confidence double"), secret_types=["en", "de"])
    sure = sure.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_secrets"), F.count_if(F.col("source") == "regex").alias("n_passed"))
    return sure.join(counts, "script_id").select(
        "script_id", "n_secrets", "n_passed", "llm_candidate_count", "llm_batch_count", "llm_reviewed_count", "llm_confirmed_count", "llm_rejected_count", "llm_dropped_count")


REVIEW_COUNTS = """
with d as (select source as script_id, coalesce(lang in ('en', 'de'), false) as asked, quality from documents left join labels using (doc_id))
select script_id, count(*) filter (where not asked or quality = 1) as n_secrets, count(*) filter (where not asked) as n_passed, count(*) filter (where asked) as llm_candidate_count,
  cast(ceil(count(*) filter (where asked) / 5) as bigint) as llm_batch_count, count(quality) filter (where asked) as llm_reviewed_count, count(*) filter (where asked and quality = 1) as llm_confirmed_count,
  count(*) filter (where asked and quality <> 1) as llm_rejected_count, count(*) filter (where asked and quality is null) as llm_dropped_count from d group by 1 having count(*) filter (where asked) > 0
"""


def confirmed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of line items, of which credentials stay only as confirmed secrets; risks and secrets become findings too."""
    found = made.found_rows(spark, sf_dir).withColumns({"category": F.when(F.col("category") == "cA", "云配置").otherwise("路由信息"), "source": F.when(F.col("source") == "string", "secret").otherwise("call")})
    own = made.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("script_id"), F.col("s_suppkey").alias("ord"), F.lit("tF").alias("type"), F.lit("v0007").alias("value"), F.lit("low").alias("severity"), F.lit("e").alias("evidence"))
    kept = secrets.only_confirmed(found, own).select("script_id", "category", "type", "value", "confidence", "source")
    more = rules.secret_findings(secrets.fallback_secrets(own)).unionByName(rules.risk_findings(own.withColumn("type", F.lit("export-api"))))
    return kept.unionByName(more.select(kept.columns))


CONFIRMED_FINDINGS = "with" + _FOUND_SQL + """
select script_id, case category when 'cA' then '云配置' else '路由信息' end as category, type, value, cast(confidence as double) as confidence, case source when 'string' then 'secret' else 'call' end as source from f
where category <> 'cA' or (source = 'string' and type = 'tF' and value = 'v0007')
union all select cast(s_suppkey as varchar), '敏感凭据', 'tF', 'v0007', 0.75, 'secret' from supplier union all select cast(s_suppkey as varchar), 'API 信息', 'export-api', null, 0.7, 'risk' from supplier
"""


def soft_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("script_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 4).alias("n"))
    return rules.soft_stop(rows, "n", 9).select("script_id", "ord")


SOFT_STOPS = """
with e as (select cast(user_id as varchar) as script_id, event_id as ord, sum(event_id % 4) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as n from events)
select script_id, ord from e where coalesce(n, 0) < 9
"""

QUERIES = {
    "function_contexts": (function_contexts, FUNCTION_CONTEXTS), "review_counts": (review_counts, REVIEW_COUNTS), "confirmed_findings": (confirmed_findings, CONFIRMED_FINDINGS), "soft_stops": (soft_stops, SOFT_STOPS),
    "risk_rules": (risk_rules, RISK_RULES.replace("\\\\", "\\")), "finding_rules": (finding_rules, _rules_sql()), "name_rules": (name_rules, NAME_RULES), "finding_topk": (finding_topk, FINDING_TOPK),
    "evidence_snippets": (evidence_snippets, EVIDENCE_SNIPPETS), "secret_candidates": (secret_candidates, _secrets_sql()), "hidden_texts": (hidden_texts, _hidden_sql()), "api_findings": (api_findings, API_FINDINGS), "text_findings": (text_findings, TEXT_FINDINGS), "asset_findings": (asset_findings, ASSET_FINDINGS), "secret_lines": (secret_lines, SECRET_LINES),
    "redacted_turns": (redacted_turns, REDACTED_TURNS), "enclosing_function_asof": (enclosing_function_asof, ENCLOSING_FUNCTION_ASOF), "review_join": (review_join, REVIEW_JOIN),
    "review_allowlist": (review_allowlist, REVIEW_ALLOWLIST), "review_failure": (review_failure, REVIEW_FAILURE), "endpoint_evidence": (endpoint_evidence, ENDPOINT_EVIDENCE),
    "leak_rows": (leak_rows, LEAK_ROWS), "group_counts": (group_counts, GROUP_COUNTS), "method_counts": (method_counts, METHOD_COUNTS), "analysis_summary": (analysis_summary, ANALYSIS_SUMMARY),
    "file_rows": (file_rows, FILE_ROWS),
}
