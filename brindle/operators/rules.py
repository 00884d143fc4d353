"""Rules over values and names: risks of urls, findings, their identity, order and caps."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.matches import WORD_START, between, matches, once, record, stretches
from brindle.functions.text import is_placeholder, redacted, squeezed, truncated
from brindle.operators.order import capped, dealt, first_wins, worked_out

_JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"

# Category, type, severity, confidence, pattern of values, pattern of names.
FINDING_RULES = (
    ("敏感凭据", "access-key", "high", 0.85, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", None),
    ("敏感凭据", "secret-key", "high", 0.75, None, r"(?i)secret|secretKey|secret_key|sk|access[_-]?key"),
    ("敏感凭据", "token", "high", 0.75, r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]{12,}|" + _JWT, r"(?i)token|accessToken|refreshToken"),
    ("敏感凭据", "password", "high", 0.65, None, r"(?i)password|passwd|pwd"),
    ("API 信息", "gateway-or-api-base", "medium", 0.7, r"(?i)gateway|/api/|api[-.][A-Za-z0-9.-]+|baseUrl", r"(?i)gateway|baseUrl|apiHost|apiBase"),
    ("API 信息", "environment-url", "medium", 0.7, r"(?i)https?://[^'\"`\s]*(?:dev|test|uat|stage|staging|pre|prod)[^'\"`\s]*", r"(?i)env|environment|profile"),
    ("权限信息", "role-admin-auth", "medium", 0.7, r"(?i)role|admin|auth|permission|privilege|rbac", r"(?i)role|admin|auth|permission|privilege|rbac"),
    ("云配置", "aliyun-oss", "medium", 0.8, r"(?i)oss-[a-z0-9-]+\.aliyuncs\.com|aliyuncs\.com|STS\.AssumeRole|securityToken", r"(?i)oss|aliyun|stsToken|securityToken"),
    ("云配置", "aws-s3", "medium", 0.8, r"(?i)s3[.-][a-z0-9-]+\.amazonaws\.com|amazonaws\.com", r"(?i)s3|aws|bucket"),
    ("云配置", "tencent-cos", "medium", 0.8, r"(?i)cos\.[a-z0-9-]+\.myqcloud\.com|myqcloud\.com", r"(?i)cos|tencent|qcloud"),
    ("第三方配置", "wechat", "medium", 0.75, r"(?i)wx[a-f0-9]{16,}|api\.mch\.weixin\.qq\.com|open\.weixin\.qq\.com", r"(?i)wechat|weixin|wxAppId|appId|mchId"),
    ("第三方配置", "aliyun", "medium", 0.7, r"(?i)aliyun|aliyuncs\.com", r"(?i)aliyun|ali"),
    ("第三方配置", "tencent-cloud", "medium", 0.7, r"(?i)qcloud|tencentcloud|myqcloud\.com", r"(?i)qcloud|tencent"),
    ("调试信息", "source-map", "medium", 0.8, r"(?i)sourceMappingURL=.*\.map|\.js\.map|\.css\.map", None),
    ("调试信息", "debug-dev", "medium", 0.7, r"(?i)debug|devtools|sourceMap|__DEV__|localhost|webpackHotUpdate", r"(?i)debug|devtools|sourceMap|__DEV__"),
    ("内网信息", "private-ip-or-host", "medium", 0.85, r"(?i)(?:https?://)?(?:10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3}|127\.0\.0\.1|localhost|\.local\b|\.corp\b|\.internal\b)", None),
    ("路由信息", "dynamic-request-target", "medium", 0.55, None, r"(?i)callbackUrl|redirectUrl|targetUrl|returnUrl|nextUrl|webhook"),
    ("JWT/OAuth", "jwt-oauth", "high", 0.8, r"(?i)" + _JWT + "|oauth|client_secret|client_id|authorization_code", r"(?i)jwt|oauth|clientSecret|clientId|authorization"),
    ("GraphQL", "graphql", "medium", 0.75, r"(?i)/graphql\b|query\s+[A-Za-z0-9_]*\s*\{|mutation\s+[A-Za-z0-9_]*\s*\{|__schema|gql`", r"(?i)graphql|gql|query|mutation"),
    ("路由信息", "sensitive-route", "medium", 0.7, r"(?i)/(?:admin|debug|internal|manage|system|console|actuator)(?:/|\z|\?)", r"(?i)admin|debug|internal|manage|system|console|actuator"),
)
# Type and pattern of risky urls; all are of medium severity.
RISK_RULES = (
    ("admin-api", r"(?i)/(?:admin|manage|system|console)(?:/|\z|\?)"),
    ("internal-api", r"(?i)/(?:internal|private|actuator)(?:/|\z|\?)"),
    ("debug-endpoint", r"(?i)/(?:debug|__debug|devtools)(?:/|\z|\?)"),
    ("destructive-api", r"(?i)/(?:delete|remove|destroy|drop|truncate)(?:[A-Z/?_-]|\z)"),
    ("export-api", r"(?i)/(?:export|download)(?:[A-Z/?_-]|\z)"),
)
# The rule over names of calls, what names a request and what makes its target dynamic.
CALL_RULE = ("GraphQL", "graphql-client-call", "medium", 0.75, r"(?i)\b(?:graphql|gql|ApolloClient|useQuery|useMutation)\b")
REQUEST_NAME = r"(?i)fetch|axios|request|open"
DYNAMIC_TARGET = r"(?i)callback|redirect|returnurl|nexturl|target|webhook|location\.|document\.url|window\.name|searchParams|query"
# Categories that need a confirmed secret.
GUARDED = ("敏感凭据", "云配置", "JWT/OAuth")
SOURCE_RANK = ("asset", "string", "identifier", "call", "risk", "api", "secret")
MOST_VALUE, MOST_EVIDENCE = 1000, 2500


_HIT = "array<struct<rule:int,category:string,type:string,severity:string,confidence:double>>"


def rule_hits(name: Column, value: Column, rules=FINDING_RULES) -> Column:
    """Array of struct(rule, category, type, severity, confidence) of the rules that a name and a value match, in their order.

    A match by name alone doesn't count for a value that is clearly a placeholder.
    """
    name, value = F.coalesce(name, F.lit("")), F.coalesce(value, F.lit(""))

    def one(i: int, rule: tuple) -> Column:
        category, kind, severity, confidence, by_value, by_name = rule
        hit_value = value.rlike(by_value) if by_value else F.lit(False)
        hit_name = name.rlike(by_name) if by_name else F.lit(False)
        hit = hit_value | (hit_name & ~is_placeholder(value))
        return F.when(hit, record(rule=F.lit(i), category=F.lit(category), type=F.lit(kind), severity=F.lit(severity), confidence=F.lit(float(confidence))))

    found = F.filter(F.array(*(one(i, r) for i, r in enumerate(rules))), lambda h: h.isNotNull())
    # most names and values match no rule, which two patterns tell
    some = [text.rlike("|".join(f"(?:{r[k]})" for r in rules if r[k])) for text, k in ((value, 4), (name, 5)) if any(r[k] for r in rules)]
    numbered = any(re.search(r"\\[1-9k]|\(\?<[A-Za-z]", p) for r in rules for p in r[4:6] if p)  # groups of several patterns can't be told apart
    return found if numbered or not some else F.when(reduce(Column.__or__, some), found).otherwise(F.array().cast(_HIT))


def matched_rules(rows: DataFrame, rules=FINDING_RULES) -> DataFrame:
    """``rows`` (name, value, ...) with category, type, severity, confidence, rule: a row for each rule that matches (see ``rule_hits``).

    Rules are one array of conditions in each row, so nothing is joined or shuffled; rules given by a caller have the
    form of ``FINDING_RULES``.
    """
    found = rows.withColumn("_h", F.explode(rule_hits(F.col("name"), F.col("value"), rules))).select(*rows.columns, "_h.*")
    return found.withColumn("value", F.coalesce(F.nullif(F.col("value"), F.lit("")), "name"))


def risks(apis: DataFrame) -> DataFrame:
    """script_id, ord, type, severity, evidence of risky urls; the first of each type and url stays."""
    hits = F.filter(F.array(*(F.when(F.col("url").rlike(p), F.lit(t)) for t, p in RISK_RULES)), lambda t: t.isNotNull())
    rows = apis.select("script_id", "ord", F.col("url").alias("evidence"), F.posexplode(hits).alias("pos", "type")).withColumn("severity", F.lit("medium"))
    return first_wins(rows, ["script_id", "type", "evidence"], ["ord", "pos"]).drop("pos")


def secret_category(kind: Column) -> Column:
    return (F.when(kind.rlike("(?i)oss|s3|cos|aliyun|aws"), "云配置").when(kind.rlike("(?i)jwt|bearer|token|key|secret|password"), "敏感凭据")
            .when(kind.rlike("(?i)internal"), "内网信息").when(kind.rlike("(?i)debug|test"), "调试信息").otherwise("敏感凭据"))


def risk_category(kind: Column) -> Column:
    return F.when(kind.rlike("(?i)admin|internal|debug|destructive"), "路由信息").otherwise("API 信息")


def severity_score(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def source_rank(source: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SOURCE_RANK):
        rank = F.when(source == name, i).otherwise(rank)
    return rank


def normal_findings(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"value": truncated(F.col("value"), MOST_VALUE), "evidence": truncated(F.col("evidence"), MOST_EVIDENCE)})


def ranked_findings(findings: DataFrame, **caps: int) -> DataFrame:
    """Distinct findings of each script (script_id, ord, category, type, value, severity, confidence, source, evidence), ranked and capped.

    Findings by name or string ignore their evidence when compared. Values that rank alike are in Unicode order.
    """
    loose = F.col("source").isin("identifier", "string")
    keys = [F.col("script_id"), F.col("category"), F.col("type"), F.col("source"),
            F.substring(F.trim(F.coalesce("value", F.lit(""))), 1, 220), F.when(loose, "").otherwise(squeezed(F.col("evidence")))]
    rows = first_wins(findings, keys, "ord")
    order = [severity_score(F.col("severity")).desc(), F.col("confidence").desc(), source_rank(F.col("source")).asc(),
             F.collate(F.coalesce("value", F.lit("")), "UNICODE").asc(), F.col("ord").asc()]
    return capped(rows, "script_id", order, **caps)


FINDING = "script_id string, ord long, category string, type string, value string, severity string, confidence double, source string, evidence string"


def soft_stop(rows: DataFrame, counts: str, most: int = 3000) -> DataFrame:
    """Rows of a script, in order, up to and with the one at which the running sum of ``counts`` reaches ``most``."""
    w = Window.partitionBy("script_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(counts).over(w), F.lit(0))).filter(F.col("_before") < most).drop("_before")


#: Findings come in this order: of apis, assets, secrets, risks, and of the text by place.
_PHASE, _PLACE = 10**16, 10**5


def _placed(phase: int, ord: Column, pos: Column | int = 0) -> Column:
    return (F.lit(phase * _PHASE) + ord.cast("long") * _PLACE + (F.lit(pos) if isinstance(pos, int) else pos)).cast("long")


def _finding(rows: DataFrame, ord: Column, category: Column | str, kind: Column | str, value: Column, severity: Column | str, confidence: Column, source: str, evidence: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        "script_id", ord.alias("ord"), lit(category).alias("category"), lit(kind).alias("type"), value.alias("value"), lit(severity).alias("severity"),
        confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), evidence.alias("evidence"))


def _ruled(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Findings of the rules that ``rows`` (script_id, ord, name, value, evidence) match, in the order of rules."""
    found = matched_rules(rows).withColumn("ord", F.col("ord") + F.col("rule"))
    return found.select("script_id", "ord", "category", "type", "value", "severity", F.col("confidence").cast("double").alias("confidence"), (F.lit(source) if source else F.col("source")).alias("source"), "evidence")


def with_api_evidence(apis: DataFrame, scripts: DataFrame, text: str = "content") -> DataFrame:
    """``found`` of each api: the text around the first place of its url, else of its resolved url; null without one.

    Apis and texts meet once by their script; a text that is given twice counts once.
    """
    texts = dealt(scripts.select("script_id", F.coalesce(F.col(text), F.lit("")).alias("_t")), "script_id").dropDuplicates(["script_id", "_t"])
    rows = dealt(apis, "script_id").join(texts, "script_id", "left")
    return rows.withColumn("found", F.coalesce(snippet(F.col("_t"), F.col("url")), snippet(F.col("_t"), F.col("resolved_url")))).drop("_t")


def api_findings(apis: DataFrame) -> DataFrame:
    """Of each api (with resolved_url, params, headers and ``found``, see ``with_api_evidence``): one finding by its confidence,
    then those of rules over its urls, and over the names of its parameters and headers. An api is read once."""
    sure = F.when(F.col("confidence") == "high", 0.9).when(F.col("confidence") == "medium", 0.7).otherwise(0.5)
    shown = F.coalesce("resolved_url", "url")
    spelled = F.concat_ws(" ", F.coalesce("method", F.lit("GET")), shown)
    none = F.lit(None).cast("string")
    asking = lambda name, value, evidence, own=none.cast("double"): record(sure=own, name=name, value=value, evidence=evidence)
    of_name = lambda n: asking(n, none, F.concat_ws(":", "url", n))
    names = F.transform(F.coalesce("params", F.array()), lambda p: p["name"])
    asked = F.concat(
        F.array(asking(none, shown, F.coalesce("found", spelled), sure.cast("double"))), F.array(asking(none, F.col("url"), F.col("url"))),
        F.when(F.col("resolved_url").isNotNull(), F.array(asking(none, F.col("resolved_url"), F.col("resolved_url")))).otherwise(F.array()),
        F.transform(names, of_name), F.transform(F.coalesce("headers", F.array()), of_name))
    rows = apis.select("script_id", F.col("ord").alias("_o"), F.posexplode(asked).alias("pos", "x")).select("script_id", _placed(0, F.col("_o"), F.col("pos") * 50).alias("_place"), "x.*")
    itself = F.array(record(rule=F.lit(0), category=F.lit("API 信息"), type=F.lit("api-endpoint"), severity=F.lit("medium"), confidence=F.col("sure"))).cast(_HIT)
    hits = F.when(F.col("sure").isNotNull(), itself).otherwise(rule_hits(F.col("name"), F.col("value")).cast(_HIT))
    rows = rows.withColumn("_h", F.explode(hits))
    value = F.when(F.col("sure").isNotNull(), F.col("value")).otherwise(F.coalesce(F.nullif(F.col("value"), F.lit("")), "name"))
    return rows.select("script_id", (F.col("_place") + F.col("_h.rule")).alias("ord"), "_h.category", "_h.type", value.alias("value"), "_h.severity", "_h.confidence", F.lit("api").alias("source"), "evidence")


def asset_findings(assets: DataFrame) -> DataFrame:
    """One finding for each asset, then those of rules over its url and chunk name."""
    one = _finding(assets, _placed(1, F.col("ord")), "webpack模块", "hidden-asset", F.col("url"), "low", F.lit(0.85), "asset", F.col("source"))
    rows = assets.select("script_id", _placed(1, F.col("ord"), 50).alias("ord"), F.col("chunk_name").alias("name"), F.col("url").alias("value"), F.col("url").alias("evidence"))
    return one.unionByName(_ruled(rows, "asset"))


def secret_findings(secrets: DataFrame) -> DataFrame:
    return _finding(secrets, _placed(2, F.col("ord")), secret_category(F.col("type")), F.col("type"), F.col("value"), F.col("severity"), F.coalesce("confidence", F.lit(0.75)), "secret", F.col("evidence"))


def risk_findings(found: DataFrame) -> DataFrame:
    """Findings of risks have no value."""
    return _finding(found, _placed(3, F.col("ord")), risk_category(F.col("type")), F.col("type"), F.lit(None).cast("string"), F.col("severity"), F.lit(0.7), "risk", F.col("evidence"))


_LITERAL = r"(?:\"((?:[^\"\\\r\n]|\\.)*+)\"|'((?:[^'\\\r\n]|\\.)*+)'|`([^`]*+)`)"
#: Declared names and keys with the literal that follows, literals on their own, and names of calls with what their first argument begins with.
_NAMED = WORD_START + r"(?:(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)(?=\s*[=;,])|[\"']?([A-Za-z_$][A-Za-z0-9_$-]*)[\"']?\s*:)(?=(?:\s*=)?\s*(?:" + _LITERAL + ")?)"
_CALLED = r"(?<![A-Za-z0-9_$.])(?!(?:if|for|while|switch|catch|function|return|typeof)(?![A-Za-z0-9_$]))([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\((?=([^,()]{0,400}))"


_PLACED = "struct<place:bigint,ord:bigint,category:string,type:string,value:string,severity:string,confidence:double,source:string,evidence:string,at:int,n:int>"


def text_findings(scripts: DataFrame, text: str = "content", most: int = 3000, before: DataFrame | None = None) -> DataFrame:
    """Findings of rules over declared names, keys, literals and names of calls, by their place in the text.

    After ``most`` findings of a script no further place is looked at; ``before`` (script_id, n) has how many it had already. A text is
    read once, in its own row: its matches, the rules, the stop and the evidence are lists of it, and nothing is shuffled but the text to meet ``before``.
    """
    content = F.col("_t")
    rows = scripts.select("script_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    none = F.array().cast("array<struct<at:int,kind:int,name:string,value:string>>")
    hole = r"\$\{[^{}]*\}"
    whole = lambda m: F.coalesce(F.nullif(m["a"], F.lit("")), F.nullif(m["b"], F.lit("")), F.nullif(F.regexp_replace(m["c"], hole, r"\${value}"), F.lit("")))
    named = F.transform(matches(content, _NAMED, x=1, y=2, a=3, b=4, c=5), lambda m: record(at=m["at"], kind=F.lit(0), name=F.concat(m["x"], m["y"]), value=whole(m)))
    # each piece of a template is a text of its own
    pieces = lambda m: F.when(F.contains(m["c"], F.lit("${")), F.split(m["c"], hole, -1)).otherwise(F.array(F.concat(m["a"], m["b"], m["c"])))
    alone = F.flatten(F.transform(matches(content, _LITERAL, a=1, b=2, c=3), lambda m: F.transform(pieces(m), lambda p, i: record(at=m["at"], kind=F.lit(50) + F.least(i, F.lit(49)), name=F.lit(None).cast("string"), value=p))))
    called = F.transform(matches(content, _CALLED, name=1, value=2), lambda m: record(at=m["at"], kind=F.lit(100), name=m["name"], value=m["value"]))
    left = F.lit(most)
    if before is not None:
        # both dealt, since texts cost far more than their bytes say: few tasks would take them all
        rows = dealt(rows, "script_id").join(dealt(before.select("script_id", F.col("n").alias("_had")), "script_id"), "script_id", "left")
        left = F.greatest(left - F.coalesce("_had", F.lit(0)), F.lit(0)).cast("int")
    rows = once(rows, _m=F.concat(*(F.coalesce(x, none) for x in (named, alone, called))), _left=left)
    category, kind, severity, confidence, by_name = CALL_RULE
    nothing = F.lit(None).cast("string")

    def hit(m: Column, rule: Column, category: Column, kind: Column, value: Column, severity: Column, confidence: Column, source: Column, evidence: Column, length: Column) -> Column:
        place = _placed(4, m["at"], m["kind"] * 30)
        return record(place=place, ord=place + rule, category=category, type=kind, value=value, severity=severity, confidence=confidence, source=source, evidence=evidence, at=m["at"], n=length).cast(_PLACED)

    def of_text(m: Column) -> Column:
        source, length = F.when(m["name"].isNotNull(), "identifier").otherwise("string"), F.char_length(F.coalesce(m["value"], m["name"]))
        value = F.coalesce(F.nullif(m["value"], F.lit("")), m["name"])
        return F.transform(rule_hits(m["name"], m["value"]), lambda h: hit(m, h["rule"], h["category"], h["type"], value, h["severity"], h["confidence"], source, nothing, length))

    def of_call(m: Column) -> Column:
        fixed = lambda rule, category, kind, value, confidence, evidence: hit(m, F.lit(rule), F.lit(category), F.lit(kind), value, F.lit(severity), F.lit(confidence), F.lit("call"), evidence, F.char_length(m["name"]))
        argument = F.regexp_replace(F.trim(m["value"]), r"\"[^\"]*\"|'[^']*'", "StringLiteral")
        target = m["name"].rlike(REQUEST_NAME) & ~argument.rlike(r"^(?:StringLiteral$|\{)") & argument.rlike(DYNAMIC_TARGET)
        return F.filter(F.array(
            F.when(m["name"].rlike(by_name), fixed(0, category, kind, m["name"], confidence, F.concat(F.lit("call:"), m["name"]))),
            F.when(target, fixed(1, "路由信息", "dynamic-request-target", nothing, 0.55, nothing))), lambda h: h.isNotNull())

    spoken = F.filter("_m", lambda m: (m["kind"] == 100) | (F.coalesce(m["value"], m["name"], F.lit("")) != ""))
    hits = F.flatten(F.transform(spoken, lambda m: F.when(m["kind"] == 100, of_call(m)).otherwise(of_text(m))))
    rows = once(rows, _all=F.array_sort(hits)).drop("_m").filter("size(_all) > 0 and _left > 0")
    last = F.get("_all", F.col("_left") - 1)["place"]  # the place at which the stop is reached counts whole
    kept = F.when(F.size("_all") <= F.col("_left"), F.col("_all")).otherwise(F.filter("_all", lambda h: h["place"] <= last))
    held = once(rows, _h=kept, _p=stretches(content), _n=F.char_length(content)).drop("_t", "_all")
    shown = lambda h: F.coalesce(h["evidence"], around_part(F.col("_p"), F.col("_n"), h["at"], h["n"]))
    columns = ["ord", "category", "type", "value", "severity", "confidence", "source"]
    return held.select("script_id", F.inline(F.transform("_h", lambda h: record(**{c: h[c] for c in columns}, evidence=shown(h)))))


def all_findings(scripts: DataFrame, apis: DataFrame, assets: DataFrame, secrets: DataFrame, found_risks: DataFrame, text: str = "content", **caps: int) -> DataFrame:
    """Findings of apis, assets, secrets, risks and the text, in this order, cut to size, distinct, ranked and capped.

    The findings of the text stop at a number that counts those ahead of them, which are worked out once.
    """
    shown = with_api_evidence(apis, scripts, text)
    ahead = worked_out(reduce(DataFrame.unionByName, [api_findings(shown), asset_findings(assets), secret_findings(secrets), risk_findings(found_risks)]))
    before = ahead.groupBy("script_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked_findings(normal_findings(ahead.unionByName(text_findings(scripts, text, before=before))), **caps)


def _around(part, n: Column, at: Column, length: Column, reach: int, most: int) -> Column:
    start = F.greatest(at - reach, F.lit(0))
    end = F.least(at + F.greatest(length, F.lit(1)) + reach, n)
    ahead, behind = F.when(start > 0, "...").otherwise(""), F.when(end < n, "...").otherwise("")
    cut = F.concat(ahead, part(start, F.least(end - start, F.lit(most))), behind)
    full = F.char_length(ahead) + (end - start) + F.char_length(behind)
    return F.when(full > most, F.concat(F.substring(cut, 1, most), F.lit("..."))).otherwise(cut)


def around_index(text: Column, at: Column, length: Column, reach: int = 220, most: int = MOST_EVIDENCE) -> Column:
    """``reach`` characters on both sides of ``length`` ones from an offset, dots where the text goes on; cut to ``most``."""
    return _around(lambda start, many: F.substring(text, start + 1, many), F.char_length(text), at, length, reach, most)


def around_part(parts: Column, n: Column, at: Column, length: Column, reach: int = 220, most: int = MOST_EVIDENCE) -> Column:
    """The same from a text of ``n`` characters in stretches, at the price of what is cut out."""
    return _around(lambda start, many: between(parts, start, many), n, at, length, reach, most)


def snippet(text: Column, value: Column, reach: int = 220, most: int = MOST_EVIDENCE) -> Column:
    """The text around the first occurrence of ``value``; null without one."""
    at = F.instr(text, value) - 1
    return F.when((at >= 0) & (F.char_length(value) > 0), around_index(text, at, F.char_length(value), reach, most))


def lines_around(text: Column, line: Column, reach: int = 2, most: int = MOST_EVIDENCE, longest: int = 500) -> Column:
    """Numbered lines from ``reach`` ahead of a line (from 1) to ``reach`` behind it; long ones are cut."""
    lines = F.split(text, r"\r?\n", -1)
    start = F.greatest(line - reach, F.lit(1))
    shown = F.transform(F.slice(lines, start, reach + 1 + line - start), lambda t, i: F.concat((start + i).cast("string"), F.lit(": "), truncated(t, longest)))
    return F.when(line > 0, F.substring(F.array_join(shown, "\n"), 1, most))


def evidence_of(name: Column, value: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit("="), redacted(value))).otherwise(redacted(value))


__all__ = [
    "CALL_RULE", "FINDING_RULES", "GUARDED", "RISK_RULES", "all_findings", "api_findings", "around_index", "around_part", "asset_findings", "evidence_of", "lines_around", "matched_rules", "normal_findings", "ranked_findings",
    "risk_category", "risk_findings", "risks", "secret_category", "secret_findings", "severity_score", "snippet", "soft_stop", "source_rank", "text_findings", "with_api_evidence"]
