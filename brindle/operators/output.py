"""The three result tables, groups and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.urls import chunk_name
from brindle.operators.order import first_wins, last_by
from brindle.operators.rules import GUARDED

# Categories that leaks and exposures may have, and words that let a value be a leak.
LEAK_CATEGORIES = ("API 信息", "敏感凭据", "权限信息", "云配置", "第三方配置", "调试信息", "内网信息", "JWT/OAuth", "路由信息")
EXPOSURE_CATEGORIES = ("敏感凭据", "权限信息", "云配置", "第三方配置", "调试信息", "内网信息", "JWT/OAuth", "GraphQL", "路由信息")
LEAK_VALUE = r"(?i)^https?://|gateway|baseUrl|apiHost|apiBase|dev|test|uat|stage|staging|pre|prod"
SCRIPTS = "webpack模块"


def endpoints(apis: DataFrame, findings: DataFrame) -> DataFrame:
    """Apis with the evidence of the last endpoint finding for their resolved url, else their url, else "METHOD url"."""
    own = findings.filter((F.col("source") == "api") & (F.col("type") == "api-endpoint") & (F.coalesce("value", F.lit("")) != ""))
    known = last_by(own.select("script_id", "value", "evidence", "ord"), ["script_id", "value"], F.col("ord")).drop("ord")
    rows = apis.filter("coalesce(kind, 'api') = 'api'").withColumn("_shown", F.coalesce("resolved_url", "url"))
    for name, column in (("_e1", "_shown"), ("_e2", "url")):
        rows = rows.join(known.select("script_id", F.col("value").alias(column), F.col("evidence").alias(name)), ["script_id", column], "left")
    spelled = F.concat_ws(" ", F.coalesce("method", F.lit("GET")), "_shown")
    rows = rows.withColumn("evidence", F.coalesce("_e1", "_e2", spelled)).drop("_e1", "_e2", "_shown")
    return first_wins(rows, ["script_id", "method", "url", "resolved_url", "source"], "ord")


def js_files(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Assets, then findings of files; the first of each type, url and chunk name stays."""
    one = assets.select("script_id", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("branch"), "url", "type", "chunk_name", "source", F.lit(0.85).alias("confidence"), F.lit(None).cast("string").alias("evidence"))
    hidden = F.col("type") == "hidden-asset"
    kind = (F.when(hidden & F.col("value").rlike(r"(?i)\.m?js(?:\z|\?)"), "script").when(hidden & F.col("value").rlike(r"(?i)\.css(?:\z|\?)"), "style")
            .when(F.col("category") == SCRIPTS, "webpack-module").otherwise("asset"))
    rows = findings.filter(((F.col("source") == "asset") | (F.col("category") == SCRIPTS)) & (F.coalesce("value", F.lit("")) != ""))
    two = rows.select(
        "script_id", F.col("ord").cast("long").alias("ord"), F.lit(1).alias("branch"), F.col("value").alias("url"), kind.alias("type"), F.when(hidden, chunk_name(F.col("value"))).alias("chunk_name"),
        F.when(F.col("source") == "asset", "webpack-runtime").otherwise(F.col("source")).alias("source"), "confidence", "evidence")
    return first_wins(one.unionByName(two), ["script_id", "type", "url", F.coalesce("chunk_name", F.lit(""))], ["branch", "ord"]).drop("branch")


def leaks(secrets: DataFrame, findings: DataFrame, found_endpoints: DataFrame) -> DataFrame:
    """Secrets, then findings that are no endpoints and no secrets again; the first of each category, type, value and evidence stays."""
    columns = ["category", "type", "value", "severity", "confidence", "source", "evidence"]
    one = secrets.select("script_id", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("branch"), F.lit("敏感凭据").alias("category"), *columns[1:])
    urls = found_endpoints.select("script_id", F.explode(F.array("url", "resolved_url")).alias("value")).filter("value <> ''").distinct().withColumn("_api", F.lit(True))
    rows = findings.filter(F.col("category").isin(*LEAK_CATEGORIES)).join(urls, ["script_id", "value"], "left")
    free = (F.col("type") != "api-endpoint") & (F.col("source") != "api") & F.col("_api").isNull() & F.coalesce("value", F.lit("")).rlike(LEAK_VALUE)
    rows = rows.filter((F.col("category") != "API 信息") | free).drop("_api")
    key = lambda: ["script_id", "category", "type", F.coalesce("value", F.lit("")), F.coalesce("evidence", F.lit(""))]
    keyed = lambda df: df.withColumn("_key", F.struct(*key()))
    own = keyed(rows.filter("source = 'secret'")).join(keyed(one).select("_key").distinct(), "_key", "left_anti").drop("_key")
    two = rows.filter("source <> 'secret'").unionByName(own).select("script_id", F.col("ord").cast("long").alias("ord"), F.lit(1).alias("branch"), *columns)
    return first_wins(one.unionByName(two), key(), ["branch", "ord"]).drop("branch")


def grouped(findings: DataFrame, secrets: DataFrame) -> DataFrame:
    """A row for each section (endpoints, scripts, exposures) that a finding belongs to.

    Exposures of guarded categories, and those that are secrets, must be among the confirmed ``secrets`` (type and value).
    """
    sure = secrets.select("script_id", "type", F.coalesce("value", F.lit("")).alias("_v"), F.lit(True).alias("_ok")).distinct()
    rows = findings.withColumn("_v", F.coalesce("value", F.lit(""))).join(sure, ["script_id", "type", "_v"], "left")
    category, source = F.col("category"), F.col("source")
    endpoint, script = (source == "api") | (category == "API 信息"), (source == "asset") | (category == SCRIPTS)
    shown = category.isin(*EXPOSURE_CATEGORIES) & ~endpoint & ~script & ~(category.isin(*GUARDED) & (source != "secret")) & ((source != "secret") | F.coalesce("_ok", F.lit(False)))
    sections = F.filter(F.array(F.when(endpoint, "endpoints"), F.when(script, "scripts"), F.when(shown, "exposures")), lambda s: s.isNotNull())
    return rows.select(*findings.columns, F.explode(sections).alias("section"))


def group_counts(findings: DataFrame, secrets: DataFrame, apis: DataFrame, assets: DataFrame) -> DataFrame:
    """script_id, section, n: findings of a section and its own items: apis, assets, secrets."""
    items = [(apis.filter("coalesce(kind, 'api') = 'api'"), "endpoints"), (assets, "scripts"), (secrets, "exposures")]
    rows = grouped(findings, secrets).select("script_id", "section")
    for part, section in items:
        rows = rows.unionByName(part.select("script_id", F.lit(section).alias("section")))
    return rows.groupBy("script_id", "section").agg(F.count(F.lit(1)).alias("n"))


def counts_by(rows: DataFrame, column: str, missing: str = "UNKNOWN") -> DataFrame:
    """script_id, counts: map from value to number of rows."""
    per = rows.groupBy("script_id", F.coalesce(column, F.lit(missing)).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("script_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias("counts"))


def summary(scripts: DataFrame, apis: DataFrame, found_leaks: DataFrame, files: DataFrame) -> DataFrame:
    """Counts for each script: endpoints, leaks, files, resolved urls and high severities."""
    def per(rows: DataFrame, **counts) -> DataFrame:
        return rows.groupBy("script_id").agg(*(c.alias(n) for n, c in counts.items()))

    out = scripts.select("script_id").distinct()
    for part in (per(apis, endpoint_count=F.count(F.lit(1)), resolved_count=F.count("resolved_url")),
                 per(found_leaks, leak_count=F.count(F.lit(1)), high_count=F.count_if(F.col("severity") == "high")), per(files, js_file_count=F.count(F.lit(1)))):
        out = out.join(part, "script_id", "left")
    return out.na.fill(0)


def full_summary(scripts: DataFrame, found: dict[str, DataFrame], review: DataFrame | None = None) -> DataFrame:
    """The measures of an analysis, a row for each script: how many of everything, by method, type and category too.

    ``found``: the tables of ``plans.analyze``; ``review``: counters of reviews for each script (``secrets.review_counts``).
    """
    count = F.count(F.lit(1))
    apis, findings = found["apis"], found["findings"]
    parts = [
        apis.groupBy("script_id").agg(count.alias("api_count"), F.count("resolved_url").alias("resolved_api_count")), counts_by(apis, "method").withColumnRenamed("counts", "api_method_counts"),
        found["assets"].groupBy("script_id").agg(count.alias("asset_count")), found["params"].groupBy("script_id").agg(count.alias("param_count")),
        found["auth"].select("script_id", F.size("auth").cast("long").alias("auth_count")),
        found["secrets"].groupBy("script_id").agg(count.alias("secret_count")), counts_by(found["secrets"], "type").withColumnRenamed("counts", "secret_type_counts"),
        found["risks"].groupBy("script_id").agg(count.alias("risk_count")),
        findings.groupBy("script_id").agg(count.alias("finding_count"), F.count_if(F.col("severity") == "high").alias("high_severity_finding_count")),
        counts_by(findings, "category").withColumnRenamed("counts", "finding_category_counts"),
        group_counts(findings, found["secrets"], apis, found["assets"]).groupBy("script_id").pivot("section", ["endpoints", "exposures", "scripts"]).agg(F.first("n")).select(
            "script_id", F.col("endpoints").alias("endpoint_group_count"), F.col("exposures").alias("exposure_group_count"), F.col("scripts").alias("script_group_count"))]
    out = scripts.select("script_id").distinct()
    for part in (*parts, *([review] if review is not None else [])):
        out = out.join(part, "script_id", "left")
    numbers = [c for c, t in out.dtypes if t in ("bigint", "int")]
    none = F.create_map().cast("map<string,bigint>")
    return out.na.fill(0, numbers).withColumns({c: F.coalesce(c, none) for c, t in out.dtypes if t.startswith("map")})


__all__ = ["counts_by", "endpoints", "full_summary", "group_counts", "grouped", "js_files", "leaks", "summary"]
