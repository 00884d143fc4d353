"""Secret candidates, their contexts, and what reviews make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.matches import line_and_column, line_marks, matches, once, record, stretches
from brindle.functions.text import clamped, truncated
from brindle.operators.order import dealt, first_wins
from brindle.operators.rules import GUARDED, around_part

# Names of headers that a context may hold, and what defines a function on a line.
HEADERS = ("Authorization", "X-Token", "JWT", "Bearer")
FUNCTION = r"function\s+([A-Za-z_$][A-Za-z0-9_$]*)|(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\("
# What is taken out of a text ahead of a review, in this order.
HIDDEN = (
    (r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED]"), (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[AWS_KEY_REDACTED]"),
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[JWT_REDACTED]"),
    (r'(?i)("(?:value|password|passwd|pwd|token|secret|apiKey|api_key|accessKey|access_key|secretKey|secret_key)"\s*:\s*")([^"]{1,500})(")', "$1[REDACTED]$3"),
    (r"(?i)((?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)([^\"',\s}]{4,500})", "$1[REDACTED]"),
)
#: Secrets and findings of one call of a review.
SECRET_BATCH, FINDING_BATCH = 5, 10
# Our own rules; type, severity and pattern, whose first group is the value.
SECRET_RULES = (
    ("jwt", "high", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("aws-key", "high", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("bearer-token", "high", r"(?i)bearer\s+([A-Za-z0-9._~+/=-]{12,})"),
    ("token", "high", r"(?i)\b(?:token|secret|passwd|password|api[_-]?key)\s*[=:]\s*[\"']([^\"'\r\n]{8,200})[\"']"),
    ("firebase-key", "medium", r"\b(AIza[0-9A-Za-z_-]{35})\b"),
    ("internal-url", "medium", r"(https?://(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9.]+[^\s\"'`]*)"),
)


def secret_candidates(scripts: DataFrame, text: str = "content", rules=SECRET_RULES, reach: int = 1200, most: int = 4000) -> DataFrame:
    """script_id, type, severity, value, at, line, column (from 1), id and ``context``, the text around it: a row for each
    match of each rule.

    What is found becomes a list in the row of its script, and the text is cut once into stretches, so a match costs its own
    context whatever the size of the text.
    """
    content = F.col("_t")
    none = F.array().cast("array<struct<type:string,severity:string,value:string,at:int>>")

    def hits(kind: str, severity: str, pattern: str) -> Column:
        found = F.transform(matches(content, pattern, value=1), lambda m: record(type=F.lit(kind), severity=F.lit(severity), value=m["value"], at=m["at"]))
        return F.coalesce(found, none)

    rows = once(scripts.select("script_id", F.coalesce(F.col(text), F.lit("")).alias("_t")), _m=F.concat(*(hits(*rule) for rule in rules))).filter(F.size("_m") > 0)
    rows = once(rows, _p=stretches(content), _n=F.char_length(content)).drop("_t")
    rows = once(rows, _l=line_marks(F.col("_p")))

    def placed(m: Column) -> Column:
        line, column = line_and_column(F.col("_p"), F.col("_l"), m["at"])
        context = around_part(F.col("_p"), F.col("_n"), m["at"], F.char_length(m["value"]), reach, most)
        return record(type=m["type"], severity=m["severity"], value=m["value"], at=m["at"], line=line, column=column, id=F.sha2(m["value"], 256), context=context)

    return rows.select("script_id", F.inline(F.transform("_m", placed)))


def nearby_apis(contexts: DataFrame, apis: DataFrame) -> DataFrame:
    """``nearby`` ("METHOD url" of the script's apis that the context holds, in their order) and ``headers`` it names.

    The apis of a script are one list, so no context is sent more than once.
    """
    listed = dealt(apis.select("script_id", "ord", "url", "method"), "script_id").groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("ord", "url", "method"))).alias("_apis"))
    rows = dealt(contexts, "script_id").join(listed, "script_id", "left")
    near = F.transform(F.filter(F.coalesce("_apis", F.array()), lambda a: F.contains("context", a["url"])), lambda a: F.concat_ws(" ", F.coalesce(a["method"], F.lit("GET")), a["url"]))
    named = F.filter(F.array(*map(F.lit, HEADERS)), lambda h: F.contains(F.lower("context"), F.lower(h)))
    return rows.withColumn("nearby", near).withColumn("headers", named).drop("_apis")


def function_lines(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, line (from 1), name of the lines that define a function."""
    rows = scripts.select("script_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n", -1)).alias("at", "_l"))
    name = F.coalesce(F.nullif(F.regexp_extract("_l", FUNCTION, 1), F.lit("")), F.nullif(F.regexp_extract("_l", FUNCTION, 2), F.lit("")))
    return rows.filter(F.col("_l").rlike(FUNCTION)).select("script_id", (F.col("at") + 1).alias("line"), name.alias("name"))


def hidden_text(text: Column, most: int = 12_000) -> Column:
    """A text as a review may see it: credentials taken out, cut."""
    for pattern, shown in HIDDEN:
        text = F.regexp_replace(text, pattern, shown)
    return truncated(text, most)


def finding_id(category: str = "category", kind: str = "type", source: str = "source", value: str = "value", evidence: str = "evidence") -> Column:
    return F.sha2(F.concat_ws(":", category, kind, source, F.coalesce(value, F.lit("")), F.coalesce(evidence, F.lit(""))), 256)


def enclosing_function(candidates: DataFrame, lines: DataFrame, reach: int = 80) -> DataFrame:
    """``function``: the name on the nearest line at or ahead of a candidate's, at most ``reach`` - 1 lines away (as-of join).

    ``lines``: script_id, line, name of lines that define a function. Lines are grouped in stretches of ``reach``, so
    the join is by equality on script and stretch, and each definition meets two of them.
    """
    stretch = lambda c: F.floor(c / reach)
    left = candidates.withColumn("_s", stretch(F.col("line")))
    right = lines.select("script_id", F.col("line").alias("_at"), "name", F.explode(F.array(stretch(F.col("line")), stretch(F.col("line")) + 1)).alias("_s"))
    left = dealt(left.withColumn("_row", F.struct(*candidates.columns)), "script_id", "_s")
    lines_of = dealt(right, "script_id", "_s").groupBy("script_id", "_s").agg(F.array_sort(F.collect_list(F.struct("_at", "name"))).alias("_defs"))  # ``reach`` lines and as many again at most
    met = left.join(lines_of, ["script_id", "_s"], "left")
    near = F.filter("_defs", lambda d: d["_at"].between(F.col("line") - (reach - 1), F.col("line")))
    return met.select("_row.*", F.get(F.reverse(near), F.lit(0))["name"].alias("function"))


def reviewed_secrets(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Confirmed candidates, with what the review says; others, and those without a review, go."""
    said = reviews.select("id", "is_secret", F.col("secret_type").alias("_type"), F.col("severity").alias("_severity"), F.col("confidence").alias("_confidence"))
    rows = candidates.join(said, "id").filter("is_secret")
    return rows.withColumns({
        "type": F.coalesce(F.nullif("_type", F.lit("")), "type"), "severity": F.coalesce("_severity", "severity"),
        "confidence": clamped(F.col("_confidence")), "source": F.lit("llm+regex")}).drop("is_secret", "_type", "_severity", "_confidence")


def fallback_secrets(candidates: DataFrame) -> DataFrame:
    """Candidates without a review."""
    sure = F.when(F.col("type") == "html-password-input", 0.35).otherwise(0.75)
    return candidates.withColumns({"confidence": sure, "source": F.lit("regex")})


def reviewed_findings(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Confirmed findings, overwritten by the review; their source becomes ``llm``."""
    said = reviews.select("id", "is_risk", *(F.col(c).alias(f"_{c}") for c in ("category", "type", "severity", "confidence")))
    rows = findings.join(said, "id").filter("is_risk")
    over = {c: F.coalesce(F.nullif(f"_{c}", F.lit("")), c) for c in ("category", "type", "severity")}
    return rows.withColumns(over | {"confidence": clamped(F.col("_confidence")), "source": F.lit("llm")}).drop("is_risk", "_category", "_type", "_severity", "_confidence")


def allowed(rows: DataFrame, column: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows for review and rows that pass by it; an empty list takes all."""
    if not names:
        return rows, rows.filter(F.lit(False))
    hit = F.coalesce(F.col(column).isin(*names), F.lit(False))
    return rows.filter(hit), rows.filter(~hit)


def settled_batches(rows: DataFrame, within: list[str]) -> DataFrame:
    """``outcome`` of rows in batches (batch, failed): a failed batch and all after it keep the rules' results."""
    w = Window.partitionBy(*within)
    first = F.min(F.when(F.col("failed"), F.col("batch"))).over(w)
    return rows.withColumn("outcome", F.when(first.isNotNull() & (F.col("batch") >= first), "kept").otherwise("reviewed"))


def reviewed(
        candidates: DataFrame, findings: DataFrame, secret_reviews: DataFrame | None, finding_reviews: DataFrame | None, mode: str = "full", secret_types: list[str] = (), categories: list[str] = (),
        review_secrets: bool = True, review_findings: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Secrets, findings and counters (script_id, ...) after a review, whose answers are tables by id.

    Without answers, or in another mode than ``full``, nothing is reviewed: candidates keep what the rules say. Those that the
    lists or the switches leave out pass by. Candidates without an answer were not looked at: they are dropped and counted.
    """
    on = mode == "full" and secret_reviews is not None and finding_reviews is not None
    asked, passed = allowed(candidates, "type", list(secret_types)) if review_secrets else (candidates.filter(F.lit(False)), candidates)
    wanted, left = allowed(findings.withColumn("id", finding_id()), "category", list(categories)) if review_findings else (findings.withColumn("id", finding_id()).filter(F.lit(False)), findings.withColumn("id", finding_id()))
    count = lambda rows, size, *names: rows.groupBy("script_id").agg(F.count(F.lit(1)).alias(names[0]), F.ceil(F.count(F.lit(1)) / size).alias(names[1]))
    said = lambda rows, reviews, ok, *names: rows.join(reviews.select("id", F.coalesce(ok, F.lit(False)).alias("_yes")), "id", "left").groupBy("script_id").agg(
        F.count("_yes").alias(names[0]), F.count_if(F.col("_yes")).alias(names[1]), F.count_if(~F.col("_yes")).alias(names[2]), F.count_if(F.col("_yes").isNull()).alias(names[3]))
    counts = count(asked, SECRET_BATCH, "llm_candidate_count", "llm_batch_count").join(count(wanted, FINDING_BATCH, "llm_finding_candidate_count", "llm_finding_batch_count"), "script_id", "full")
    if not on:
        return fallback_secrets(candidates), findings, counts.withColumns({"llm_batch_count": F.lit(0).cast("long"), "llm_finding_batch_count": F.lit(0).cast("long")})
    one = said(asked, secret_reviews, F.col("is_secret"), "llm_reviewed_count", "llm_confirmed_count", "llm_rejected_count", "llm_dropped_count")
    two = said(wanted, finding_reviews, F.col("is_risk"), "llm_finding_reviewed_count", "llm_finding_confirmed_count", "llm_finding_rejected_count", "llm_finding_dropped_count")
    secrets = fallback_secrets(passed).unionByName(reviewed_secrets(asked, secret_reviews))
    secrets = first_wins(secrets, ["script_id", "type", F.coalesce("value", F.lit("")), F.coalesce("evidence", F.lit(""))], "ord")
    found = left.unionByName(reviewed_findings(wanted, finding_reviews)).drop("id")
    found = first_wins(found, ["script_id", "category", "type", "source", F.coalesce("value", F.lit("")), F.coalesce("evidence", F.lit(""))], "ord")
    return secrets, found, counts.join(one, "script_id", "full").join(two, "script_id", "full")


def single_review(requests: DataFrame, answers: DataFrame | None) -> DataFrame:
    """is_secret, type, severity, confidence, reason of each request (candidate, context), by the id of its candidate."""
    rows = requests.withColumn("id", F.sha2("candidate", 256))
    if answers is None:
        return rows.withColumns({"is_secret": F.lit(False), "type": F.lit("unknown"), "severity": F.lit("low"), "confidence": F.lit(0.0), "reason": F.lit("no review is configured")})
    said = answers.select("id", "is_secret", F.col("secret_type").alias("type"), "severity", clamped(F.col("confidence")).alias("confidence"), "reason")
    found = rows.join(said, "id", "left")
    return found.withColumns({
        "reason": F.when(F.col("is_secret").isNull(), "no answer").otherwise(F.coalesce("reason", F.lit(""))), "type": F.coalesce("type", F.lit("unknown")),
        "severity": F.when(F.col("severity").isin("low", "medium", "high"), F.col("severity")).otherwise(F.when(F.col("is_secret").isNull(), "low").otherwise("medium")),
        "confidence": F.when(F.col("is_secret").isNull(), 0.0).otherwise(F.col("confidence")), "is_secret": F.coalesce("is_secret", F.lit(False))})


def only_confirmed(findings: DataFrame, secrets: DataFrame) -> DataFrame:
    """Findings of credentials, clouds and tokens stay only if they are confirmed secrets (type and value)."""
    guarded = F.col("category").isin(*GUARDED)
    sure = secrets.select("script_id", "type", F.coalesce("value", F.lit("")).alias("_v"), F.lit(True).alias("_ok")).distinct()
    rows = findings.withColumn("_v", F.coalesce("value", F.lit(""))).join(sure, ["script_id", "type", "_v"], "left")
    return rows.filter(~guarded | ((F.col("source") == "secret") & F.coalesce("_ok", F.lit(False)))).drop("_v", "_ok")


__all__ = ["allowed", "enclosing_function", "fallback_secrets", "finding_id", "function_lines", "hidden_text", "nearby_apis", "only_confirmed", "reviewed", "reviewed_findings", "reviewed_secrets", "secret_candidates", "settled_batches", "single_review"]
