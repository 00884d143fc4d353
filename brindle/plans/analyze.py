"""A whole analysis: scripts to endpoints, leaks, script files and a summary, with all that they are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.matches import once
from brindle.operators import bases, calls, chunks, output, rules, scan, secrets
from brindle.operators.order import dealt, worked_out
from brindle.operators.review import Transport, reviewed_in_rounds
from brindle.sources.scripts import with_script

#: What texts that are no scripts are scanned for comes after what scripts call.
_AFTER = 100_000_000
TABLES = ("endpoints", "leaks", "js_files", "summary", "errors")


def analyze(scripts: DataFrame, mode: str = "full", secret_reviews: DataFrame | None = None, finding_reviews: DataFrame | None = None, transport: Transport | None = None, **review) -> dict[str, DataFrame]:
    """The tables of an analysis of ``scripts`` (script_id, url, content), each with script_id.

    ``endpoints``, ``leaks``, ``js_files``, ``summary`` and ``errors`` are the results; ``apis``, ``params``, ``auth``, ``assets``, ``secrets``,
    ``risks``, ``findings`` and ``counters`` what they are made from, ``diagnostics`` says how each script was read. Pages count by
    their script blocks; a text that begins with a bracket of markup and has none, or whose brackets don't match, is scanned as
    text too. ``review`` goes to ``secrets.reviewed``, or with a ``transport``
    to ``review.reviewed_in_rounds``, whose ``batches`` are a table too. Rows without content are errors. Apis, assets, candidates of secrets and findings are worked out at once, since several tables are made from them.
    """
    given = scripts.filter("content is not null")
    # dealt by script and worked out: all that follows is within a script, so nothing of it is shuffled again
    rows = worked_out(once(with_script(dealt(given.select("script_id", "url", "content"), "script_id")).drop("script_blocks"), fallback=F.startswith(F.ltrim("script"), F.lit("<"))))
    facts = calls.file_and_base_facts(rows, "script")
    broken = calls.bracket_errors(facts)
    diagnostics = worked_out(rows.select("script_id", "fallback").join(broken, "script_id", "left").select(
        "script_id", (F.col("fallback") | (F.coalesce("error_count", F.lit(0)) > 0)).alias("fallback_used"), F.coalesce("error_count", F.lit(0)).cast("int").alias("error_count")))
    texts = rows.join(diagnostics.filter("fallback_used").select("script_id"), "script_id", "left_semi")
    columns = ["script_id", "ord", "source", "method", "url", "kind", "confidence", "params", "headers", "auth"]
    found = calls.client_calls(rows, "script").select(columns)
    spelled = scan.text_endpoints(texts, "content").withColumn("auth", F.when(F.col("auth").isNotNull(), F.array("auth")).otherwise(F.array().cast("array<string>")))
    found = found.unionByName(spelled.withColumn("ord", F.col("ord") + _AFTER).select(columns))
    spelled = scan.text_base_urls(texts, "script").select("script_id", (F.col("ord") + _AFTER).alias("ord"), "value", "source")
    apis = worked_out(calls.with_base_url(found, bases.base_urls(facts, rows).unionByName(spelled)))
    joined = chunks.chunk_files(facts).select("script_id", "ord", "url", "type", "chunk_name", "source")
    named = scan.text_assets(texts, "content").select("script_id", (F.col("ord") + _AFTER).alias("ord"), "url", "type", F.lit(None).cast("string").alias("chunk_name"), "source")
    assets = worked_out(joined.unionByName(named))
    risks = rules.risks(apis)
    candidates = secrets.secret_candidates(rows, "script").select("script_id", F.col("at").alias("ord"), "type", "severity", "value", "id", F.col("context").alias("evidence"))
    candidates = worked_out(candidates)
    raw = worked_out(rules.all_findings(rows, apis, assets, secrets.fallback_secrets(candidates), risks, "script"))  # reviews count them besides
    rounds = None
    if mode == "full" and transport is not None:
        sure, findings, counters, rounds = reviewed_in_rounds(candidates, raw, transport, **review)
    else:
        sure, findings, counters = secrets.reviewed(candidates, raw, secret_reviews, finding_reviews, mode, **review)
    if mode == "full" and (rounds is not None or (secret_reviews is not None and finding_reviews is not None)):
        findings = secrets.only_confirmed(findings, sure)
    findings = findings if findings is raw else worked_out(findings)
    out = {"apis": apis, "params": calls.call_params(apis), "auth": calls.call_auth(apis), "assets": assets, "secrets": sure, "risks": risks, "findings": findings, "counters": counters, "candidates": candidates, "diagnostics": diagnostics}
    if rounds is not None:
        out["batches"] = rounds
    out["endpoints"] = output.endpoints(apis, findings)
    out["js_files"] = output.js_files(assets, findings)
    out["leaks"] = output.leaks(sure, findings, out["endpoints"])
    out["summary"] = output.full_summary(given, out, counters)
    out["errors"] = scripts.filter("content is null").select("script_id", "url", F.lit("content or url is required").alias("error"))
    return out


def write_results(found: dict[str, DataFrame], path: str, tables: tuple[str, ...] = TABLES) -> None:
    """The result tables as Parquet, a folder for each; what was there is replaced."""
    for name in tables:
        found[name].write.mode("overwrite").parquet(f"{path}/{name}")


def release(found: dict[str, DataFrame]) -> None:
    """Lets go of what was persisted."""
    for name in ("apis", "assets", "candidates", "diagnostics", "findings"):
        found[name].unpersist()


__all__ = ["TABLES", "analyze", "release", "write_results"]
