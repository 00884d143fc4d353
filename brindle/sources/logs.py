"""Log records: normalised, filtered by level, written as lines by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"debug": 10, "info": 20, "warn": 30, "error": 40}
RECORD = "level int, time long, pid int, hostname string, reqId string, req struct<method:string,url:string,host:string>, msg string"


def level_name(level: Column) -> Column:
    """Names of numeric levels, where 50 and more are errors."""
    return F.when(level >= 50, "error").when(level >= 40, "warn").when(level >= 30, "info").otherwise("debug")


def at_least(rows: DataFrame, level: str) -> DataFrame:
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("level")), F.lit(0))
    return rows.filter(rank >= LEVELS[level])


def parsed(lines: DataFrame) -> DataFrame:
    """JSON records as flat fields; other lines pass through as messages."""
    rows = lines.withColumn("_r", F.from_json("line", RECORD))
    known = F.col("_r.level").isNotNull()
    return rows.select(
        F.when(known, level_name(F.col("_r.level"))).alias("level"), F.timestamp_millis("_r.time").alias("time"),
        F.when(known, F.coalesce("_r.msg", F.lit(""))).otherwise(F.col("line")).alias("event"),
        F.col("_r.reqId").alias("req_id"), F.col("_r.req.method").alias("method"), F.col("_r.req.url").alias("url"), F.col("_r.req.host").alias("host"))


def formatted(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``line``: [LEVEL] time event k="v" ..., and ``log_date``; null fields are left out."""
    utc = F.to_utc_timestamp("time", F.current_timezone())
    stamp = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kinds = dict(rows.dtypes)

    def pair(c: str) -> Column:
        quoted = F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1") if kinds[c] == "string" else F.col(c).cast("string")
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), quoted))

    line = F.concat_ws(" ", F.concat(F.lit("["), F.upper("level"), F.lit("]")), stamp, F.col("event"), *(pair(c) for c in fields))
    return rows.select(F.date_format(utc, "yyyy-MM-dd").alias("log_date"), line.alias("line"))


def mirrored(rows: DataFrame) -> DataFrame:
    """Events of reviews, with the channel they are shown on."""
    shown = F.startswith("event", F.lit("llm_")) | (F.col("event") == "analyze_js_llm_runtime")
    return rows.filter(shown).withColumn("channel", F.when(F.col("level") == "error", "stderr").otherwise("stdout"))


def write_logs(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").partitionBy("log_date").text(path)


__all__ = ["at_least", "formatted", "level_name", "mirrored", "parsed", "write_logs"]
