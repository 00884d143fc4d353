"""Scripts from pages, inline contents and requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import SPACE, chosen_mode, count_of, first_kind, line_count, strip_bom, utf16_length
from brindle.functions.urls import host, pathname

BLOCK = r"(?is)<script\b[^>]*>(.*?)</script>"


def read_scripts(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """script_id, url, content from a store: parquet, json, orc or csv with these columns, or whole text files."""
    if kind == "text":
        rows = spark.read.text(path, wholetext=True).withColumn("url", F.col("_metadata.file_path"))
        return rows.select(F.sha2("url", 256).alias("script_id"), "url", F.col("value").alias("content"))
    return spark.read.format(kind).options(**options).schema("script_id string, url string, content string").load(path)


def blocks(content: Column) -> Column:
    """Bodies of script elements that aren't blank; none without a lower-case opening tag."""
    found = F.regexp_extract_all(content, F.lit(BLOCK), F.lit(1))
    kept = F.filter(found, lambda b: b.rlike(r"\S"))
    return F.when(F.contains(content, F.lit("<script")), kept).otherwise(F.array().cast("array<string>"))


def with_script(pages: DataFrame, content: str = "content") -> DataFrame:
    """``script_blocks`` and ``script``: the blocks joined by line feeds, or the whole text where there are none."""
    text = strip_bom(F.col(content))
    rows = pages.withColumn("script_blocks", F.coalesce(blocks(text), F.array().cast("array<string>")))
    joined = F.array_join("script_blocks", "\n")
    return rows.withColumn("script", F.when(F.size("script_blocks") > 0, joined).otherwise(F.coalesce(text, F.lit(""))))


def diagnostics(pages: DataFrame, content: str = "content") -> DataFrame:
    """Twelve measures of a raw text and of the script in it."""
    raw = F.coalesce(F.col(content), F.lit(""))
    rows = with_script(pages, content)
    lead = F.char_length(F.regexp_extract("script", "^" + SPACE + "*", 0))
    rows = rows.withColumn("_lead", lead)
    first = F.substring("script", F.col("_lead") + 1, F.lit(1))
    head = F.lower(F.substring("script", F.col("_lead") + 1, F.lit(64)))
    made = {
        "raw_length": utf16_length(raw), "script_length": utf16_length(F.col("script")), "block_count": F.size("script_blocks"),
        "extracted": F.size("script_blocks") > 0, "has_bom": F.startswith(raw, F.lit("﻿")), "leading_space": F.col("_lead"),
        "first_code_point": F.when(first != "", F.expr("ascii(substring(script, _lead + 1, 1))")), "first_kind": first_kind(first),
        "looks_like_html": F.startswith(head, F.lit("<")), "looks_like_json": head.rlike(r"^[\[{]"),
        "nul_count": count_of(raw, "\x00"), "replacement_count": count_of(raw, "�"),
    }
    return rows.withColumns(made).drop("_lead", "script", "script_blocks")


def requests(rows: DataFrame) -> DataFrame:
    """``origin`` (content or url) and ``error`` of analysis requests: contents that aren't blank win over urls."""
    has = F.coalesce(F.trim("content"), F.lit("")) != ""
    given = F.coalesce(F.trim("url"), F.lit("")) != ""
    good = F.try_parse_url("url", F.lit("HOST")).isNotNull()
    error = F.when(given & ~good, "url must be a URL").when(~has & ~given, "content or url is required")
    return rows.withColumn("origin", F.when(has, "content").when(given, "url")).withColumn("error", error)


def request_summary(rows: DataFrame) -> DataFrame:
    """What is logged of analysis requests (url, content, async, response_mode, fast_mode, mode): no text, only its measures."""
    text, url = F.coalesce("content", F.lit("")), F.col("url")
    has = F.trim(text) != ""
    mode = chosen_mode(F.coalesce("fast_mode", F.lit(False)), F.col("mode"))
    return rows.withColumns({
        "has_url": F.coalesce(F.trim(url), F.lit("")) != "", "url_host": host(url), "url_path": pathname(url), "has_content": has, "content_length": utf16_length(text),
        "content_lines": F.when(has, line_count(text)).otherwise(0), "content_sha256": F.when(has, F.sha2(text, 256)), "is_async": F.coalesce("async", F.lit(False)),
        "response_mode": F.coalesce("response_mode", F.lit("full")), "requested_mode": F.col("mode"), "llm_expected": mode == "full"}).withColumn("mode", mode)


def secret_requests(rows: DataFrame) -> DataFrame:
    """Requests whose candidate and context aren't empty."""
    return rows.filter((F.length("candidate") > 0) & (F.length("context") > 0))


def downloaded(rows: DataFrame, fetch: Callable[[str, int, float], tuple[int, str]], most: int = 10 * 1024 * 1024, seconds: float = 10.0) -> DataFrame:
    """``content`` of rows whose origin is a url, by a transport given by the caller; failures go to ``error``.

    The transport gets a url, the bytes it should read at most (one more than are allowed) and the seconds it may take; it
    returns a status and a text. Nothing here opens a connection.
    """
    columns = rows.columns

    def one(url: str) -> tuple[str | None, str | None]:
        try:
            status, text = fetch(url, most + 1, seconds)
        except Exception as e:  # noqa: BLE001 - any failure of the transport belongs to its row
            return None, f"download failed: {e}"
        if not 200 <= status < 300:
            return None, f"download failed with status {status}"
        return (None, f"download exceeds {most} bytes") if len(text.encode()) > most else (text, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wanted = (pdf["origin"] == "url") & pdf["error"].isna()
            got = [one(url) for url in pdf.loc[wanted, "url"]]
            for k, name in enumerate(("content", "error")):
                pdf[name] = pdf[name].astype(object)
                pdf.loc[wanted, name] = pd.Series([x[k] for x in got], index=pdf.index[wanted], dtype=object)
            yield pdf[columns]

    return rows.mapInPandas(run, rows.schema)


__all__ = ["blocks", "diagnostics", "downloaded", "read_scripts", "request_summary", "requests", "secret_requests", "with_script"]
