"""Scalar text functions, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "﻿"
#: White space of scripts, wider than the default of regular expressions here.
SPACE = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PLACEHOLDER = r"(?i)^(?:xxx+|your[_-]?|example|changeme|password|token|test|demo)\z"


def strip_bom(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit(BOM)), F.substring(text, F.lit(2), F.char_length(text))).otherwise(text)


def line_count(text: Column) -> Column:
    """Lines parted by line feeds, with or without carriage return; 0 for an empty or null text."""
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a one-character needle."""
    return F.char_length(text) - F.char_length(F.translate(text, needle, ""))


def first_kind(first: Column) -> Column:
    """Kind of the first visible character of a script."""
    return (
        F.when(F.coalesce(first, F.lit("")) == "", "empty").when(first == "<", "html").when(first.isin("{", "["), "json")
        .when(first.isin('"', "'", "`"), "string").when(first.rlike("^[$_A-Za-z]"), "identifier")
        .when(first.rlike(r"^[\x00-\x1f\x7f]"), "control").when(first.rlike(r"^[()\]}.,;:+*/%=&|!?>~^-]"), "operator").otherwise("other"))


def truncated(text: Column, most: int) -> Column:
    n = F.char_length(text)
    note = F.concat(F.lit("... [truncated "), (n - most).cast("string"), F.lit(" chars]"))
    return F.when(n > most, F.concat(F.substring(text, 1, most), note)).otherwise(text)


def redacted(value: Column) -> Column:
    """First eight and last four characters of a long value."""
    return F.when(F.char_length(value) > 16, F.concat(F.substring(value, 1, 8), F.lit("..."), F.right(value, F.lit(4)))).otherwise(value)


def is_placeholder(value: Column) -> Column:
    return value.rlike(PLACEHOLDER)


def squeezed(text: Column, most: int = 220) -> Column:
    """White space as single spaces, trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, most)


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5))))


def chosen_mode(fast_mode: Column, mode: Column) -> Column:
    return F.when(fast_mode, "fast").otherwise(F.coalesce(mode, F.lit("full")))


def flag(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on")


def number(text: Column, default: float) -> Column:
    """A number from a setting's text; ``default`` if it isn't one."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(float(default)))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


__all__ = ["chosen_mode", "clamped", "comma_list", "count_of", "first_kind", "flag", "is_placeholder", "line_count", "number", "redacted", "squeezed", "strip_bom", "truncated", "utf16_length"]
