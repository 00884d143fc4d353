"""Base urls of scripts: the values that settings named as such can have.

A setting's expression is worked out as a set: a conditional stands for both of its branches, or for one where its test compares
the script's own host with a text; a sum of alternatives is every sum of theirs. Names stand for what the script declares or
assigns, the protocol of the page's location for that of the script's url; parts that nobody can know are left out of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.matches import let, record
from brindle.functions.urls import host, is_base_url, normal_base
from brindle.operators.calls import MOST_PARTS, named_texts, value_of
from brindle.operators.order import first_wins
from brindle.operators.tokens import WORD, rendered

#: What the page's location is asked by.
_PROTOCOL = ("location.protocol", "document.location.protocol", "window.location.protocol")
_UNKNOWN = "undefined"


def _text(term: Column) -> Column:
    """The text of a term that is a single quoted one; else null."""
    t = F.get(term, F.lit(0))
    return F.when((F.size(term) == 1) & t.rlike("^[\"']"), F.substring(t, F.lit(2), F.char_length(t) - 2))


def _branches(term: Column, own_host: Column) -> Column:
    """An array of terms: those that a term without brackets can stand for; its first conditional is decided."""
    ask = F.array_position(term, "?")

    def decided(rest: Column) -> Column:
        colon = F.array_position(rest, ":")
        yes, no = F.slice(rest, F.lit(1), F.greatest(colon - 1, F.lit(0)).cast("int")), F.slice(rest, (colon + 1).cast("int"), F.size(rest))
        test = F.slice(term, F.lit(1), (ask - 1).cast("int"))
        by = F.greatest(F.array_position(test, "==="), F.array_position(test, "==")).cast("int")
        left, right = _text(F.slice(test, F.lit(1), F.greatest(by - 1, F.lit(0)))), _text(F.slice(test, by + 1, F.size(test)))
        known = (by > 0) & own_host.isNotNull()
        hit = F.coalesce(left == own_host, F.lit(False)) | F.coalesce(right == own_host, F.lit(False))
        return F.when(known & hit, F.array(yes)).when(known & (left.isNotNull() | right.isNotNull()), F.array(no)).otherwise(F.array(yes, no))

    return F.when(ask > 1, let(F.slice(term, (ask + 1).cast("int"), F.size(term)), decided)).otherwise(F.array(term))


def _step(term: Column, own_host: Column) -> Column:
    """The innermost bracket of a term, or else its first conditional, worked out: an array of terms."""
    close = F.array_position(term, ")").cast("int")

    def opened(head: Column) -> Column:
        back = F.array_position(F.reverse(head), "(").cast("int")
        at = close - back  # from 1; close itself if there is none
        inner, tail = F.slice(head, at + 1, back - 1), F.slice(term, close + 1, F.size(term))
        before = F.slice(head, F.lit(1), F.greatest(at - 1, F.lit(0)))
        called = F.coalesce(F.get(before, at - 2).rlike(f"^{WORD}$"), F.lit(False))
        call = F.concat(F.slice(before, F.lit(1), F.greatest(at - 2, F.lit(0))), F.array(F.lit(_UNKNOWN)), tail)
        again = lambda t: F.when(F.array_contains(t, "?"), F.concat(before, F.array(F.lit("(")), t, F.array(F.lit(")")), tail)).otherwise(F.concat(before, t, tail))
        return F.when(back == 0, F.array(F.filter(term, lambda t: t != ")"))).when(called, F.array(call)).otherwise(F.transform(_branches(inner, own_host), again))

    return F.when(close > 0, let(F.slice(term, F.lit(1), F.greatest(close - 1, F.lit(0))), opened)).otherwise(_branches(term, own_host))


def alternatives(term: Column, own_host: Column) -> Column:
    """The terms without brackets and conditionals that a term can stand for, in order."""
    turns = F.filter(F.concat(F.array(F.lit("(")), term), lambda t: t.isin("(", ")", "?"))
    return F.aggregate(turns, F.array(term), lambda acc, _: F.flatten(F.transform(acc, lambda t: _step(t, own_host))))


def base_urls(facts: DataFrame, scripts: DataFrame) -> DataFrame:
    """script_id, ord, value, source: base urls of settings, in their order; the first of each value stays.

    ``facts``: see ``callgraph.facts``; ``scripts``: script_id, url (may be null).
    """
    asked = facts.filter("kind = 'base'").select("script_id", F.col("pos").alias("ord"), "name", "term")
    known = facts.filter(F.col("kind").isin("constant", "assigned") & (F.size("term") < MOST_PARTS)).join(asked.select("script_id").distinct(), "script_id", "left_semi")
    protocol = F.coalesce(F.concat(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))), F.lit(":")), F.lit("https:"))
    own = scripts.select("script_id", host(F.col("url")).alias("_host"), protocol.alias("_protocol"))
    rows = asked.join(own, "script_id", "left")
    pairs = known.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("name").alias("k"), rendered(F.col("term")).alias("v")))).alias("_x"))
    pages = rows.groupBy("script_id").agg(F.first("_protocol").alias("_p")).join(pairs, "script_id", "left")
    location = F.array(*(record(k=F.lit(x), v=F.concat(F.lit("'"), F.col("_p"), F.lit("'"))) for x in _PROTOCOL))
    names = named_texts(pages.select("script_id", F.concat(location, F.coalesce(F.transform("_x", lambda x: record(k=x["k"], v=x["v"])), F.array().cast("array<struct<k:string,v:string>>"))).alias("_pairs")))
    rows = rows.join(names, "script_id").select("script_id", "ord", "name", "names", F.posexplode(alternatives(F.col("term"), F.col("_host"))).alias("at", "one"))
    spelled = value_of(rendered(F.col("one")), F.col("names"))
    whole = F.regexp_replace(spelled, r"\$\{[^{}]*\}", "")
    summed = F.array_contains("one", "+")
    value = F.when(summed, F.when(is_base_url(whole), normal_base(whole))).when(~F.contains(spelled, F.lit("${")), spelled)
    rows = rows.select("script_id", "ord", "at", value.alias("value"), F.concat(F.lit("object."), "name").alias("source")).filter("value <> ''")
    return first_wins(rows, ["script_id", "value"], ["ord", "at"]).select("script_id", (F.col("ord") * 64 + F.least("at", F.lit(63))).alias("ord"), "value", "source")


__all__ = ["alternatives", "base_urls"]
