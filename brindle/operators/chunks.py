"""Files that a loader joins from quoted parts, names and tables of chunks: ``"a/" + e + "." + {"c1": "h1"}[e] + ".js"``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.matches import record
from brindle.operators.callgraph import closing, entries, split
from brindle.operators.order import first_wins

# What files are recognised by, and how a loader's expression is named by the place where it stands.
SHAPE = r"\.(?:js|css|mjs|map)\z|(?i:(?:assets?|static|chunks?)/)"
SOURCES = {"return": "webpack-runtime-return", "assigned": "webpack-runtime-assignment", "member": "webpack-runtime-assignment", "constant": "webpack-runtime-variable"}


def _static(part: Column) -> Column:
    t = F.get(part, F.lit(0))
    return F.when((F.size(part) == 1) & t.rlike("^[\"']"), F.substring(t, F.lit(2), F.char_length(t) - 2))


def _joined(parts: Column, start: Column, end: Column) -> Column:
    """The quoted ones of the parts from ``start`` to ahead of ``end``."""
    return F.array_join(F.transform(F.slice(parts, start + 1, F.greatest(end - start, F.lit(0))), lambda p: F.coalesce(_static(p), F.lit(""))), "")


def chunk_files(facts: DataFrame) -> DataFrame:
    """script_id, ord, url, type, chunk_name, source: a file for each entry of a table in a sum of three parts at least.

    The chunk's name stands where the nearest part ahead of the table is no text, its hash where the table is. The first of
    each type, url and name stays. ``facts``: see ``callgraph.facts``.
    """
    has = lambda s: F.array_contains("term", s)
    rows = facts.filter(F.col("kind").isin(*SOURCES) & has("+") & has("{") & has("[") & ~has("=>") & F.coalesce(F.col("up") != F.col("pos"), F.lit(True)))
    source = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))[F.col("kind")]
    rows = rows.select("script_id", "pos", source.alias("source"), split(F.col("term"), "+").alias("p")).filter(F.size("p") > 2)

    def table(part: Column, i: Column) -> Column:
        end = closing(part)
        indexed = (F.get(part, F.lit(0)) == "{") & (F.get(part, end + 1) == "[") & (F.get(part, F.size(part) - 1) == "]")
        found = F.filter(entries(F.slice(part, F.lit(1), F.coalesce(end, F.lit(0)) + 1)), lambda e: _static(e["term"]).isNotNull())
        return F.when(indexed, record(i=i, values=F.transform(found, lambda e: record(chunk=e["key"], hash=_static(e["term"])))))

    rows = rows.select("script_id", "pos", "source", "p", F.explode(F.filter(F.transform("p", table), lambda t: t.isNotNull())).alias("t"))
    free = F.filter(F.sequence(F.lit(0), F.greatest(F.col("t.i") - 1, F.lit(0))), lambda j: (j < F.col("t.i")) & _static(F.get("p", j)).isNull())
    slot = F.coalesce(F.array_max(free), F.col("t.i"))
    rows = rows.withColumn("_slot", slot)
    rows = rows.select("script_id", "pos", "source", "t", _joined(F.col("p"), F.lit(0), F.col("_slot")).alias("_a"), _joined(F.col("p"), F.col("_slot") + 1, F.col("t.i")).alias("_b"), _joined(F.col("p"), F.col("t.i") + 1, F.size("p")).alias("_c"))
    rows = rows.filter(F.concat("_a", "_b", "_c").rlike(SHAPE)).select("*", F.posexplode("t.values").alias("at", "v"))
    kind = F.when(F.col("_c").rlike(r"\.m?js\z"), "script").when(F.endswith("_c", F.lit(".css")), "style").otherwise("asset")
    rows = rows.select("script_id", (F.col("pos").cast("long") * 100_000 + F.col("t.i") * 10_000 + F.col("at")).alias("ord"), F.concat("_a", "v.chunk", "_b", "v.hash", "_c").alias("url"), kind.alias("type"), F.col("v.chunk").alias("chunk_name"), "source")
    return first_wins(rows, ["script_id", "type", "url", "chunk_name"], "ord")


__all__ = ["chunk_files"]
