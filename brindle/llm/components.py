"""Connected components of a link table by alternating large-star and small-star rounds (DataFrame joins only).

Each round writes its edges to the shared folder, so the plan never grows and a lost executor costs one round at
most. The number of rounds grows with the logarithm of the longest chain. Nodes with many links are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, keep, split_join


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return row[0], row[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that each linked node reaches; roots point to themselves.

    Links from a node to itself and repeated links change nothing; links with a null end are left out.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
        "a is not null and b is not null and a <> b").distinct()
    with Scratch(links.sparkSession) as s:
        edges = s.keep(edges, "edges")
        before = _state(edges)
        while before[0]:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = s.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("w")), "least")
            large = split_join(both, least, ["a"], "w", ["b"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = s.keep(large.filter("a <> b").distinct(), "large")
            low = s.keep(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w")), "low")
            moved = split_join(large, low, ["a"], "w", ["b"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            after = s.keep(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
            s.drop(edges, least, large, low)
            edges, now = after, _state(after)
            if now == before:
                break
            before = now
        roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
        return keep(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "roots")


__all__ = ["components"]
