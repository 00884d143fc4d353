"""Order-keeping operators: first wins, last wins, capped ranking, batches and rate-limited starts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def worked_out(rows: DataFrame) -> DataFrame:
    """``rows``, worked out once: checkpointed where the session names a folder for it, else persisted."""
    context, folder = rows.sparkSession.sparkContext, rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return rows.checkpoint() if folder else rows.persist(StorageLevel.MEMORY_AND_DISK)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as the session's shuffle setting says. Spark joins shuffled partitions that are small, as
    they lie compressed, to few tasks; here each stays a task of its own, whatever a row costs, and a table of one file is spread too."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), *keys)


def first_wins(rows: DataFrame, keys: list, order: Column | str) -> DataFrame:
    """Of rows with equal keys (nulls are equal) the first by ``order`` stays."""
    w = Window.partitionBy(*keys).orderBy(*_list(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The latest row of each key, without a sort: the largest struct."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x"))
    return latest.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def capped(rows: DataFrame, within: str, order: list, per_type: int = 80, per_category: int = 200, total: int = 1000) -> DataFrame:
    """Greedy caps in ``order``: for each category and type, each category, and in all of ``within``.

    Three rankings one after another take the same rows as a loop that counts accepted rows.
    """
    for keys, most in ((["category", "type"], per_type), (["category"], per_category), ([], total)):
        w = Window.partitionBy(within, *keys).orderBy(*order)
        rows = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    return rows


def batches(rows: DataFrame, within: list[str], order: list, size: int) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def rate_limited(rows: DataFrame, within: list[str], arrived: str, order: list, gap: int) -> DataFrame:
    """``start``: in order, at arrival but never less than ``gap`` after the start before."""
    w = Window.partitionBy(*within).orderBy(*order)
    n = F.row_number().over(w)
    rows = rows.withColumn("_n", n).withColumn("_lead", F.col(arrived) - F.col("_n") * gap)
    top = F.max("_lead").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", top + F.col("_n") * gap).drop("_n", "_lead")


def newest(rows: DataFrame, order: list, most: int = 1000) -> DataFrame:
    """The newest ``most`` rows: each task keeps as many at most before they meet."""
    return rows.orderBy(*order).limit(most)


__all__ = ["batches", "capped", "dealt", "first_wins", "last_by", "newest", "rate_limited", "worked_out"]
