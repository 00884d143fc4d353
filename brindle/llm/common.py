"""What the corpus operators share: where intermediate tables go, joins with frequent keys, row keys, normalisation."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shingles import forget

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is frequent if more than one row in this many times the number of partitions has it ...
FREQUENT = 8
#: ... and more rows than these.
FEW_ROWS = 64


@cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="brindle-")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where it is unset, a local one if all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or _local_root()).rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/brindle-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; it goes when the application ends.

    Cuts lineage: a lost executor costs a reread of files, never a rerun of what came before.
    """
    spark = df.sparkSession
    kept = _written(df, f"{_own_folder(spark)}/{uuid.uuid4().hex}-{name}")
    at, files = _files(spark, _own_folder(spark))
    files.deleteOnExit(at)
    return kept


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files behind a kept table go now: executors delete them when the driver has collected what named them, which
    with little garbage in the driver is long after their last use."""
    spark._jvm.System.gc()


class Scratch:
    """Tables that are needed while a result is made. They go when the ``with`` block ends: the result is kept ahead of it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.places = spark, f"{_own_folder(spark)}/{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.places)}-{name}"
        kept = _written(df, path)
        self.places[path] = kept
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Tables that nothing reads any more."""
        for path, kept in self.places.items():
            if any(kept is f for f in frames):
                at, files = _files(self.spark, path)
                files.delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        at, files = _files(self.spark, self.folder)
        files.delete(at, True)


@contextmanager
def arrow_rows(spark: SparkSession, most: int = 1000) -> Iterator[None]:
    """Tables written in the block send at most ``most`` rows at a time to Python: whole texts are long, and a task holds
    a batch of them on both sides. The session's setting is as before afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """What a worker holds and doesn't need goes back to the system."""
    forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def gives_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; what they needed goes back to the system when the task ends. Workers live on for other tasks,
    and an executor's memory has to hold what all of them keep."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each key and in ``weight`` how many rows have that key.

    The rows of a frequent key are dealt to as many tasks as they need by a hash of ``spread``, and its facts are copied
    for each of them, so no key's rows meet in one task. Only the frequent keys are broadcast; there are fewer of them
    than ``FREQUENT`` times the number of partitions, whatever the data.
    """
    spark = rows.sparkSession
    total, top = facts.agg(F.sum(weight), F.max(weight)).collect()[0]
    most = max(FEW_ROWS, (total or 0) // (FREQUENT * parallelism(spark)))
    if not top or top <= most:
        return rows.join(facts, keys, how)
    pieces = F.ceil(F.col(weight) / most).cast("long")
    frequent = facts.filter(F.col(weight) > most).select(*keys, pieces.alias("_pieces"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_pieces")), F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(frequent), keys, "left").withColumn("_salt", salt).drop("_pieces")
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def row_key(doc_id: Column, sha: Column) -> Column:
    """A key of a document's row: its id (null is one of its own) and the SHA-256 of its text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(":"), F.hex(sha)).cast("binary"), 256))


def rows_with(docs: DataFrame, sha: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``keys`` (``_k``); of rows with the same key any one.

    Rows that repeat a key meet within each task first, so no key's rows meet in one.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    one = docs.select(whole, row_key(F.col("doc_id"), sha).alias("_k")).dropDuplicates(["_k"])
    return one.join(keys.select("_k"), "_k", "left_semi").select("_row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that for pure ASCII and is several times faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k`` (held-out folds)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def parallelism(spark: SparkSession) -> int:
    """Partitions for tables keyed by data: the session's shuffle setting, which a cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
