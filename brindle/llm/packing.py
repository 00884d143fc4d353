"""Bulk-synchronous best-fit packing of token sequences.

Documents are sorted into runs of equal length and gaps into runs of equal size, so what is sorted and matched has at most
``capacity`` lengths however many documents there are. The rounds go from long to short documents: a round takes the
lengths of one octave and deals the ranks of each of their runs, and those of the gaps, to lanes. Each lane sweeps its
sorted runs in a task of its own: documents of one length, longest first, take their successors among the gaps, the
smallest ones that hold them; documents that want the same gaps are told apart by their rank; the gaps they take shrink,
and what is left opens new sequences. The gaps of all lanes together are dealt anew to the next round, until no document
waits. Few documents have one lane, for which this is best fit decreasing; there are at most ``LANES``.

Which place a document has follows from its rank within its length: a hot length is ranked in every partition on its own,
shifted by the counts of the others.

Defined results: a null text counts as empty; an empty text is the end token alone. Rows that repeat a doc_id, or have
none, are documents of their own. Extra columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.bpe import CHUNK_BYTES, ForcedBoundaryBPE
from brindle.llm.common import Scratch, arrow_rows, gives_back, keep, parallelism
from brindle.llm.shingles import in_chunks

CAPACITY = 2048
#: Lanes of a round at most, and documents for which a further one is worth it.
LANES, LANE_DOCUMENTS = 32, 50_000
#: Bytes of text, and encoded words, that a worker holds where memory is short: after other stages an executor has little left.
SPARING_BYTES, SPARING_REMEMBERED = 1 << 18, 40_000
#: The token that ends a document.
END = b"\0\0\0\0"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Runs of a round: places of documents, then gaps (``used`` is their size, ``high`` their number).
_RUNS = "gap boolean, length long, low long, high long, first long, each long, used long"


def _cut(path: str, capacity: int, sparing: bool = False):
    chunk, remembered = (SPARING_BYTES, SPARING_REMEMBERED) if sparing else (CHUNK_BYTES, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ForcedBoundaryBPE.at(path)
        coder.remembered = remembered
        try:
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for at, texts in in_chunks(batch.column(1), chunk):
                    for doc, raw in zip(ids[at : at + len(texts)], coder.encode([t.decode() for t in texts]), strict=True):
                        raw += END
                        for piece, a in enumerate(range(0, len(raw), 4 * capacity)):
                            part = raw[a : a + 4 * capacity]
                            rows.append((doc, piece, a // 4, len(part) // 4, zlib.crc32(part)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _PIECES.split(", ")])
        finally:
            if sparing:  # workers are many and live on
                coder.forget()

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, sparing: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than ``capacity`` are cut, no others.

    ``sparing``: workers hold less text and fewer encoded words at once, for some more time; the rows are the same.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(gives_back(_cut(path, capacity, sparing)), _PIECES)


def sweep(waiting: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, opened: int) -> tuple[list[tuple[int, ...]], list[tuple[int, int, int]]]:
    """Best-fit placement of ``waiting`` runs (length, low rank, number) into ``gaps`` (size, first sequence, number).

    Returns places (length, low, high, first, each, used) and the gaps that are left. The document of rank r of its
    length, low <= r < high, goes to sequence ``first + (r - low) // each``, at ``used + (r - low) % each * length``. New
    sequences are numbered from ``opened``.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> runs of sequences (first, how many)
    sizes: list[int] = []
    places = []

    def put(size: int, first: int, many: int) -> None:
        if size and many:
            if not runs[size]:
                insort(sizes, size)
            runs[size].append((first, many))

    for size, first, many in gaps:
        put(size, first, many)
    for length, low, left in sorted(waiting, key=lambda w: (-w[0], w[1])):

        def place(size: int, first: int, many: int, length: int = length) -> None:
            nonlocal left, low
            each = size // length
            now = min(left, each * many)
            places.append((length, low, low + now, first, each, capacity - size))
            full, rest = divmod(now, each)
            put(size - each * length, first, full)
            if rest:
                put(size - rest * length, first + full, 1)
            put(size, first + full + (rest > 0), many - full - (rest > 0))
            left, low = left - now, low + now

        for size in sizes[bisect_left(sizes, length) :]:
            if not left:
                break
            held = runs.pop(size)
            sizes.remove(size)
            for i, (first, many) in enumerate(held):
                if not left:
                    for run in held[i:]:
                        put(size, *run)
                    break
                place(size, first, many)
        if left:
            many = -(-left // (capacity // length))
            place(capacity, opened, many)
            opened += many
    return places, [(size, first, many) for size in sizes for first, many in runs[size]]


def _lane(capacity: int, turn: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        free = group["gap"].to_numpy(bool)
        waiting = group.loc[~free, ["length", "low", "high"]].astype(int).itertuples(index=False, name=None)
        gaps = group.loc[free, ["used", "first", "high"]].astype(int).sort_values(["used", "first"]).itertuples(index=False, name=None)
        opened = (turn << 56) | (int(group["lane"].iloc[0]) << 40)
        places, left = sweep([(n, low, high - low) for n, low, high in waiting], list(gaps), capacity, opened)
        rows = [(False, *p) for p in places] + [(True, 0, 0, many, first, 0, size) for size, first, many in left]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _RUNS.split(", ")])

    return run


def _dealt(runs: DataFrame, lanes: int, start: str, end: Column) -> DataFrame:
    """``runs`` with ``lane``: each lane has an equal share of the numbers from ``start`` to ``end`` of each."""
    many = end - F.col(start)
    rows = runs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    low, high = F.floor(many * F.col("lane") / lanes), F.floor(many * (F.col("lane") + 1) / lanes)
    return rows.withColumn("_low", F.col(start) + low).withColumn("_many", high - low).filter("_many > 0")


def rounds(s: Scratch, counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places of the runs ``counts`` (length, n): (length, low, high, first, each, used), see ``sweep``."""
    spark = s.spark
    octave = F.floor(F.log2(F.lit(float(capacity - 1)) / F.col("length"))).cast("int")
    waiting = s.keep(counts.withColumn("octave", octave), "waiting")
    sizes = {r["octave"]: r["n"] for r in waiting.groupBy("octave").agg(F.sum("n").alias("n")).collect()}  # a row per octave
    gaps = spark.createDataFrame([], _RUNS)
    placed = gaps.drop("gap")
    for turn, k in enumerate(sorted(sizes)):
        lanes = max(1, min(LANES, parallelism(spark), sizes[k] // LANE_DOCUMENTS))
        runs = waiting.filter(F.col("octave") == k).select("length", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))
        runs = _dealt(runs, lanes, "low", F.col("high")).select(
            "lane", F.lit(False).alias("gap"), "length", F.col("_low").alias("low"), (F.col("_low") + F.col("_many")).alias("high"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("used"))
        free = _dealt(gaps, lanes, "first", F.col("first") + F.col("high")).select(
            "lane", "gap", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("low"), F.col("_many").alias("high"), F.col("_low").alias("first"), "used")
        done = s.keep(runs.unionByName(free).groupBy("lane").applyInPandas(_lane(capacity, turn), _RUNS), f"round{turn}")
        gaps = done.filter("gap")
        placed = placed.unionByName(done.filter("not gap").drop("gap"))
    return placed


def _ranked(items: DataFrame) -> DataFrame:
    """``items`` (kept, with _part and _row) with ``rank`` of each among those of its length, from 0."""
    per = items.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = per.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row")) - 1
    return items.withColumn("_own", own).join(shift, ["length", "_part"]).withColumn("rank", F.col("_before") + F.col("_own"))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` with sequence_id and offset; ``length`` is from 1 to ``capacity``."""
    columns = items.columns
    with Scratch(items.sparkSession) as s:
        sort = items.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
        with arrow_rows(s.spark):
            sort = s.keep(sort, "pieces")
        whole = sort.filter(F.col("length") == capacity)
        parts = sort.filter(F.col("length") < capacity)
        # No more rows than LANES times the places of a lane, which the capacity bounds, whatever the number of documents.
        plan = F.broadcast(rounds(s, parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")), capacity).withColumnRenamed("length", "_length"))
        step = F.col("rank") - F.col("low")
        at = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
        packed = _ranked(parts).join(plan, at).select(
            *columns, (F.col("first") + F.floor(step / F.col("each"))).alias("sequence_id"),
            (F.col("used") + step % F.col("each") * F.col("length")).alias("offset"))
        alone = whole.select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        return keep(packed.unionByName(alone), "packed")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, sparing: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece. ``sparing``: see ``token_pieces``."""
    return pack(token_pieces(docs, path, capacity, sparing), capacity)


__all__ = ["CAPACITY", "pack", "pack_documents", "rounds", "sweep", "token_pieces"]
