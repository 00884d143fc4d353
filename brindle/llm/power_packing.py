"""Packing by powers of two: no padding, and no sequence crosses documents.

The tokens of a document (its end token included) are split into pieces whose lengths are the binary digits of its length:
as many of the longest length as it holds, then one for each further digit, from long to short. Pieces of equal length make
a bucket; each piece is a sequence of its own, so the sequences of a bucket stack to batches without padding and a batch
of any bucket has as many tokens as one of any other.

Each row is split on its own: no shuffle, and a long document is only cut. Sequence numbers are the piece's bucket in the
high bits and its place in the table in the low ones, so a bucket is a range of numbers.

Defined results: a null text counts as empty; an empty text is the end token alone, one piece of length 1. Rows that repeat
a doc_id, or have none, are documents of their own. Extra columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.byte_bpe import ByteLevelBPE
from brindle.llm.common import parallelism
from brindle.llm.shingles import in_chunks

CAPACITY = 1024
#: The token that ends a document.
END = b"\0\0\0\0"
#: Bytes of text that are encoded together.
CHUNK_BYTES = 1 << 22

_KINDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def powers(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """Where the pieces of ``n`` tokens begin and how long they are; ``capacity`` is a power of two."""
    at = 0
    while n - at >= capacity:
        yield at, capacity
        at += capacity
    size = capacity
    while at < n:
        size >>= 1
        if n - at >= size:
            yield at, size
            at += size


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteLevelBPE.at(path)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, texts in in_chunks(batch.column(1), CHUNK_BYTES):
                rows, ids = [], []
                for doc, raw in zip(docs[first : first + len(texts)], coder.encode([t.decode() for t in texts]), strict=True):
                    raw += END
                    n = len(raw) // 4
                    for at, size in powers(n, capacity):
                        part = raw[4 * at : 4 * (at + size)]
                        rows.append((doc, at, size, zlib.crc32(part), n))
                        if with_ids:
                            ids.append(pa.array(memoryview(part).cast("I"), pa.int32()))
                columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
                out = {name: pa.array(c, kind) for c, (name, kind) in zip(columns, _KINDS.items(), strict=True)}
                if with_ids:
                    ends = [0]
                    for x in ids:
                        ends.append(ends[-1] + len(x))
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(ids) if ids else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def bucket(length: Column) -> Column:
    """The binary logarithm of a power of two."""
    return F.length(F.bin(length)) - 1


def power_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset: a row per piece, with ``ids`` if wanted."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"capacity must be a power of two, not {capacity}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = rows.mapInArrow(_cut(path, capacity, with_ids), _PIECES + (", ids array<int>" if with_ids else ""))
    number = F.shiftleft(bucket(F.col("length")).cast("long"), 58) + F.monotonically_increasing_id()
    return pieces.select("*", bucket(F.col("length")).alias("bucket"), number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(docs: DataFrame, path: str, folder: str, capacity: int = CAPACITY) -> None:
    """The sequences with their ids as Parquet, a folder per bucket; full sequences, the bulk, are dealt over all tasks."""
    found = power_sequences(docs, path, capacity, with_ids=True)
    found.repartition(parallelism(docs.sparkSession), "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parallelism(docs.sparkSession)))).write.partitionBy("bucket").parquet(folder)


__all__ = ["CAPACITY", "bucket", "power_sequences", "powers", "write_buckets"]
