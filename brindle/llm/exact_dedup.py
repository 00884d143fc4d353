"""Exact deduplication by deterministic block naming (DataFrame functions only).

A normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and named by
integers; then neighbouring names are paired, distinct pairs are sorted and named, and so on until each
document is left with one name. Two texts have the same number of blocks and the same last name exactly
when they are equal, whatever any hash does: hashes only route rows, and a hash shared by two different
blocks is found by counting and resolved by comparing the blocks themselves. Names that many rows share (the blocks of
a text with many copies) are given to their rows in as many tasks as they need.

Defined results: a null text counts as empty, and empty texts are equal to each other. Rows that repeat a
doc_id are rows of their own; rows with a null doc_id too (a group of only these keeps a null keep_id).
Extra columns of the input are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import Scratch, keep, lower_ascii, row_key, rows_with, split_join

#: Bytes of a block. A document of n blocks takes log2(n) rounds of pairing.
BLOCK_BYTES = 4096


def _norm(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("_b"))


def _text() -> Column:
    return lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary")


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _blocks(norm: DataFrame, size: int, *carried: str) -> DataFrame:
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_b") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("_b", i * size + 1, F.lit(size)))
    return norm.select(*carried, count.alias("n"), F.posexplode(cut).alias("pos", "block"))


def _name(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names in the order of the sorted keys of each partition; they are kept at once, so each is given once."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(s: Scratch, norm: DataFrame, size: int, hashed: Callable[[str], Column]) -> DataFrame:
    """row, doc_id, sha, n, pos, name: the blocks of each row by their names."""
    # The only shuffle that carries text; equal blocks meet map-side first, so a hot block costs a row per task.
    distinct = _blocks(norm, size).groupBy("block").agg(F.count(F.lit(1)).alias("w")).withColumn("h", hashed("block"))
    names = s.keep(_name(distinct, ["block"]).select("h", "name", "w"), "names")
    per_hash = s.keep(names.groupBy("h").agg(F.min("name").alias("name"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("c")), "hashes")
    shared = per_hash.filter("c > 1").select("h")

    rows = norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", "_b", _sha(F.col("_b")).alias("sha"))
    parts = _blocks(rows, size, "row", "doc_id", "sha").withColumn("h", hashed("block"))
    columns = ["row", "doc_id", "sha", "n", "pos", "name"]
    if shared.isEmpty():
        parts = s.keep(parts.drop("block"), "parts")
        return split_join(parts, per_hash.select("h", "name", "w"), ["h"], "w", ["row", "pos"]).select(*columns)
    # Different blocks under one hash: these are told apart by their bytes, the n-th of them has the hash's n-th name.
    parts = parts.join(shared.withColumn("_same", F.lit(True)), "h", "left")
    parts = s.keep(parts.withColumn("block", F.when(F.col("_same"), F.col("block"))).drop("_same"), "parts")
    own = parts.filter("block is not null").groupBy("h", "block").agg(F.count(F.lit(1)).alias("w"))
    nth = F.row_number().over(Window.partitionBy("h").orderBy("block"))
    listed = names.join(shared, "h", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("name")))
    own = s.keep(own.withColumn("r", nth).join(listed.select("h", "r", "name"), ["h", "r"]).drop("r"), "apart")
    sure = per_hash.filter("c = 1").select("h", "name", "w")
    one = split_join(parts.filter("block is null").drop("block"), sure, ["h"], "w", ["row", "pos"]).select(*columns)
    return one.unionByName(split_join(parts.filter("block is not null"), own, ["h", "block"], "w", ["row", "pos"]).select(*columns))


def _identity(s: Scratch, docs: DataFrame, size: int, hashed: Callable[[str], Column]) -> DataFrame:
    level = s.keep(_named_blocks(s, _norm(docs), size, hashed).withColumn("m", F.col("n")), "level")
    facts = ["row", "doc_id", "sha", "n"]
    done, left = [s.keep(level.filter("n = 1").select(*facts, "name"), "whole")], 1
    longest = level.agg(F.max("n")).collect()[0][0] or 1
    while left < longest:
        left *= 2
        even, odd = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
        pairs = level.filter("m > 1").groupBy(*facts, "m", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = s.keep(pairs, "pairs")
        named = s.keep(_name(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), ["a", "b"]), "pair-names")
        half = F.ceil(F.col("m") / 2).cast("int")
        after = split_join(pairs, named, ["a", "b"], "w", ["row", "pos"]).select(*facts, "pos", "name", half.alias("m"))
        after = s.keep(after, "level")
        s.drop(level, pairs, named)
        level = after
        done.append(s.keep(level.filter("m = 1").select(*facts, "name"), "whole"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def block_identity(docs: DataFrame, size: int = BLOCK_BYTES, hashed: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """row (a number), doc_id, sha (SHA-256 of the text), n (blocks) and name: (n, name) is equal exactly for equal texts.

    One row per input row. ``hashed`` gives the hash of a column of blocks.
    """
    with Scratch(docs.sparkSession) as s:
        return keep(_identity(s, docs, size, hashed), "identity")


def exact_dedup(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row; the largest doc_id of equal texts stays.

    If rows repeat the doc_id that stays, each of them has ``kept``; ``dedup_rows`` keeps one of them.
    """
    with Scratch(docs.sparkSession) as s:
        named = s.keep(_identity(s, docs, size, F.xxhash64), "identity")
        groups = s.keep(named.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        found = split_join(named, groups, ["n", "name"], "group_size", ["row"])
        return keep(found.select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256")), "exact")


def dedup_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: one row of each text.

    That is the row with the largest doc_id. Ids don't decide alone: a row whose id stays for another text goes. Of rows
    that repeat both the id and the text that stay any one is kept; a text that has only rows without an id keeps one.
    """
    groups = exact_dedup(docs).select("keep_id", F.unhex("text_sha256").alias("sha")).distinct()
    stay = keep(groups.select(row_key(F.col("keep_id"), F.col("sha")).alias("_k")), "stay")
    return rows_with(docs, _sha(_text()), stay)


__all__ = ["BLOCK_BYTES", "block_identity", "dedup_rows", "exact_dedup"]
