r"""Collocations: phrases of two to four words that occur together more often than their parts apart.

Each task counts its texts into tries of bounded depth, whose level d has a node for each phrase of d words, and writes them
out as sorted lists of phrases whenever they have grown to a set size. The lists of all tasks are dealt by prefix ranges, in each of
which the lists are merged and equal phrases summed, so a frequent prefix is many ranges.

Only phrases with ``LEAST`` occurrences matter, and no phrase occurs more often than its parts. So two passes go ahead of the
tries: the words, then the pairs of frequent words, are counted by 64-bit hashes. What is frequent is told to the next pass
as a set of bits of fixed size (``FILTER_BITS``): a bit too many, or a hash that two share, costs time, never a result, since the
tries count phrases themselves.

The counts of a phrase's left parts are those of its ancestors in the trie: one walk over the sorted phrases, which holds
the path from the root only. Those of its right parts are its suffix links: the same walk over the phrases sorted from
their last words. A range begins below ancestors that the range before it holds; these, at most three for each range, are
looked up afterwards.

Defined results: a null text counts as empty, a null language as ``und``. Ids aren't looked at: rows that repeat one are texts
like others, so their words count again. Ties in score and count are in the byte order of the phrases. Extra columns change
nothing. An empty table gives an empty result. A text of any length is counted whole: what is cut off when a task's tries are
full begins the next ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import Scratch, arrow_rows, keep, parallelism
from brindle.llm.shingles import in_chunks, mix

#: Occurrences of a candidate at least, its words at most, rows of a language at most.
LEAST, LONGEST, TOP = 30, 4, 2000
#: Bits of the set of frequent words, and of that of frequent pairs (binary logarithm).
FILTER_BITS = 25
#: Words, and bytes of distinct words, that a task counts into one set of tries.
FLUSH_WORDS, FLUSH_BYTES = 3 << 19, 40 << 20
#: Bytes of text that are cut into words together.
CHUNK_BYTES = 1 << 21
#: Words that aren't frequent, as far as a task remembers them.
_RARE = 150_000
_ENTRY = 150

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes(10 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK, _NOTHING = -1, -2
_ROWS, _HASHED = "lang string, depth int, phrase string, f long", "lang string, h long, f long"


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = (hashes & np.uint64((len(bits) << 3) - 1)).astype(np.int64)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one * np.uint64(0x9E3779B97F4A7C15) + two)


class _Ids(dict):
    """Numbers of the words of one language in order of appearance; what isn't frequent breaks phrases."""

    def __init__(self, seed: int, frequent: bytes | None):
        self.seed, self.frequent, self.names, self.hashes, self.held, self.rare = seed, frequent, [], [], 0, 0
        self[b"\n"], self[b""] = _BREAK, _NOTHING

    def __missing__(self, word: bytes) -> int:
        hashed, bits = xxhash.xxh64_intdigest(word, self.seed), self.frequent
        if bits is not None and not bits[hashed % (len(bits) << 3) >> 3] >> (hashed & 7) & 1:
            if self.rare < _RARE:
                self.rare += 1
                self[word] = _BREAK
            return _BREAK
        self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(hashed)
        self.held += len(word) + _ENTRY
        return len(self.names) - 1


def levels(words: np.ndarray, names: list[bytes], low: int, high: int, end: int, hashes: np.ndarray | None = None, pairs: np.ndarray | None = None) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """The trie's levels ``low`` to ``high``: phrases in order and how often each begins ahead of ``end``.

    ``words`` are numbers of ``names``, negative ones break phrases. A phrase has a node if its own parts have one; pairs that
    aren't in the set ``pairs`` have none.
    """
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.full(len(names) + 1, _BREAK, np.int64)
    rank[order] = np.arange(len(names))
    words = rank[np.where(words < 0, len(names), words)]
    names = [names[i] for i in order]
    node, phrases = words, names
    for depth in range(1, high + 1):
        if depth == 1:
            at = np.flatnonzero(node >= 0)
            key, many = np.arange(len(names)), np.bincount(node[at[at < end]], minlength=len(names))
        else:
            at = np.flatnonzero((node[:-1] >= 0) & (node[1:] >= 0))
            if depth == 2 and pairs is not None and len(at):
                own = hashes[order]
                at = at[_has(pairs, _pair(own[words[at]], own[words[at + 1]]))]
            keys = node[at] * len(names) + words[at + depth - 1]
            if depth == high:  # nothing is below
                key, many = np.unique(keys[at < end], return_counts=True)
            else:
                key, inner = np.unique(keys, return_inverse=True)
                many = np.bincount(inner[at < end], minlength=len(key))
                node = np.full(len(words), _BREAK, np.int64)
                node[at] = inner
            parent, last = np.divmod(key, max(1, len(names)))
            phrases = [phrases[a] + b" " + names[b] for a, b in zip(parent.tolist(), last.tolist(), strict=True)]
        if depth >= low:
            some = np.flatnonzero(many)
            yield depth, phrases if len(some) == len(phrases) else [phrases[i] for i in some.tolist()], many[some]


def hashed(words: np.ndarray, hashes: np.ndarray, depth: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, or pairs of words, that begin ahead of ``end``, in order, and how often each does."""
    if depth == 1:
        many = np.bincount(words[:end][words[:end] >= 0], minlength=len(hashes))
        some = np.flatnonzero(many)
        order = some[np.argsort(hashes[some])]
        return hashes[order], many[order]
    at = np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0))
    at = at[at < end]
    return np.unique(_pair(hashes[words[at]], hashes[words[at + 1]]), return_counts=True)


class _Shard:
    """The words of one language that a task hasn't counted yet: to be hashed up to depth 1 or 2, or counted in tries."""

    def __init__(self, lang: str, depth: int, frequent: bytes | None, pairs: np.ndarray | None):
        self.lang, self.depth, self.frequent, self.pairs = lang, depth, frequent, pairs
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.start([])

    def start(self, carried: list[bytes]) -> None:
        self.ids, self.size = _Ids(self.seed, self.frequent), len(carried)
        self.parts = [np.array([self.ids[w] for w in carried], np.int32)]

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        """Count a text, cut at spaces into pieces of bounded size."""
        text, at = text.translate(_PLAIN), 0
        while at < len(text):
            end = text.find(b" ", at + CHUNK_BYTES)
            end = len(text) if end < 0 else end
            cut = text[at:end].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.ids.__getitem__, cut), np.int32, len(cut))
            self.parts.append(found[found != _NOTHING])
            self.size += len(self.parts[-1])
            at = end
            if self.size > FLUSH_WORDS or self.ids.held > FLUSH_BYTES:
                yield from self.flush(False)
        self.parts.append(np.array([_BREAK], np.int32))
        self.size += 1

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        words, names, hashes = np.concatenate(self.parts), self.ids.names, np.array(self.ids.hashes, np.uint64)
        end = len(words) if last else max(0, len(words) - self.depth + 1)  # what begins in the rest is counted next time
        if self.depth < LONGEST:
            found, many = hashed(words, hashes, self.depth, end)
            whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(self.lang), len(found)), pa.array(found.view(np.int64)), pa.array(many, pa.int64())], names=["lang", "h", "f"])
            yield from (whole.slice(i, 100_000) for i in range(0, len(found), 100_000))
            if self.depth == 1:  # all words, without a hash
                yield pa.RecordBatch.from_arrays([pa.array([self.lang]), pa.array([None], pa.int64()), pa.array([int((words[:end] >= 0).sum())], pa.int64())], names=["lang", "h", "f"])
        else:
            for depth, phrases, many in levels(words, names, 1, LONGEST, end, hashes, self.pairs):
                columns = [pa.repeat(pa.scalar(self.lang), len(phrases)), pa.repeat(pa.scalar(depth, pa.int32()), len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(many, pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, names=["lang", "depth", "phrase", "f"])
                yield from (whole.slice(i, 100_000) for i in range(0, len(phrases), 100_000))
        self.start([names[i] if i >= 0 else b"\n" for i in words[end:].tolist()])


def _count(depth: int, frequent: Broadcast | None, pairs: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = None if frequent is None else frequent.value, None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        shards: dict[str, _Shard] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in in_chunks(batch.column(1), CHUNK_BYTES):
                own: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[first : first + len(texts)], texts, strict=True):
                    own.setdefault(lang, []).append(text)
                for lang, some in own.items():
                    if lang not in shards:
                        shards[lang] = _Shard(lang, depth, *sets)
                    yield from shards[lang].add(b"\n".join(some))
                while sum(t.size for t in shards.values()) > FLUSH_WORDS or sum(t.ids.held for t in shards.values()) > FLUSH_BYTES:
                    yield from shards.pop(max(shards, key=lambda lang: shards[lang].ids.held + shards[lang].size)).flush(True)
        for t in shards.values():
            yield from t.flush(True)

    return run


def _bits(found: DataFrame) -> Broadcast:
    """The set of hashes ``h``: ``2 ** FILTER_BITS`` bits, whatever their number."""
    slot = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    parts = found.select(slot.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("bits"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in parts.toLocalIterator():
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = r["bits"]
    return found.sparkSession.sparkContext.broadcast(bytes(out))


def frequent_phrases(s: Scratch, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, depth, phrase, f of the phrases (and words) of ``texts`` (lang, text) with ``LEAST`` occurrences; lang, n: its words."""
    with arrow_rows(s.spark, 500):  # whole texts go to Python
        hashes = texts.mapInArrow(_count(1, None, None), _HASHED).groupBy("h", "lang").agg(F.sum("f").alias("f"))
        words = s.keep(hashes.filter(F.col("h").isNull() | (F.col("f") >= LEAST)), "words")
        frequent = _bits(words.filter("h is not null"))
        hashes = texts.mapInArrow(_count(2, frequent, None), _HASHED).groupBy("h").agg(F.sum("f").alias("f"))
        together = _bits(s.keep(hashes.filter(F.col("f") >= LEAST), "pairs"))
        lists = s.keep(texts.mapInArrow(_count(LONGEST, frequent, together), _ROWS), "lists")
    ranges = lists.repartitionByRange(parallelism(s.spark), "phrase", "lang")
    merged = ranges.groupBy("phrase", "lang").agg(F.max("depth").alias("depth"), F.sum("f").alias("f")).filter(F.col("f") >= LEAST)
    found = s.keep(merged.select("lang", "depth", "phrase", "f"), "phrases")
    s.drop(lists)
    return found, words.filter("h is null").select("lang", F.col("f").alias("n"))


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``parts`` of sorted phrases: the counts of their ancestors, from the root; null if the range began below one."""
    path, counts, before = [], [], None
    for batch in batches:
        parts = []
        for lang, words, f in zip(batch.column("lang").to_pylist(), batch.column("_key").to_pylist(), batch.column("f").to_pylist(), strict=True):
            shared = 0
            if lang == before:
                for a, b in zip(path, words[:-1], strict=False):
                    if a != b:
                        break
                    shared += 1
            counts = [*counts[:shared], *[None] * (len(words) - 1 - shared), f]
            path, before = words, lang
            parts.append(counts[:-1])
        yield batch.append_column("_parts", pa.array(parts, pa.list_(pa.int64())))


def with_parts(s: Scratch, found: DataFrame, name: str, backwards: bool) -> DataFrame:
    """``found`` with the array ``name``: the counts of the first one, two, ... words of each phrase, or of the last ones."""
    words = F.split("phrase", " ")
    keyed = found.withColumn("_key", F.reverse(words) if backwards else words)
    ranges = keyed.repartitionByRange(parallelism(s.spark), "lang", "_key").sortWithinPartitions("lang", "_key")
    schema = ranges.withColumn("_parts", F.array().cast("array<long>")).schema
    walked = s.keep(ranges.mapInArrow(_climb, schema), f"walk-{name}")
    done = walked
    for k in range(1, LONGEST):  # an ancestor of k words that a range lacks: one for each range at most
        lacks = walked.filter((F.size("_parts") >= k) & F.get("_parts", k - 1).isNull()).select("lang", F.slice("_key", 1, k).alias("_above")).distinct()
        above = keyed.filter(F.size("_key") == k).select("lang", F.col("_key").alias("_above"), F.col("f").alias(f"_f{k}"))
        facts = F.broadcast(above.join(F.broadcast(lacks), ["lang", "_above"], "left_semi"))
        done = done.withColumn("_above", F.slice("_key", 1, k)).join(facts, ["lang", "_above"], "left").drop("_above")
    filled = F.transform("_parts", lambda f, i: F.coalesce(f, F.get(F.array(*(F.col(f"_f{k}") for k in range(1, LONGEST))), i)))
    return done.select(*found.columns, filled.alias(name))


def _exact(count: Column) -> Column:
    return count.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    if least != LEAST:
        raise ValueError("phrases are counted from LEAST occurrences")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    with Scratch(spark) as s:
        found, totals = frequent_phrases(s, texts)
        found = with_parts(s, with_parts(s, found, "left", False), "right", True)

        def cut(k: Column) -> Column:
            left, right = F.get("left", k - 1), F.get("right", F.col("depth") - k - 1)
            score = F.call_function("div", _exact(F.col("f")) * F.lit(2_000_000).cast("decimal(7,0)"), _exact(left) + _exact(right))
            return F.struct(score.cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

        scored = found.filter("depth > 1").withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), F.col("depth") - 1), cut)))
        scored = s.keep(scored.select("lang", "depth", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"), "scored")
        parts = F.split("phrase", " ")
        inside = F.array(F.array_join(F.slice(parts, F.lit(1), F.col("depth") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("depth") - 1), " "))
        # a longer candidate that is frequent enough has one with a single word more that is at least as frequent
        around = scored.filter("depth > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (_exact(F.col("most")) * 100 < _exact(F.col("a")) * 80))
        by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        salt = F.pmod(F.xxhash64("phrase"), F.lit(parallelism(spark)))
        first = kept.withColumn("_salt", salt).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*by))).filter(F.col("_n") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= top)
        return keep(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")


__all__ = ["collocations", "frequent_phrases", "levels", "with_parts"]
