"""N-gram Jaccard join by PartEnum signatures.

Sets of similar size are compared at one level. A level's feature domain is cut into ``n1`` first-level partitions of
``N2`` second-level ones each, and every subset of ``N2 - K2`` second-level partitions of a first-level partition is
a signature: the hash of the features of the set that fall in it. Two sets that differ in ``d`` features differ in at
most ``d`` second-level partitions, so with J >= 3/4 (``d`` at most a third of either set) they share a signature.

With two second-level partitions of which one is left out, the smallest setting, a subset is a single partition.

Signatures are counted over the whole corpus, and each set looks only at its ``k + 1`` rarest ones: of its ``n``
signatures at most ``k`` differ from those of a partner, so the first common one in that order is among them. A set
with more than ``k`` signatures of its own has no partner at all; passages that thousands of documents share cost
nothing that way, and no signature list is capped. A subset without features is a signature too, but only sets with at
most ``k`` filled partitions send those. The partners of such a set may send their filled ones alone, so beside its
``k + 1`` rarest it looks at all its filled ones: one of these is among the rarest ones of any such partner.

What is left are candidates. Equal sets are one class from the start. Each class is first checked against one centre
(the class with which it shares most signatures), linked classes are merged, and only lists that still hold different
components go on. Short lists are compared pair by pair. The classes of longer ones are dealt to blocks, and two blocks
that share such a list are compared in one task that returns no more links than connect what they connect; so a group
of thousands of near copies costs a row per copy and block, never a row per pair. Every comparison is of whole sets.

Signatures of a passage that a large share of the documents has would meet in one bucket. While sets are made, each task
counts the frequent ones among its signatures (Misra and Gries); those that the sums can't rule out, a number bounded by
the partitions alone, are dealt by set instead, and joins by a signature or a centre split the frequent keys.

Defined results: a null text counts as empty; texts without words have no shingles and link with nothing. Rows that
repeat a doc_id are rows of their own. Rows with a null doc_id get their ``n_shingles`` and a null ``component_id`` and
link nothing; ``drop_near_copies`` keeps them all. Of rows that repeat both id and text it keeps one. Extra columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import Scratch, arrow_rows, drop_shuffles, gives_back, keep, parallelism, release, row_key, rows_with, split_join
from brindle.llm.components import components
from brindle.llm.shingles import in_chunks, mix, shingle_sets

#: Linked at 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Second-level partitions of a first-level one, and how many of them a signature leaves out.
N2, K2 = 2, 1
#: Class ids up to this many (16 MB) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits by which sets and signatures are named while they meet by signature. Sets that happen to have one name look at each
#: other's signatures besides their own; signatures that do are one signature to every set.
NAME_BITS = 48
#: Numbers of 64 bits in which a set's parities are kept.
PARITIES = 8
#: Classes and signatures up to this many are broadcast to sets and lists; more are joined by a shuffle.
FEW_KEYS = 100_000
#: Classes of a block whose pairs one task compares.
BLOCK = 256
#: A signature is frequent if more than one in this many times the number of partitions of all signatures are it.
FREQUENT = 16
#: Signature lists of up to this many classes are compared pair by pair, longer ones block by block.
SHORT_LIST = 24

_U = np.uint64


def level_of(n: int) -> int:
    """Level L takes sets of up to 4 * 2**L features."""
    return max(0, (max(n, 1) - 1).bit_length() - 2)


def levels_of(n: int) -> list[int]:
    """The level of a set and, if its smallest partner lies one below, that one too."""
    own = level_of(n)
    return [own] if own == 0 or level_of(-(-3 * n // 4)) == own else [own, own - 1]


def first_partitions(level: int) -> int:
    return (1 << level) + 3


def _ones(level: int) -> int:
    return first_partitions(level) * N2


def most_different(n: int) -> int:
    """Features in which a set of ``n`` and a linked one can differ."""
    return n // 3


def signatures(features: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """Signatures of a sorted set at a level and how many of them, the first ones, are of subsets with features.

    Those of subsets without features are added only where the others may not do. They have ``NAME_BITS`` bits.
    """
    count = _ones(level)
    part = ((features >> _U(32)) * _U(count)) >> _U(32)
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(mix(features ^ _U(0xA0761D6478BD642F)), heads)
    filled = part[heads]
    where, what = filled, sums  # with N2 = 2 and K2 = 1 each subset is one second-level partition
    if len(filled) <= most_different(len(features)):
        missing = np.setdiff1d(np.arange(count, dtype=_U), filled)
        where, what = np.concatenate([where, missing]), np.concatenate([what, np.zeros(len(missing), _U)])
    return mix(what ^ mix(where + _U((level + 1) << 40))) >> _U(64 - NAME_BITS), len(filled)


def _numbers(sig: np.ndarray, filled: int) -> tuple[int, int]:
    """How many signatures a set has, all and filled ones. Two that happen to have one name count once."""
    n = len(np.unique(sig))
    return n, filled - (len(sig) - n)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits: names in order have buckets in order."""
    return (((names >> _U(NAME_BITS - 32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _packed(names: np.ndarray) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : NAME_BITS // 8].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) * 8 // NAME_BITS, 8), np.uint8)
    wide[:, : NAME_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, NAME_BITS // 8)
    return wide.reshape(-1).view("<u8")


def _name(digest: int) -> int:
    """Under which name a set sends its signatures."""
    return digest & ((1 << NAME_BITS) - 1)


def _digest(features: np.ndarray) -> tuple[int, int]:
    one = mix(features).sum(dtype=_U)
    two = mix(features ^ _U(0xE7037ED1A0B428DB)).sum(dtype=_U)
    both = mix(np.array([one + _U(len(features)), two ^ _U(len(features))]))
    return int(both[0].astype(np.int64)), int(both[1].astype(np.int64))


class _Frequent:
    """The most frequent of a stream of numbers; counts are too low by the length of the stream over ``size`` at most."""

    def __init__(self, size: int):
        self.size, self.seen = size, 0
        self.key, self.n, self.waiting = np.empty(0, _U), np.empty(0, np.int64), []

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.seen += len(values)
        if sum(map(len, self.waiting)) > 8 * self.size:
            self.settle()

    def settle(self) -> None:
        key, n = np.unique(np.concatenate([np.empty(0, _U), *self.waiting]), return_counts=True)
        self.waiting = []
        key, at = np.unique(np.concatenate([self.key, key]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([self.n, n]), minlength=len(key)).astype(np.int64)
        if len(key) > self.size:
            n -= np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1]
        self.key, self.n = key[n > 0], n[n > 0]


_FACTS = ("doc_id long, sha binary, n long, d1 long, d2 long, own int, own_n long, own_f long, low int, low_n long, low_f long, "
          "frequent array<long>, times array<long>")


def _facts(partitions: int):
    """Size and digest of each document's set and the number of its signatures at its levels, all and filled ones.

    A task's last row (``n`` is -1) has its frequent signatures.
    """
    names = [x.split()[0] for x in _FACTS.split(", ")]
    kinds = [*[pa.int64()] * 3, *[pa.int32(), pa.int64(), pa.int64()] * 2, *[pa.list_(pa.int64())] * 2]

    def batch_of(ids: pa.Array, sha: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([ids, sha, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Frequent(max(1 << 15, 4 * FREQUENT * partitions))
        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for _, texts in in_chunks(batch.column(2)):
                    for s in shingle_sets(texts):
                        if not len(s):
                            rows.append((0, 0, 0, -1, 0, 0, -1, 0, 0, None, None))
                            continue
                        made = [(level, *signatures(s, level)) for level in levels_of(len(s))]
                        for _, sig, _ in made:
                            counted.add(sig)
                        per = [*((level, *_numbers(sig, filled)) for level, sig, filled in made), (-1, 0, 0)]
                        rows.append((len(s), *_digest(s), *per[0], *per[1], None, None))
            yield batch_of(batch.column(0), batch.column(1), rows)
        counted.settle()
        some = counted.n >= max(2, counted.seen // (2 * FREQUENT * partitions))
        if some.any():
            row = (-1, 0, 0, -1, 0, 0, -1, 0, 0, counted.key[some].astype(np.int64), counted.n[some])
            yield batch_of(pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), [row])

    return run


#: Levels are less than this.
_EMPTY = 128


def _emit(buckets: int, frequent: np.ndarray):
    """Signatures of a run of documents, dealt to buckets by their high bits: a row for each run and bucket.

    Each signature has the name of its set beside it, so it costs as many bytes among many buckets as among few.
    ``frequent`` ones (sorted) go to negative buckets by their sets instead. Levels have ``_EMPTY`` added where the
    signature is of a subset without features. A run whose texts repeat sends each of its distinct sets once.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                for _, texts in in_chunks(batch.column(0), 1 << 22):
                    seen, sigs, sizes, levels = set(), [], [], []
                    names = []
                    for s in (x for _, part in in_chunks(pa.array(texts, pa.binary())) for x in shingle_sets(part)):
                        if not len(s) or (digest := _digest(s)[0]) in seen:
                            continue
                        seen.add(digest)
                        for level in levels_of(len(s)):
                            sig, filled = signatures(s, level)
                            sigs.append(sig)
                            sizes.append(len(sig))
                            names.append(_name(digest))
                            levels.append(np.full(len(sig), level, np.uint8))
                            levels[-1][filled:] |= np.uint8(_EMPTY)
                    if not sigs:
                        continue
                    sig, level, who = np.concatenate(sigs), np.concatenate(levels), np.repeat(np.array(names, _U), sizes)
                    bucket = _bucket(sig, buckets)
                    if len(frequent):
                        hot = np.flatnonzero(frequent[np.minimum(np.searchsorted(frequent, sig), len(frequent) - 1)] == sig)
                        bucket[hot] = -1 - _bucket(who[hot], buckets)
                    order = np.lexsort((sig, bucket)) if len(frequent) else np.argsort(sig)
                    sig, level, who, bucket = sig[order], level[order], who[order], bucket[order]
                    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    ends = np.concatenate([heads[1:], [len(bucket)]])
                    out = [(int(bucket[a]), _packed(sig[a:b]), _packed(who[a:b]), level[a:b].tobytes())
                           for a, b in zip(heads.tolist(), ends.tolist(), strict=True)]
                    kinds = [pa.int32(), *[pa.binary()] * 3]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "sig", "sid", "level"])

    return emit


_POSTED = "sid long, level int, sig long, filled boolean, c long"


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket, the signatures that several sets have: a row for each set, with the number of sets.

    A bucket of frequent signatures has only some of their sets: all are returned, with 0 for the number.
    """
    sig, sid = (np.concatenate([_unpacked(x) for x in group[c]]) for c in ("sig", "sid"))
    level = np.concatenate([np.frombuffer(x, np.uint8) for x in group["level"]])
    frequent = group["bucket"].iloc[0] < 0
    order = np.argsort(sig, kind="stable")
    sig, sid, level = sig[order], sid[order], level[order]
    same = sig[1:] == sig[:-1]
    some = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | frequent
    found = pd.DataFrame({
        "sid": sid[some].astype(np.int64), "level": (level[some] % _EMPTY).astype(np.int32), "sig": sig[some].astype(np.int64), "filled": level[some] < _EMPTY})
    found = found.drop_duplicates()
    if frequent:
        return found.assign(c=0)
    found["c"] = found.groupby("sig")["sid"].transform("size").astype(np.int64)
    return found[found["c"] > 1]


def _shared_only(group: pd.DataFrame) -> pd.DataFrame:
    found = _shared(group)
    release()
    return found


def _parities(features: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of features in each of 64 * ``PARITIES`` cells: sets that differ in ``d`` features differ
    in at most ``d`` cells."""
    odd = np.bincount((features & _U(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d1, d2, sets, bits = [], [], [], []
        with np.errstate(over="ignore"):
            for _, texts in in_chunks(batch.column(0)):
                for s in shingle_sets(texts):
                    if len(s):
                        a, b = _digest(s)
                        d1.append(a)
                        d2.append(b)
                        sets.append(s.tobytes())
                        bits.append(_parities(s))
        yield pa.RecordBatch.from_arrays(
            [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sets, pa.binary()), pa.array(bits, pa.list_(pa.int64()))],
            names=["d1", "d2", "feats", "bits"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            hit.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.bool_())], names=["a", "b", "linked"])


def _few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, to be broadcast if there are at most ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _verify(s: Scratch, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """a, b, linked of (kept) pairs of classes; sizes and parities that cannot link are settled without their sets. Many may
    have one b."""
    times = s.keep(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("w")), f"{name}-times")
    left = sets.select(F.col("cls").alias("a"), F.col("feats").alias("fa"), F.col("n").alias("na"), F.col("bits").alias("pa"))
    right = times.join(sets.select(F.col("cls").alias("b"), F.col("feats").alias("fb"), F.col("n").alias("nb"), F.col("bits").alias("pb")), "b")
    able = split_join(pairs.join(left.select("a", "na", "pa"), "a"), right.select("b", "nb", "pb", "w"), ["b"], "w", ["a"])
    differ = sum(F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITIES))  # no more than the sets do
    able = able.filter(100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    able = able.filter((100 - SIMILARITY) * (F.col("na") + F.col("nb")) >= (100 + SIMILARITY) * differ)
    able = s.keep(able.select("a", "b"), f"{name}-able")
    some = _few(able.select(F.col("a").alias("cls")).union(able.select("b")).distinct(), FEW_KEYS)
    left = left.join(some.withColumnRenamed("cls", "a"), "a", "left_semi").select("a", "fa")
    right = right.join(some.withColumnRenamed("cls", "b"), "b", "left_semi")
    ready = split_join(able.join(left, "a"), right.select("b", "fb", "w"), ["b"], "w", ["a"]).select("a", "b", "fa", "fb")
    return s.keep(ready.mapInArrow(gives_back(_common), "a binary, b binary, linked boolean"), name)


def document_sets(s: Scratch, docs: DataFrame, sha: Column | None = None) -> tuple[DataFrame, np.ndarray]:
    """Per row: doc_id, sha (as given), n (shingles), cls (128-bit digest of the set, null without shingles) and its levels.

    And the signatures that may be frequent, sorted.
    """
    partitions = parallelism(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(None).cast("binary") if sha is None else sha).alias("sha"), "text")
    cls = F.unhex(F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0")))
    facts = rows.mapInArrow(gives_back(_facts(partitions)), _FACTS).withColumn("cls", F.when(F.col("n") > 0, cls))
    facts = s.keep(facts, "facts")
    total = facts.agg(F.sum(F.col("own_n") + F.col("low_n"))).collect()[0][0] or 0
    seen = facts.filter("n = -1").select(F.explode(F.arrays_zip("frequent", "times")).alias("x")).groupBy(F.col("x.frequent").alias("sig")).agg(
        F.sum("x.times").alias("times"))
    found = seen.filter(F.col("times") >= max(2, total // (4 * FREQUENT * partitions))).select("sig").toArrow()["sig"].to_numpy()
    return facts.filter("n >= 0").drop("frequent", "times"), np.sort(found.astype(np.int64).view(_U))


def _candidates(s: Scratch, docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """cls, sig, m: of each class the signatures by which it can meet a partner, and how many classes have each."""
    buckets = 4 * parallelism(s.spark)
    sent = docs.select("text").mapInArrow(gives_back(_emit(buckets, frequent)), "bucket int, sig binary, sid binary, level binary")
    posted = s.keep(sent.groupBy("bucket").applyInPandas(_shared_only, _POSTED), "posted")
    drop_shuffles(s.spark)
    if len(frequent):
        often = posted.filter("c = 0").drop("c")
        times = s.keep(often.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "times")  # no more rows than ``frequent`` has
        posted = posted.filter("c > 0").unionByName(often.join(F.broadcast(times), "sig"))
    sid = F.col("d1").bitwiseAND(F.lit((1 << NAME_BITS) - 1))
    per = classes.select("cls", sid.alias("sid"), "n", F.explode(F.array(
        F.struct(F.col("own").alias("level"), F.col("own_n").alias("m"), F.col("own_f").alias("f")),
        F.struct(F.col("low").alias("level"), F.col("low_n").alias("m"), F.col("low_f").alias("f")))).alias("l")).select("cls", "sid", "n", "l.*")
    shared = posted.groupBy("sid", "level").agg(F.count(F.lit(1)).alias("s"))
    quota = F.floor(F.col("n") / 3) + 1 - (F.col("m") - F.col("s"))
    alive = per.filter("level >= 0").join(shared, ["sid", "level"]).withColumn("q", quota).filter("q > 0 or m > f")
    rank = F.row_number().over(Window.partitionBy("cls", "level").orderBy("c", "sig"))
    first = posted.join(alive.select("cls", "sid", "level", "q", F.expr("m > f").alias("open")), ["sid", "level"]).withColumn("r", rank)
    first = s.keep(first.filter("r <= q or (open and filled)").select("cls", "sig"), "prefixes")
    wanted = s.keep(first.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "wanted")
    return s.keep(split_join(first, wanted, ["sig"], "m", ["cls"]), "candidates")


def _sets_of(s: Scratch, docs: DataFrame, facts: DataFrame, alive: DataFrame) -> DataFrame:
    """cls, n, feats of the classes that have candidates, made anew from one text of each."""
    texts = facts.filter("doc_id is not null").join(alive, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    texts = s.keep(texts, "texts")
    ids = _few(texts.select("doc_id").distinct(), BROADCAST_ROWS)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").select("text")
    made = made.mapInArrow(gives_back(_payload), "d1 long, d2 long, feats binary, bits array<long>")
    cls = F.unhex(F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0")))
    made = made.select(cls.alias("cls"), F.expr("octet_length(feats) div 8").alias("n"), "feats", "bits")
    return s.keep(made.join(texts.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def _with_roots(rows: DataFrame, links: DataFrame, key: str = "cls") -> DataFrame:
    roots = components(links, "a", "b")
    return rows.join(_few(roots.withColumnRenamed("node", key), FEW_KEYS), key, "left").withColumn("root", F.coalesce("root", key))


def _blocks(s: Scratch, rows: DataFrame) -> DataFrame:
    """cls, root, block: classes dealt to blocks of ``BLOCK``, those of the same large signature list and root side by side."""
    main = rows.groupBy("cls", "root").agg(F.max(F.struct("m", "sig")).alias("near"))
    order = main.repartitionByRange(parallelism(s.spark), "near", "root", "cls").sortWithinPartitions("near", "root", "cls")
    order = s.keep(order.withColumn("id", F.monotonically_increasing_id()).select("cls", "root", "id"), "ordered")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))  # a row per partition
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("part", F.coalesce(before, F.lit(0)).alias("shift"))
    return order.withColumn("part", part).join(F.broadcast(shift), "part").select(
        "cls", "root", F.floor((F.col("shift") + place) / BLOCK).alias("block"))


def _spanning(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> list[int]:
    """Of links between components, places of enough to connect the same ones."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(ra.tolist(), rb.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            kept.append(i)
    return kept


def _between(group: pd.DataFrame) -> pd.DataFrame:
    """Links between different components of two blocks (or within one), as many as connect what they connect."""
    left = group[group["side"] == 0]
    right = group[group["side"] == 1] if (group["side"] == 1).any() else left
    codes = {r: i for i, r in enumerate(dict.fromkeys(group["root"]))}
    roots = [np.array([codes[r] for r in x["root"]]) for x in (left, right)]
    feats = [[np.frombuffer(f, np.uint64) for f in x["feats"]] for x in (left, right)]
    size = [np.array([len(f) for f in x]) for x in feats]
    flat = [np.concatenate(x) for x in feats]
    owner = [np.repeat(np.arange(len(n)), n) for n in size]
    order = [np.argsort(x, kind="stable") for x in flat]
    flat, owner = [x[o] for x, o in zip(flat, order, strict=True)], [x[o] for x, o in zip(owner, order, strict=True)]
    low, high = np.searchsorted(flat[1], flat[0], "left"), np.searchsorted(flat[1], flat[0], "right")
    times, width = high - low, len(size[1])
    both = np.zeros(len(size[0]) * width, np.int64)
    ends = np.cumsum(times)
    at = 0
    while at < len(times):  # features of the left side, each with every owner on the right, half a million pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000)))
        n = times[at:to]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(owner[0][at:to], n) * width + owner[1][np.repeat(low[at:to], n) + inner]
        both += np.bincount(pair, minlength=len(both))
        at = to
    both = both.reshape(-1, width)
    union = size[0][:, None] + size[1][None] - both
    i, j = np.nonzero((100 * both >= SIMILARITY * union) & (roots[0][:, None] != roots[1][None]))
    kept = _spanning(i, j, roots[0][i], roots[1][j])
    return pd.DataFrame({"a": left["cls"].to_numpy()[i[kept]], "b": right["cls"].to_numpy()[j[kept]]})


def linked_classes(s: Scratch, docs: DataFrame, facts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """a, b: links between classes of equal sets that give the same components as all links do."""
    classes = facts.filter("cls is not null and doc_id is not null").dropDuplicates(["cls"])
    met = _candidates(s, docs, classes, frequent)
    sets = _sets_of(s, docs, facts, met.select("cls").distinct())

    centre = s.keep(met.groupBy("sig").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("m")), "centres")
    pairs = split_join(met.select("cls", "sig"), centre, ["sig"], "m", ["cls"]).filter("cls <> b")
    pairs = pairs.groupBy(F.col("cls").alias("a"), "b").agg(F.count(F.lit(1)).alias("w"))
    best = s.keep(pairs.groupBy("a").agg(F.max(F.struct("w", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "best")
    stars = _verify(s, best, sets, "stars").filter("linked").select("a", "b")

    rows = s.keep(_with_roots(met.select("cls", "sig"), stars), "rooted")
    lists = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"))
    split = s.keep(lists.filter("lo <> hi").select("sig", "m"), "split")
    rows = rows.join(F.broadcast(split), "sig") if split.count() <= FEW_KEYS else split_join(rows, split, ["sig"], "m", ["cls"])
    rows = s.keep(rows, "open")

    few = rows.filter(F.col("m") <= SHORT_LIST).select("sig", "cls", "root")
    other = few.select("sig", F.col("cls").alias("b"), F.col("root").alias("rb"))
    pairs = few.join(other, "sig").filter("cls < b and root <> rb").select(F.col("cls").alias("a"), "b").distinct()
    near = _verify(s, s.keep(pairs, "pairs"), sets, "near").filter("linked").select("a", "b")

    rows = rows.filter(F.col("m") > SHORT_LIST)
    placed = s.keep(_blocks(s, rows), "blocks")
    held = rows.select("cls", "sig").join(placed.select("cls", "block"), "cls").select("sig", "block").distinct()
    left, right = held.select("sig", F.col("block").alias("i")), held.select("sig", F.col("block").alias("j"))
    tasks = left.join(right, "sig").filter("i <= j").select("i", "j").distinct()
    # Two blocks that lie in one and the same component have nothing to tell.
    ends = placed.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    tasks = tasks.join(ends.select(F.col("block").alias("i"), F.col("lo").alias("li"), F.col("hi").alias("hi_i")), "i").join(
        ends.select(F.col("block").alias("j"), F.col("lo").alias("lj"), F.col("hi").alias("hi_j")), "j")
    tasks = s.keep(tasks.filter("not (li = hi_i and lj = hi_j and li = lj)").select("i", "j"), "tasks")
    members = s.keep(placed.join(sets.select("cls", "feats"), "cls"), "members")
    columns = ["i", "j", "side", "cls", "root", "feats"]
    first = tasks.join(members.withColumnRenamed("block", "i"), "i").withColumn("side", F.lit(0)).select(columns)
    second = tasks.filter("i < j").join(members.withColumnRenamed("block", "j"), "j").withColumn("side", F.lit(1)).select(columns)
    late = first.unionByName(second).groupBy("i", "j").applyInPandas(_between, "a binary, b binary")
    return stars.unionByName(near).unionByName(s.keep(late, "late"))


def _rooted(s: Scratch, docs: DataFrame, sha: Column | None = None) -> DataFrame:
    """The rows of ``document_sets`` with the root of their component, a class; null without shingles or doc_id."""
    with arrow_rows(s.spark):
        facts, frequent = document_sets(s, docs, sha)
        names = facts.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("w"))
        names = s.keep(_with_roots(names, linked_classes(s, docs, facts, frequent)), "names")
    some = facts.filter("cls is not null and doc_id is not null")
    rest = facts.filter("cls is null or doc_id is null").withColumn("root", F.lit(None).cast("binary"))
    return split_join(some, names, ["cls"], "w", ["doc_id"]).drop("w").unionByName(rest)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row."""
    with Scratch(docs.sparkSession) as s:
        rows = s.keep(_rooted(s, docs).select("doc_id", "n", "root"), "rows")
        lowest = s.keep(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("w")), "lowest")
        found = split_join(rows.filter("root is not null"), lowest, ["root"], "w", ["doc_id"]).select("doc_id", "n", "component_id")
        found = found.unionByName(rows.filter("root is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
        return keep(found.withColumnRenamed("n", "n_shingles"), "components")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component one row, that with the smallest doc_id (of rows
    with that id the one with the smallest digest); all without words; and all without a doc_id, which link nothing.

    Of rows that repeat both id and text any one stays.
    """
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    with Scratch(docs.sparkSession) as s:
        rows = s.keep(_rooted(s, docs, sha).filter("doc_id is not null").select("doc_id", "cls", "sha", "root"), "rows")
        first = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "cls", "sha")).alias("x")).select("x.doc_id", "x.sha")
        first = first.unionByName(rows.filter("root is null").select("doc_id", "sha"))
        stay = keep(first.select(row_key(F.col("doc_id"), F.col("sha")).alias("_k")), "stay")
    return rows_with(docs.filter("doc_id is not null"), sha, stay).unionByName(docs.filter("doc_id is null"))


__all__ = ["SIMILARITY", "document_sets", "drop_near_copies", "jaccard_components", "linked_classes", "signatures"]
