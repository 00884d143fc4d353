r"""Repair of the structure of conversations: turns are kept, reroled or deleted and missing ones inserted, at the least cost.

A repaired conversation is empty or has, after at most one system turn, user and assistant turns in turn. What it keeps is a
subsequence of the conversation's turns. Their costs are worked out from the last turn to the first: the price of a gap
between two retained turns is that of its deletions (a difference of two prefix sums) and of its inserts (by the roles at
its ends), so the best successor of a turn is a running minimum for each role. Of repairs at the same cost the one whose
audit, the initials of its edits in order, is first by ASCII is read off from the first turn to the last.

A conversation of usual size is worked out in one task, a turn's costs and edit being all that is held besides its texts. Those
with more than their share of all turns are cut into segments by ranges of turns: each segment's costs from every role
ahead of it to every role after it are a small matrix; the matrices of a conversation, one for each range at most, are
multiplied (minimum and sum), and then every segment is worked out in a task of its own. Repeated turns are found by counts of
their hashes. Only the hash of the repaired text, which is a chain, passes one task, turn by turn.

Defined results: nulls count as one space, in the key of the damage too, while a null turn comes first and isn't counted in
gaps. Turns with the same number are in order of role and text. A null conv_id is a conversation of its own. Extra
columns aren't looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import FEW_ROWS, FREQUENT, Scratch, keep, parallelism, split_join

DELETE, REROLE, INSERT, TRUNCATED_COST = 2, 1, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: What stands ahead of a turn: nothing, a system, user or assistant turn; the initials of roles are numbered alike.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The role that an insert, or a reroled turn, has after each of them.
_NEXT = (USER, USER, ASSISTANT, USER)
#: Cost of ending after each of them.
ENDS = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 60
_SPACE = " \t\n\x0b\f\r"
_ALLOWED = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

_RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, code and fault (blank or truncated) of the rows after damage; dropped ones stay as empty marks."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") <= 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(NOTHING)
    tail = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(tail == "", BLANK).when(~F.substring(tail, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.select("*", code.alias("code"), fault.alias("fault"))


def costs(codes: list[int], faults: list[int], ends: tuple[int, ...] = ENDS) -> list[tuple[int, ...]]:
    """For each turn, and after the last: the least cost of what follows, by what stands ahead."""
    n = len(codes)
    go: list[tuple[int, ...]] = [tuple(ends)] * (n + 1)
    e0, e1, e2, e3 = (DELETE * n + x for x in ends)
    best_s = best_u = best_a = _FAR  # of all later turns, retained in that role, with the deletions ahead of them
    _, after_s, after_u, after_a = ends
    for i in range(n - 1, -1, -1):
        fault, before = faults[i], DELETE * i
        if fault != BLANK and fault != DUPLICATE:
            own, code = before + (TRUNCATED_COST if fault == TRUNCATED else 0), codes[i]
            best_u = min(best_u, own + after_u + (0 if code == USER else REROLE))
            best_a = min(best_a, own + after_a + (0 if code == ASSISTANT else REROLE))
            if code == SYSTEM:
                best_s = min(best_s, own + after_s)
        late_a, late_u = best_a + INSERT, best_u + INSERT
        after_s = min(e1, best_u, late_a) - before
        after_u = min(e2, best_a, late_u) - before
        after_a = min(e3, best_u, late_a) - before
        go[i] = (min(e0, best_s, best_u, late_a) - before, after_s, after_u, after_a)
    return go


def edits(codes: list[int], faults: list[int], go: list[tuple[int, ...]], ahead: int, last: bool = True) -> tuple[list[str], str, int]:
    """The edits at each turn (inserts ahead of it included), those after the last, and what stands there then."""
    out = []
    for i, (code, fault) in enumerate(zip(codes, faults, strict=True)):
        here, after, done = go[i], go[i + 1], ""
        while True:
            want, role = here[ahead], _NEXT[ahead]
            if DELETE + after[ahead] == want:
                done += "D"
            elif INSERT + here[role] == want:
                done, ahead = done + "I", role
                continue
            else:
                own = TRUNCATED_COST if fault == TRUNCATED else 0
                fits = code == role or (code == SYSTEM and ahead == NOTHING)
                if fits and own + after[code] == want:
                    done, ahead = done + "K", code
                else:
                    done, ahead = done + "R", role
            break
        out.append(done)
    tail = ""
    while last and ENDS[ahead]:
        tail, ahead = tail + "I", _NEXT[ahead]
    return out, tail, ahead


def lines(roles: list[str], texts: list[str], codes: list[int], done: list[str], tail: str, ahead: int) -> Iterator[tuple[int, str]]:
    """The repaired turns as ``role:text``, each with the number of the turn at which it stands."""
    for i, edit in enumerate([*done, tail]):
        for step in edit:
            if step == "D":
                continue
            role = _NEXT[ahead]
            if step == "I":
                yield i, _NAMES[role] + ":"
            elif step == "R":
                yield i, f"{_NAMES[role]}:{texts[i]}"
            else:
                role = codes[i]
                yield i, f"{roles[i]}:{texts[i]}"
            ahead = role


def _illegal(codes: list[int]) -> int:
    return sum(pair not in _ALLOWED for pair in zip(codes[:-1], codes[1:], strict=True))


def _whole(turns: list[tuple]) -> tuple:
    """The result of one conversation from its turns (turn, role, text, code, fault) in order."""
    if not turns:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
    numbers, roles, texts, codes, faults = map(list, zip(*turns, strict=True))
    seen: set[tuple[str, str]] = set()
    for i, said in enumerate(zip(roles, texts, strict=True)):
        if said in seen and faults[i] != BLANK:
            faults[i] = DUPLICATE
        seen.add(said)
    known = {x for x in numbers if x is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    go = costs(codes, faults)
    done, tail, _ = edits(codes, faults, go, NOTHING)
    repaired = "\n".join(x for _, x in lines(roles, texts, codes, done, tail, NOTHING))
    return (gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), _illegal(codes), go[0][NOTHING], "".join(done) + tail, hashlib.sha256(repaired.encode()).hexdigest())


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _repair_sorted(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        held = []
        for conv, rows in groupby(_sorted_rows(batches), key=lambda r: r[0]):
            held.append((conv, *_whole([(r[1], r[2], r[3], r[5], r[6]) for r in rows if not r[4]])))
            if len(held) == 1000:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return run


def _frame(rows: list[tuple], names: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in names.split(", ")])


_MATRIX = "_c string, seg int, costs array<long>, first int, last int, illegal long"
_EXIT = "_c string, seg int, ends array<long>, last_one boolean"
_CHOICES = "_c string, seg int, audits array<string>, tails array<string>, outs array<int>, cost long"
_CHOSEN = "_c string, seg int, ahead int, audit string, tail string, cost long"
_LINES = "_c string, pos long, line string"


def _matrix(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    codes, faults = group["code"].tolist(), group["fault"].tolist()
    by_end = [costs(codes, faults, tuple(0 if t == end else _FAR for t in range(4)))[0] for end in range(4)]
    flat = [min(_FAR, by_end[t][s]) for s in range(4) for t in range(4)]
    return _frame([(group["_c"].iloc[0], int(group["seg"].iloc[0]), flat, codes[0], codes[-1], _illegal(codes))], _MATRIX)


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    rows, ends = [], list(ENDS)
    for k, r in enumerate(group.sort_values("seg", ascending=False).itertuples()):
        rows.append((r._1, r.seg, list(ends), k == 0))
        ends = [min(r.costs[4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
    return _frame(rows, _EXIT)


def _choices(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    codes, faults = group["code"].tolist(), group["fault"].tolist()
    ends = tuple(int(x) for x in group["ends"].iloc[0])
    go = costs(codes, faults, ends)
    found = [edits(codes, faults, go, s, bool(group["last_one"].iloc[0])) for s in range(4)]
    return _frame([(group["_c"].iloc[0], int(group["seg"].iloc[0]), ["".join(d) for d, _, _ in found], [t for _, t, _ in found], [o for _, _, o in found], go[0][NOTHING])], _CHOICES)


def _chosen(group: pd.DataFrame) -> pd.DataFrame:
    rows, ahead, cost = [], NOTHING, None
    for r in group.sort_values("seg").itertuples():
        cost = r.cost if cost is None else cost
        rows.append((r._1, r.seg, ahead, r.audits[ahead], r.tails[ahead], cost))
        ahead = int(r.outs[ahead])
    return _frame(rows, _CHOSEN)


def _lines(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    done, at = [], ""
    for step in group["audit"].iloc[0]:
        at += step
        if step != "I":
            done.append(at)
            at = ""
    places = group["pos"].tolist()
    said = lines(group["role"].tolist(), group["text"].tolist(), group["code"].tolist(), done, group["tail"].iloc[0], int(group["ahead"].iloc[0]))
    per: dict[int, list[str]] = {}
    for i, line in said:
        per.setdefault(i, []).append(line)
    return _frame([(group["_c"].iloc[0], places[i] if i < len(places) else places[-1] + 1, "\n".join(x)) for i, x in per.items()], _LINES)


def _hash_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, rows in groupby(_sorted_rows(batches), key=lambda r: r[0]):
        chain, between = hashlib.sha256(), b""
        for _, _, line in rows:
            chain.update(between + line.encode())
            between = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([chain.hexdigest()], pa.string())], names=["_c", "repaired_sha256"])


def _ordered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.sortWithinPartitions(*keys, "turn", "role", "text")


def _in_segments(s: Scratch, rows: DataFrame, long_ones: DataFrame) -> DataFrame:
    """Results of the conversations ``long_ones`` (conv_id, _c), whose rows are ``rows`` (with _c)."""
    said = rows.filter(~F.col("dropped")).drop("dropped")
    said = _ordered(said.repartitionByRange(parallelism(s.spark), "_c", "turn", "role", "text"), "_c")
    said = s.keep(said.withColumn("seg", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "turns")
    hashed = said.select("_c", "pos", F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256).alias("h"))
    again = hashed.groupBy("_c", "h").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_many")).filter("_many > 1")
    again = split_join(hashed, s.keep(again, "again"), ["_c", "h"], "_many", ["pos"]).filter("pos > _first").select("pos", F.lit(True).alias("_again"))
    fault = F.when(F.col("_again") & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    coded = s.keep(said.select("_c", "seg", "pos", "turn", "code", "fault").join(again, "pos", "left").withColumn("fault", fault).drop("_again"), "coded")
    parts = s.keep(coded.groupBy("_c", "seg").applyInPandas(_matrix, _MATRIX), "matrices")
    exits = parts.groupBy("_c").applyInPandas(_exits, _EXIT)  # a row for each range at most
    choices = coded.join(exits, ["_c", "seg"]).groupBy("_c", "seg").applyInPandas(_choices, _CHOICES)
    chosen = s.keep(choices.groupBy("_c").applyInPandas(_chosen, _CHOSEN), "chosen")
    # segments are no more than ranges and the long conversations together, whatever the rows
    text = said.join(F.broadcast(chosen.drop("cost")), ["_c", "seg"]).groupBy("_c", "seg").applyInPandas(_lines, _LINES)
    text = text.repartition(parallelism(s.spark), "_c").sortWithinPartitions("_c", "pos").mapInArrow(_hash_sorted, "_c string, repaired_sha256 string")
    turns = coded.groupBy("_c").agg(F.max("turn").alias("_max"), F.min("turn").alias("_min"), F.countDistinct("turn").alias("_distinct"))
    counts = coded.groupBy("_c").agg(*(F.sum((F.col("fault") == f).cast("long")).alias(c) for c, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))))
    ends = F.array_sort(F.collect_list(F.struct("seg", "first", "last")))
    allowed = F.transform(ends, lambda e, i: F.when(i > 0, F.struct(F.get(ends, i - 1)["last"].alias("a"), e["first"].alias("b"))))
    allowed = F.filter(allowed, lambda p: p.isNotNull() & ~F.struct(p["a"], p["b"]).isin(*(F.struct(F.lit(a), F.lit(b)) for a, b in _ALLOWED)))
    illegal = parts.groupBy("_c").agg((F.sum("illegal") + F.size(allowed)).cast("long").alias("illegal"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit", "tail"))), lambda x: F.concat(x["audit"], x["tail"])), "")
    audits = chosen.groupBy("_c").agg(F.max("cost").alias("cost"), audit.alias("audit"))
    out = long_ones
    for facts in (turns, counts, illegal, audits, text):
        out = out.join(facts, "_c", "left")
    gaps = F.coalesce(F.col("_max") - F.col("_min") + 1 - F.col("_distinct"), F.lit(0)).cast("long")
    empty = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", gaps.alias("gaps"), *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def repair_conversations(rows: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row per conversation.

    ``most``: turns of a conversation that one task works out; a share of all turns unless given.
    """
    spark = rows.sparkSession
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    turns = damaged(rows).withColumn("_c", conv)
    kind = turns.schema["conv_id"].dataType
    with Scratch(spark) as s:
        sizes = turns.groupBy("conv_id", "_c").agg(F.count(F.lit(1)).alias("_n"))
        if most is None:
            most = max(FEW_ROWS, rows.count() // (FREQUENT * parallelism(spark)))
        long_ones = s.keep(sizes.filter(F.col("_n") > most).select("conv_id", "_c"), "long")  # fewer than the partitions, times a constant
        few = F.broadcast(long_ones.select("_c"))
        usual = turns.join(few, "_c", "left_anti").select("conv_id", "turn", "role", "text", "dropped", "code", "fault")
        usual = _ordered(usual.repartition(parallelism(spark), "conv_id"), "conv_id")
        schema = spark.createDataFrame([], f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in _RESULT.items())).schema
        arrow = pa.schema([pa.field("conv_id", pa.string() if kind.simpleString() == "string" else pa.int32() if kind.simpleString() == "int" else pa.int64()), *(pa.field(c, pa.string() if t == "string" else pa.int64()) for c, t in _RESULT.items())])
        found = usual.mapInArrow(_repair_sorted(arrow), schema)
        if not long_ones.isEmpty():
            found = found.unionByName(_in_segments(s, turns.join(few, "_c", "left_semi"), long_ones))
        return keep(found, "repaired")


__all__ = ["costs", "damaged", "edits", "lines", "repair_conversations"]
