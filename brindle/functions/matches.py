"""All matches of a pattern in a text with their offsets, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word boundaries of ASCII words, whatever other letters stand beside them.
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: The same ahead of a name that may begin with a dollar sign, which is no letter of a word: then one must precede it.
NAME_START = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: What marks matches and their groups, one sign each, so that texts are cut without a pattern; where a text has such characters they count as spaces.
_MATCH, _GROUP = "\x01", "\x02"
#: Numbers that are summed up at once.
_STRETCH = 256
#: Characters of a stretch of text.
STRETCH_CHARS = 2048


def record(**fields: Column) -> Column:
    """A struct whose fields keep their names in lambdas too."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def one_of(value: Column, *of: str) -> Column:
    """``value.isin(*of)`` for use in lambdas, where a list is walked through anew for each value."""
    return reduce(Column.__or__, (value == x for x in of))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are worked out once: they come out of a generator, so no filter or projection that follows
    is folded back into them, which would run their patterns again for each use."""
    return rows.select("*", F.inline(F.array(record(**columns))))


def running(numbers: Column, join=lambda a, b: a + b) -> Column:
    """For each number the sum (or ``join``, which has 0 as its neutral number) of those ahead of it; in stretches, so the work
    doesn't grow with the square of their number."""
    zero = F.array(F.lit(0))

    def sums(x: Column) -> Column:
        return F.aggregate(x, zero, lambda acc, n: F.array_append(acc, join(F.element_at(acc, -1), n)))

    def joined(local: Column) -> Column:
        base = sums(F.transform(local, lambda x: F.element_at(x, -1)))
        moved = F.zip_with(local, F.slice(base, F.lit(1), F.size(local)), lambda x, b: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda n: join(n, b)))
        return F.flatten(moved)

    def whole(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _STRETCH).cast("int"))
        parts = F.transform(starts, lambda i: sums(F.slice(x, i * _STRETCH + 1, F.lit(_STRETCH))))
        few = let(sums(x), lambda s: F.slice(s, F.lit(1), F.size(x)))
        return F.when(F.size(x).between(1, _STRETCH), few).when(F.size(x) > 0, let(parts, joined)).otherwise(F.array().cast("array<int>"))

    return let(numbers, whole)


def matches(text: Column, pattern: str, offsets: bool = True, **groups: int) -> Column:
    """Array of struct(at, *groups), in order; ``at`` is the offset of the match in characters, from 0. Null without any.

    The pattern runs once over the text: it marks its matches and their groups, and what lies between the marks is cut
    apart. Without ``offsets`` there is no ``at``.
    """
    clean = F.when(text.rlike("[\x01-\x03]"), F.translate(text, "\x01\x02\x03", "   ")).otherwise(text)
    marked = F.regexp_replace(clean, pattern, _MATCH + "".join(f"${n}{_GROUP}" for n in groups.values()) + (f"$0{_GROUP}" if offsets else ""))

    def one(piece: Column) -> Column:
        parts = F.split(piece, _GROUP, -1)
        found = {name: F.get(parts, F.lit(i)) for i, name in enumerate(groups)}
        if offsets:
            n = len(groups)
            found |= {"own": F.char_length(F.get(parts, F.lit(n))), "gap": F.char_length(F.get(parts, F.lit(n + 1)))}
        return record(**found)

    def cut(pieces: Column) -> Column:
        found = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)
        if offsets:
            first = F.char_length(F.get(pieces, F.lit(0)))
            found = let(found, lambda m: F.zip_with(m, running(F.transform(m, lambda x: x["own"] + x["gap"])), lambda x, at: record(
                at=first + at, **{name: x[name] for name in groups})))
        return F.when(F.size(pieces) > 1, found)

    return let(F.split(marked, _MATCH, -1), cut)


def stretches(text: Column) -> Column:
    """A text in stretches of ``STRETCH_CHARS`` characters, cut in one pass, so that a part of it costs its own length."""
    return F.regexp_extract_all(text, F.lit(r"[\s\S]{1," + str(STRETCH_CHARS) + "}"), F.lit(0))


def between(parts: Column, start: Column, length: Column) -> Column:
    """``length`` characters from an offset of a text in stretches; twice ``STRETCH_CHARS`` at most."""
    first = F.floor(start / STRETCH_CHARS).cast("int")
    near = F.concat(*(F.coalesce(F.get(parts, first + i), F.lit("")) for i in range(3)))
    return F.substring(near, (start - first * STRETCH_CHARS + 1).cast("int"), length.cast("int"))


def line_marks(parts: Column) -> Column:
    """For each stretch of a text: line feeds ahead of it, and the offset behind the last of them (0 without any)."""
    feeds = running(F.transform(parts, lambda p: F.regexp_count(p, F.lit("\n"))))
    behind = running(F.transform(parts, lambda p, i: F.when(F.contains(p, F.lit("\n")), i * STRETCH_CHARS + F.char_length(p) - F.char_length(F.substring_index(p, "\n", -1))).otherwise(0)), F.greatest)
    return F.zip_with(F.slice(feeds, F.lit(1), F.size(parts)), F.slice(behind, F.lit(1), F.size(parts)), lambda f, b: record(feeds=f, behind=b))


def line_and_column(parts: Column, marks: Column, at: Column) -> tuple[Column, Column]:
    """Line and column (from 1) of an offset of a text in stretches."""
    first = F.floor(at / STRETCH_CHARS).cast("int")
    head = F.substring(F.coalesce(F.get(parts, first), F.lit("")), F.lit(1), (at - first * STRETCH_CHARS).cast("int"))
    line = F.get(marks, first)["feeds"] + F.regexp_count(head, F.lit("\n")) + 1
    column = F.when(F.contains(head, F.lit("\n")), F.char_length(F.substring_index(head, "\n", -1))).otherwise(at - F.get(marks, first)["behind"]) + 1
    return line.cast("int"), column.cast("int")


def around(text: Column, at: Column, before: int, after: int) -> Column:
    """The characters from ``before`` ahead of an offset to ``after`` behind it."""
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text, start + 1, at - start + after)


__all__ = ["NAME_START", "WORD_END", "WORD_START", "STRETCH_CHARS", "around", "between", "let", "line_and_column", "line_marks", "matches", "once", "one_of", "record", "running", "stretches"]
