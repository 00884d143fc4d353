"""Scripts as tables of tokens whose nesting follows from prefix sums.

A token is a row: its place, its text and how many brackets are open around it, a running sum of +1 and -1. The brackets
of one level alternate, so the partner of an opening bracket is the next bracket of its level in order. What stands in a
bracket is cut at the commas of its level into items; an item, or an expression that begins anywhere, ends ahead of the next
boundary of its level: a comma, a semicolon, a closing bracket, or two operands side by side, as a line feed has them.
Nesting may be of any depth. ``nested`` says it by windows over a table of tokens, ``Structure`` by sums and sorts over batches of scripts, each in its row.

Brackets without a partner are counted as errors of the script; a text without brackets or tokens has none.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.matches import record

#: Quoted texts and comments, whose brackets and commas don't count. Loops are possessive: no backtracking, no deep stack.
QUOTED = r"(?:\"(?:[^\"\\\r\n]++|\\[\s\S])*+\"|'(?:[^'\\\r\n]++|\\[\s\S])*+'|`(?:[^`\\]++|\\[\s\S])*+`)"
COMMENT = r"(?://[^\r\n]*+|/\*[\s\S]*?(?:\*/|\z))"
#: A regular expression stands where an operand may begin.
_PATTERN = r"(?<=(?:[=(,:;!&|?{}\[+*~^<>\r\n-]|\breturn|\btypeof)[ \t]{0,8})/(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*+\])++/[A-Za-z]*+"
WORD = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_SIGN = r"=>|[=!]==?|\?\?=?|\|\||&&|\.\.\.|\?\.|[^\s\p{L}\p{N}_$\"'`]|[\"'`]"
TOKEN = "|".join((COMMENT, QUOTED, _PATTERN, WORD, r"[0-9][\p{L}\p{N}_.]*+", _SIGN))
#: Words after which an operand begins, or that join two.
KEYWORDS = ("return", "typeof", "new", "await", "async", "var", "let", "const", "function", "in", "of", "delete", "void", "throw", "case", "else", "yield", "get", "set", "static",
            "class", "extends", "import", "from", "export", "default", "as", "instanceof", "do", "try", "finally")
#: Words ahead of a bracket that aren't called.
NOT_CALLED = ("if", "for", "while", "switch", "catch", "with", *KEYWORDS)
_OPEN, _CLOSE = ("(", "[", "{"), (")", "]", "}")
#: Tokens ahead that each token knows.
AHEAD = 5
# Settings of base urls.
BASE_KEYS = ("baseUrl", "baseURL", "domainName")


def tokens(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, pos, s: the tokens of each script in order; comments are none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    found = F.filter(found, lambda t: ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))))
    return scripts.select("script_id", F.posexplode(found).alias("pos", "s"))


def in_rows(scripts: DataFrame, text: str, said, columns: str) -> DataFrame:
    """script_id and ``columns``, which ``said`` makes of the tokens of a batch of scripts (see ``Structure``).

    A script stays in its row, so nothing is shuffled or sorted on disk: the windows of ``nested`` are prefix sums and
    stable sorts over the tokens of a batch of scripts.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    found = F.filter(found, lambda t: ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))))
    rows = scripts.select("script_id", found.alias("s"))
    return rows.mapInArrow(_batched(said), f"script_id {rows.schema['script_id'].dataType.simpleString()}, {columns}")


#: Tokens of scripts that are looked at together.
_BATCH_TOKENS = 400_000


def _batched(said):
    def run(batches):
        for batch in batches:
            at, ends = 0, batch.column(1).offsets.to_numpy()
            while at < batch.num_rows:  # at least one script, else as many as the tokens allow
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + _BATCH_TOKENS, "right")) - 1)
                yield said(batch.slice(at, to - at))
                at = to

    return run


def letter(w: str) -> bool:
    return unicodedata.category(w[0])[0] == "L" or w[0] in "_$"


def lists(values: pa.Array, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """The values as lists of these sizes; those that are ``missing`` are null."""
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(ends, values, mask=None if missing is None else pa.array(missing))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Structure:
    """What ``nested`` says of the tokens of a batch of scripts, as arrays of a number for each token.

    ``code`` (of its text in ``texts``), ``script`` and ``pos`` (place in it); ``mate``, ``up``, ``stop``, ``ahead`` and ``body`` are places in the batch,
    -1 for none; ``opens``; ``end`` (the next boundary or the script's end).
    """

    def __init__(self, batch: pa.RecordBatch):
        self.sizes = sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
        coded = batch.column(1).flatten().dictionary_encode()
        self.code, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.texts, self.n = self.words.to_pylist(), len(self.code)
        self.place = {w: i for i, w in enumerate(self.texts)}
        n, among, before = self.n, self.among, self.before
        self.script, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        script = self.script
        self.pos = pos = np.arange(n) - first[script]
        self.follows = np.append(script[1:] == script[:-1], False)[:n]
        opens, closes = among(*_OPEN), among(*_CLOSE)
        kind = sum((i + 1) * among(a, b) for i, (a, b) in enumerate(zip(_OPEN, _CLOSE)))
        depth = np.cumsum(opens.astype(np.int64) - closes)
        level, bracket = depth - np.concatenate(([0], depth))[first][script] - opens, opens | closes
        # the brackets of one level alternate
        own = np.flatnonzero(bracket)
        own = own[np.lexsort((level[own], script[own]))]
        same = (script[own[1:]] == script[own[:-1]]) & (level[own[1:]] == level[own[:-1]])
        following, mate, body = np.full(n + 1, -1), np.full(n, -1), np.full(n, -1)
        a, b = own[:-1][same], own[1:][same]
        following[a] = b
        pair = opens[a] & closes[b] & (kind[a] == kind[b])
        mate[a[pair]], mate[b[pair]] = b[pair], a[pair]
        body = np.where(opens & (following[:n] >= 0), following[following[:n]], -1)
        ahead = np.concatenate(([-1], np.where(closes, mate, -1)))[:n]
        ahead[pos == 0] = -1
        # what stands in one bracket
        self.word = word = self.flag(letter)
        operand = self.flag(lambda w: (letter(w) or unicodedata.category(w[0])[0] == "N" or w[0] in "\"'") and w not in KEYWORDS)
        side = (operand | among("const", "let", "var", "return", "function", "class", "export", "import")) & before(operand | closes)
        stops = among(",", ";") | closes | side
        order = np.lexsort((level + bracket, script))
        key, place = (level + bracket)[order], np.arange(n)
        starts = np.concatenate(([True], (key[1:] != key[:-1]) | (script[order][1:] != script[order][:-1])))[:n]
        begin = np.maximum.accumulate(np.where(starts, place, 0))
        held = np.maximum.accumulate(np.where(opens[order], place, -1))
        up, stop = np.full(n, -1), np.full(n, -1)
        up[order] = np.where(held >= begin, order[held], -1)
        later = np.append(np.minimum.accumulate(np.where(stops[order], place, n)[::-1])[::-1], n)[1:]
        good = later < n
        good[good] = begin[later[good]] == begin[good]
        stop[order[good]] = order[later[good]]
        self.opens, self.mate, self.up, self.stop, self.ahead, self.body = opens, mate, up, stop, ahead, body
        self.end = np.where(stop >= 0, stop, (first + sizes)[script])
        self.errors = np.bincount(script[bracket & (mate < 0)], minlength=len(sizes))
        self._spell(word)

    def _spell(self, word: np.ndarray) -> None:
        """Names that are short for a property of that name are spelled out in terms."""
        in_brace = self.among("{")[self.up] & (self.up >= 0) if self.n else word
        self.in_brace = in_brace
        closed = np.append(self.among("}", ",")[1:], False)[:self.n] & self.follows
        short = word & in_brace & self.before(self.among("{", ",")) & closed
        some, at = np.unique(self.code[short], return_inverse=True)
        self._spelled = pa.concat_arrays([self.words, pa.array([f"{self.texts[i]}:{self.texts[i]}" for i in some], self.words.type)])
        self._code = self.code.copy()
        self._code[short] = len(self.texts) + at

    def flag(self, test) -> np.ndarray:
        """Of each token, whether its text passes."""
        return np.array([test(w) for w in self.texts], bool).reshape(-1)[self.code] if self.n else np.zeros(0, bool)

    def among(self, *of: str) -> np.ndarray:
        known = np.zeros(len(self.texts), bool)
        known[[self.place[w] for w in of if w in self.place]] = True
        return known[self.code] if self.n else np.zeros(0, bool)

    def before(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        """``x`` of the token ``k`` ahead of each, false where there is none."""
        return np.concatenate((np.zeros(min(k, self.n), x.dtype), x[:max(self.n - k, 0)])) & (self.pos >= k)

    def spelled(self, start: np.ndarray, size: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        """The tokens from each start on, as many as its size says, as lists of texts."""
        return lists(self._spelled.take(pa.array(self._code[ranges(start, size)])), size, missing)


def is_word(s: Column) -> Column:
    return s.rlike(r"^[\p{L}_$]")


def _operand(s: Column) -> Column:
    return s.rlike(r"^[\p{L}\p{N}_$\"']") & ~s.isin(*KEYWORDS)


def nested(found: DataFrame) -> DataFrame:
    """``found`` (script_id, pos, s) with what the structure says of each token:

    p1 to p5 and n1 (texts of its neighbours), level (brackets around it), mate (place of a bracket's partner, null without
    one), up and up_s (the bracket in which it stands; a bracket counts as the first or last token of its own inside), k (commas
    ahead of it in there), stop (place of the next boundary), ahead (of a closing bracket right ahead of it: place and
    neighbours of its partner), body (of a round bracket: the next bracket of its level after its partner).
    """
    order = Window.partitionBy("script_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("s").isin(*_OPEN), F.col("s").isin(*_CLOSE)
    after = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto)
    rows = found.repartition("script_id").select(
        "*", *(F.lag("s", k).over(order).alias(f"p{k}") for k in range(1, AHEAD + 1)), F.lead("s", 1).over(order).alias("n1"), after.alias("_after"))
    rows = rows.withColumn("level", F.col("_after") - opens.cast("int")).withColumn("_bracket", opens | closes)
    alike = Window.partitionBy("script_id", "level", "_bracket").orderBy("pos")
    near = F.struct("pos", "s", *(f"p{k}" for k in range(1, AHEAD + 1)))
    rows = rows.withColumns({"_next": F.when(opens, F.lead(near, 1).over(alike)), "_last": F.when(closes, F.lag(near, 1).over(alike)), "body": F.when(opens, F.lead(F.struct("pos", "s"), 2).over(alike))})
    pair = lambda a, b: F.concat(a, b).isin("()", "[]", "{}")
    mate = F.when(pair(F.col("s"), F.col("_next.s")), F.col("_next.pos")).when(pair(F.col("_last.s"), F.col("s")), F.col("_last.pos"))
    rows = rows.withColumn("mate", mate).withColumn("ahead", F.lag(F.when(F.col("mate").isNotNull(), F.col("_last"))).over(order)).drop("_next", "_last", "_after")
    # a bracket is the first or last token of its own inside
    inside = Window.partitionBy("script_id", "_key").orderBy("pos")
    rows = rows.withColumn("_key", F.col("level") + F.col("_bracket").cast("int"))
    held = F.last(F.when(opens, F.struct("pos", "s")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    side = _operand(F.col("s")) & ((_operand(F.col("p1")) & ~F.startswith("s", F.lit("`"))) | F.col("p1").isin(*_CLOSE)) | (F.col("s").isin("const", "let", "var", "return", "function", "class", "export", "import") & (_operand(F.col("p1")) | F.col("p1").isin(*_CLOSE)))
    stops = F.col("s").isin(",", ";") | closes | side
    back = Window.partitionBy("script_id", "_key").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_up": held, "stop": F.last(F.when(stops, F.col("pos")), ignorenulls=True).over(back)})
    own = Window.partitionBy("script_id", "_key", "_up.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("k", F.sum((F.col("s") == ",").cast("int")).over(own))
    return rows.select("script_id", "pos", "s", *(f"p{k}" for k in range(1, AHEAD + 1)), "n1", "level", "mate", F.col("_up.pos").alias("up"), F.col("_up.s").alias("up_s"), "k", "stop", "ahead", "body", "_bracket")


def error_counts(rows: DataFrame) -> DataFrame:
    """script_id, error_count: brackets without a partner, of scripts that have tokens."""
    alone = F.col("_bracket") & F.col("mate").isNull()
    return rows.groupBy("script_id").agg(F.sum(alone.cast("int")).cast("int").alias("error_count"))


def items(rows: DataFrame) -> DataFrame:
    """script_id, up, k, from, to: what stands between the commas of each bracket; empty items are none."""
    begins = rows.filter((F.col("_bracket") & F.col("s").isin(*_OPEN)) | (F.col("s") == ","))
    return begins.select("script_id", "up", "k", (F.col("pos") + 1).alias("from"), (F.col("stop") - 1).alias("to")).filter("to >= from and up is not null")


def cut(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (script_id, parts: array of from, to) with ``terms``: the tokens of each part.

    The spans of a script meet its tokens as one list. A name that is short for a property of that name is spelled out
    (``{a}`` as ``a:a``), so names can be replaced.
    """
    short = is_word(F.col("s")) & (F.col("up_s") == "{") & F.col("p1").isin("{", ",") & F.col("n1").isin("}", ",")
    spelled = F.when(short, F.concat("s", F.lit(":"), "s")).otherwise(F.col("s"))
    texts = rows.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("pos", spelled.alias("s")))).alias("_t"))
    lists = spans.groupBy("script_id").agg(F.collect_list(F.struct(*(c for c in spans.columns if c != "script_id"))).alias("_x"))
    both = lists.join(texts.select("script_id", F.transform("_t", lambda t: t["s"]).alias("_t")), "script_id")
    kept = [c for c in spans.columns if c not in ("script_id", "parts")]
    terms = lambda x: F.transform(x["parts"], lambda p: F.slice(F.col("_t"), p["from"] + 1, p["to"] - p["from"] + 1))
    return both.select("script_id", F.inline(F.transform("_x", lambda x: record(**{c: x[c] for c in kept}, terms=terms(x)))))


def rendered(term: Column) -> Column:
    """The tokens of a term as a text: spaces stand between words only."""
    wordy = r"[\p{L}\p{N}_$]"
    spaced = F.transform(term, lambda t, i: F.when((i > 0) & F.get(term, i - 1).rlike(wordy + r"\z") & t.rlike("^" + wordy), F.concat(F.lit(" "), t)).otherwise(t))
    return F.array_join(spaced, "")


__all__ = ["BASE_KEYS", "COMMENT", "KEYWORDS", "NOT_CALLED", "QUOTED", "Structure", "TOKEN", "WORD", "cut", "error_counts", "in_rows", "is_word", "items", "letter", "lists", "nested", "ranges", "rendered", "tokens"]
