r"""Personal data in texts: patterns propose spans, checksums confirm them, context words move their score.

Everything is a per-row expression of built-in functions: no shuffle, no Python on the executors.

Base kinds, leftmost and non-overlapping per kind: email, ip, card (Luhn), phone. The engine's own patterns
below match exactly what the plain ones do; a look-behind (or ``\G``, the end of the match before) keeps the
matcher from trying every start inside a run, and possessive quantifiers keep it from backtracking in one.

Added spans, never overlapping a base span of their kind:

* card: whole runs of 13 to 19 digits inside a longer digit chain that failed as one card (Luhn);
* phone: a bracketed area-code number inside a longer chain that failed as one phone, or one without ``+``
  whose score a context word lifts over the threshold;
* iban: country code, check digits and mod 97.

Offsets count code points, ends are exclusive. A null text counts as empty and has no spans; rows are
independent of each other, so ties, repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.matches import let, once, record, running

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban")

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

CARD_INNER = r"(?<![0-9])[0-9]{13,19}(?![0-9])"
PHONE_INNER = r"\+[0-9]{1,3}[\x20-]?\([0-9]{2,4}\)[\x20-]?[0-9]{3}[\x20-][0-9]{4}(?![0-9])"
PHONE_LOCAL = r"(?<![0-9+.(-])\([0-9]{3}\)[\x20-]?[0-9]{3}-[0-9]{4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

#: Score of a bare pattern, what a passed checksum and a nearby context word add, and what a span needs to count.
PATTERN_SCORE, CHECKSUM_SCORE, CONTEXT_SCORE, THRESHOLD = 0.4, 0.4, 0.2, 0.6
#: Characters before a span in which context words are looked for.
CONTEXT_CHARS = 40
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write to)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|mastercard|amex)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|mobile|call|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
}

def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,m:string>>")


def _located(matches: Column, gaps: Column) -> Column:
    """Spans of matches from the lengths of the matches and of the text between them."""
    sized = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, gap: record(m=m, gap=F.char_length(gap), n=F.char_length(m)))

    def placed(x: Column) -> Column:
        ahead = running(F.transform(x, lambda v: v["gap"] + v["n"]))
        return F.zip_with(x, ahead, lambda v, at: record(start=at + v["gap"], end=at + v["gap"] + v["n"], m=v["m"]))

    return F.when(F.size(matches) > 0, let(sized, placed)).otherwise(_none())


def _search(text: Column, pattern: str) -> Column:
    return _located(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    back = F.reverse(_digits(m))

    def add(acc, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(back)), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """The check of an IBAN: letters count from 10, the first four characters go last, the rest of 97 is 1."""
    bare = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4))

    def add(acc, c):
        code = F.ascii(c)
        return F.when(code <= 57, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _count_between(m: Column, low: int, high: int) -> Column:
    return F.char_length(_digits(m)).between(low, high)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(IP_PARTS),
    "card": lambda m: _count_between(m, 12, 19) & luhn(m),
    "phone": lambda m: _count_between(m, 9, 15),
}


def _that(spans: Column, test) -> Column:
    return F.filter(spans, lambda s: test(s["m"]))


def _inner(failed: Column, pattern: str) -> Column:
    """Matches of ``pattern`` inside spans that failed, at their places in the text."""
    return F.flatten(F.transform(failed, lambda s: F.transform(
        _search(s["m"], pattern), lambda t: F.struct(
            (s["start"] + t["start"]).alias("start"), (s["start"] + t["end"]).alias("end"), t["m"].alias("m")))))


def _apart(spans: Column, taken: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def pii_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``spans``: array of (start, rank, end, kind, base, score), by start and then kind. One row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(key, text.alias("_t"))
    gates = {
        "email": F.col("_t").contains("@"), "ip": F.col("_t").rlike(r"[0-9]\.[0-9]"),
        "card": F.col("_t").rlike("[0-9]"), "phone": F.col("_t").contains("+"),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    rows = rows.select("*", *(g.alias(f"_g_{k}") for k, g in gates.items()))
    rows = rows.select(
        "*",
        *(F.when(F.col(f"_g_{k}"), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).alias(f"_m_{k}") for k, p in patterns.items()),
    )
    some = {k: F.size(F.coalesce(F.col(f"_m_{k}"), F.array().cast("array<string>"))) > 0 for k in patterns}
    rows = rows.select("*", *(F.when(some[k], F.split("_t", p, -1)).alias(f"_s_{k}") for k, p in patterns.items()))
    rows = rows.select(key, "_t", "_g_card", *(
        F.when(F.col(f"_s_{k}").isNotNull(), _located(F.col(f"_m_{k}"), F.col(f"_s_{k}"))).otherwise(_none()).alias(f"_{k}") for k in patterns))

    rows = rows.select("*", *(_that(F.col(f"_{k}"), VALID[k]).alias(f"_ok_{k}") for k in patterns))
    failed = {k: _that(F.col(f"_{k}"), lambda m, k=k: ~VALID[k](m)) for k in ("card", "phone")}
    more = {
        "card": F.filter(_inner(failed["card"], CARD_INNER), lambda s: luhn(s["m"])),
        "phone": F.concat(
            _inner(failed["phone"], PHONE_INNER),
            F.when(F.col("_g_card"), _apart(_search(F.col("_t"), PHONE_LOCAL), F.col("_phone"))).otherwise(_none())),
        "iban": F.when(F.col("_g_card"), F.filter(_search(F.col("_t"), IBAN), lambda s: mod97(s["m"]))).otherwise(_none()),
    }

    def scored(spans: Column, kind: str, base: bool) -> Column:
        def one(s):
            from_ = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
            near = F.substring(F.col("_t"), from_ + 1, s["start"] - from_).rlike(CONTEXT[kind])
            bare = kind == "phone"
            sure = F.lit(True) if not bare else s["m"].startswith("+")
            score = F.lit(PATTERN_SCORE) + F.when(sure, CHECKSUM_SCORE).otherwise(0.0) + F.when(near, CONTEXT_SCORE).otherwise(0.0)
            return F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"),
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.round(score, 2).alias("score"))
        return F.transform(spans, one)

    spans = [scored(F.col(f"_ok_{k}"), k, True) for k in patterns]
    spans += [scored(m, k, False) for k, m in more.items()]
    wanted = F.filter(F.array_sort(F.concat(*spans)), lambda s: s["base"] | (s["score"] >= THRESHOLD))
    return rows.select(key, wanted.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, the hash of their listing, and the listing of all spans."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind; the columns and the other rows stay as they are.

    Spans of different kinds that overlap are replaced as one, by the kind of the first. Null texts stay null; rows without a
    doc_id or that repeat one are rows like others.
    """
    keyed = pii_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text"), "_row")
    before, after = mark.split("{}")
    top = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0))
    keyed = once(keyed, _done=running(F.transform("spans", lambda s: s["end"]), F.greatest), _top=top, _whole=F.col("_row.text"))

    def piece(s: Column, at: Column) -> Column:
        gap = F.substring(F.col("_whole"), at + 1, s["start"] - at)
        return F.when(s["start"] >= at, F.concat(gap, F.lit(before), F.upper(s["kind"]), F.lit(after))).otherwise("")

    shown = F.array_join(F.zip_with("spans", "_done", piece), "")
    rest = F.substring(F.col("_whole"), F.col("_top") + 1, F.char_length("_whole"))
    clean = F.when(F.size("spans") > 0, F.concat(shown, rest)).otherwise(F.col("_whole"))
    return keyed.select(*(clean.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
