"""Phrases, conversations and packing by powers of two against plain versions."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brindle.llm import byte_bpe, conversations, phrases, power_packing, registry
from brindle.llm.byte_bpe import ByteLevelBPE
from brindle.llm.common import Scratch
from brindle.llm.registry import byte_vocabulary
from tests.against_sql import check
from tests.conftest import SF
from tests.llm.cases import none, table

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(byte_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in ByteLevelBPE.at(byte_vocabulary()).encode(texts)]


def test_byte_level_bpe_equals_the_library(library):
    r = np.random.default_rng(4)
    letters = list("abAB  \t\n'’sΣσİıſé0½!.<|>́\x1c\x85　日한😀ǅ\u0000​᠎")
    texts = ["".join(r.choice(letters, 40)) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 999, "<|endoftext|>A<|endoftext|>  b", "\0<|endoftext|>", "", " ", "\n", "\n\n a", " a\n b", "it's 'll x' don't.", "two words.\nNext, 12 (three)"]
    assert ids_of(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_byte_level_bpe_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", 600)
    for t in ("one two three four five six", "seven eight one", "two nine ten", "one ten two"):
        assert ids_of([t]) == [library.encode(t, add_special_tokens=False).ids]


def test_powers():
    for capacity in (1, 2, 8, 1024):
        for n in [*range(70), 1023, 1024, 1025, 5000]:
            pieces = list(power_packing.powers(n, capacity))
            assert [a for a, _ in pieces] == [sum(s for _, s in pieces[:i]) for i in range(len(pieces))] and sum(s for _, s in pieces) == n
            assert [s for _, s in pieces] == [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (n % capacity) >> b & 1]


def test_power_packing_equals_a_plain_version(spark, library):
    for df in (table(spark), spark.read.parquet(f"{SF}/documents.parquet"), none(spark)):
        want = collections.Counter()
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
            for at, size in power_packing.powers(len(ids)):
                want[r.doc_id, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids), size.bit_length() - 1, 0] += 1
        got = power_packing.power_sequences(df, byte_vocabulary()).collect()
        assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.bucket, r.offset) for r in got) == want
        assert len({r.sequence_id for r in got}) == len(got) and all(r.sequence_id >> 58 == r.bucket for r in got)


def test_buckets_are_written_with_their_ids(spark, library, tmp_path):
    power_packing.write_buckets(table(spark), byte_vocabulary(), str(tmp_path / "b"), 64)
    got = spark.read.parquet(str(tmp_path / "b")).collect()
    assert {len(r.ids) for r in got} == {1 << r.bucket for r in got} and max(r.length for r in got) == 64
    texts = collections.defaultdict(list)
    for r in got:
        texts[r.doc_id].append((r.start, r.ids))
    for r in table(spark).collect():
        if r.doc_id not in (None, 16):
            ids = [i for _, x in sorted(texts[r.doc_id]) for i in x]
            assert ids == library.encode(r.text or "", add_special_tokens=False).ids + [0]
    with pytest.raises(ValueError):
        power_packing.power_sequences(table(spark), byte_vocabulary(), 100)


PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def plain_collocations(rows, least=30, top=2000):
    """Every count at once, every longer candidate looked at."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in PIECE.split((text or "").translate(UP)):
            words = WORD.findall(piece)
            n[lang] += len(words)
            for d in range(1, 5):
                f.update((lang, *words[i : i + d]) for i in range(len(words) - d + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for (lang, *w), a in found.items():
        cuts = [(2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(q[0] == lang and len(q) > len(w) + 1 and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) and 100 * b >= 80 * a for q, b in found.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, x in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


def phrase_rows():
    r = np.random.default_rng(3)
    words = ["of", "the", "The", "é", "日本", "a\x01", "a", "b'c", "x" * 300]
    rows = [(i, " ".join(r.choice(words, 40)) + r.choice([".", "\t", "\n", ",", " ;"]) + " new york city hall\tof the  new york", ["en", "de", None, "und"][i % 4]) for i in range(120)]
    return rows + [(None, None, "en"), (1, "", "fr"), (1, " .\t", "fr"), (2, "of the " * 3000, "en"), (2, "of the " * 3000, "en")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, phrase string, f int")


def test_collocations_equal_a_plain_version(spark, monkeypatch):
    rows = phrase_rows()
    want = plain_collocations([(lang, t) for _, t, lang in rows])
    assert {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(frame(spark, rows)).collect()} == want and len(want) > 30
    assert {(r.lang, r.rank) for r in phrases.collocations(frame(spark, rows), top=3).collect()} == {(lang, rank) for lang, rank, *_ in want if rank <= 3}
    assert phrases.collocations(frame(spark, rows).limit(0)).collect() == []


def test_tries_that_are_full_begin_anew():
    rows = phrase_rows()
    columns = [pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows])]

    def counted():
        out = collections.Counter()
        for b in phrases._count(4, None, None)(iter([pa.RecordBatch.from_arrays(columns, names=["lang", "text"])])):
            for r in b.to_pylist():
                out[r["lang"], r["phrase"]] += r["f"]
        return out

    whole, before = counted(), (phrases.FLUSH_WORDS, phrases.CHUNK_BYTES)
    try:
        for phrases.FLUSH_WORDS, phrases.CHUNK_BYTES in ((50, 20), (7, 1), (400, 100), (1, 1000)):
            assert counted() == whole
    finally:
        phrases.FLUSH_WORDS, phrases.CHUNK_BYTES = before
    assert whole["en", "of the of the"] > 5000 and whole["en", "new york city"] == 30


def test_walks_give_the_counts_of_parts(spark):
    rows = [("en", len(p.split()), p, 10 * len(p) + 1) for p in {" ".join(w[:k]) for w in itertools.product("abc", repeat=4) for k in range(1, 5)}]
    f = {p: n for _, _, p, n in rows}
    found = spark.createDataFrame(rows, "lang string, depth int, phrase string, f long")
    with Scratch(spark) as s:
        got = phrases.with_parts(s, phrases.with_parts(s, found, "left", False), "right", True).collect()
    assert len(got) == len(rows)
    for r in got:
        w = r.phrase.split()
        assert list(r.left) == [f[" ".join(w[:k])] for k in range(1, len(w))] and list(r.right) == [f[" ".join(w[-k:])] for k in range(1, len(w))]


def plain_repair(turns, delete=2, insert=5):
    """Every sequence of edits, inserts three in a row at most; turns are (role, text, fault)."""
    best = []

    def go(i, shape, cost, audit, said, inserts):
        if not re.fullmatch("s?(ua)*u?", shape):
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", shape):
            best.append((cost, audit, said))
        if inserts < 3:
            for role in ("user", "assistant"):
                go(i, shape + role[0], cost + insert, audit + "I", [*said, role + ":"], inserts + 1)
        if i < len(turns):
            role, text, fault = turns[i]
            go(i + 1, shape, cost + delete, audit + "D", said, 0)
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                go(i + 1, shape + role[:1] if role[:1] in ("s", "u", "a") else "x", cost + more, audit + "K", [*said, f"{role}:{text}"], 0)
                for other in ("user", "assistant"):
                    go(i + 1, shape + other[0], cost + 1 + more, audit + "R", [*said, f"{other}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    return min(best)


def test_inserts_where_they_pay(monkeypatch):
    monkeypatch.setattr(conversations, "DELETE", 7)
    monkeypatch.setattr(conversations, "INSERT", 3)
    monkeypatch.setattr(conversations, "ENDS", (0, 6, 3, 0))
    r, audits = np.random.default_rng(2), ""
    for _ in range(300):
        turns = [(["system", "user", "assistant", "tool"][r.integers(4)], "x", int(r.choice([0, 0, 0, 1, 3]))) for _ in range(r.integers(0, 5))]
        codes, faults = [{"s": 1, "u": 2, "a": 3}.get(t[0][0], 0) for t in turns], [t[2] for t in turns]
        go = conversations.costs(codes, faults, (0, 6, 3, 0))
        done, tail, _ = conversations.edits(codes, faults, go, 0)
        said = [x for _, x in conversations.lines([t[0] for t in turns], ["x"] * len(turns), codes, done, tail, 0)]
        assert (go[0][0], "".join(done) + tail, said) == plain_repair(turns, 7, 3)
        audits += "".join(done) + tail
    assert set(audits) == set("DIKR")


def plain_conversation(rows, conv):
    """The row of one conversation, from its rows (turn, role, text)."""
    turns = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    faults = []
    for i, (_, role, text) in enumerate(turns):
        bare = text.strip(" \t\n\x0b\f\r")
        faults.append(1 if not bare else 2 if (role, text) in [t[1:] for t in turns[:i]] else 3 if bare[-1] not in ".!?" else 0)
    known = {t for t, _, _ in turns if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, said = plain_repair([(r, t, f) for (_, r, t), f in zip(turns, faults)])
    return (max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def conversation_rows(n=150, most=4):
    r = np.random.default_rng(8)
    roles, texts = ["system", "user", "assistant", "tool", "admin", "", None, "user", "assistant"], ["One.", "Two", "Three! \n", " \t", None, "é?", "Four...", "One."]
    rows = []
    for conv in [*range(n), None]:
        for t in range(int(r.integers(1, most + 1))):
            turn = None if r.random() < 0.1 else int(t if r.random() < 0.9 else r.integers(0, 9))
            rows.append((conv, turn, roles[r.integers(len(roles))], texts[r.integers(len(texts))]))
    return rows


def conversation_table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, _c string").repartition(3)


def by_conversation(rows):
    own = collections.defaultdict(list)
    for conv, *row in rows:
        own[conv].append(tuple(row))
    return own


def test_repairs_equal_every_sequence_of_edits(spark):
    rows = conversation_rows()
    want = {conv: plain_conversation(own, conv) for conv, own in by_conversation(rows).items()}
    got = {r[0]: tuple(r[1:]) for r in conversations.repair_conversations(conversation_table(spark, rows)).collect()}
    assert got == want
    assert any(w[6] == "" for w in want.values()) and {c for w in want.values() for c in w[6]} == set("DKR")  # an insert never pays at these costs
    assert conversations.repair_conversations(conversation_table(spark, rows).limit(0)).collect() == []


def test_long_conversations_in_segments_equal_short_ones(spark):
    rows = conversation_rows(12, 30) + [(5, 40 + i // 3, "user", f"t{i % 90}.") for i in range(400)] + [(99, 3, "user", "Same.")] * 50 + [(4, i, ["user", "assistant"][i % 2], "Fine.") for i in range(100, 300)]
    docs = conversation_table(spark, rows)
    whole = {r[0]: tuple(r[1:]) for r in conversations.repair_conversations(docs, most=10**6).collect()}
    for most in (0, 5, 60):
        assert {r[0]: tuple(r[1:]) for r in conversations.repair_conversations(docs, most=most).collect()} == whole


@pytest.mark.parametrize("name", ["op11_phrases", "op12_conversations"])
def test_same_rows_as_sql(spark, name):
    assert check(spark, registry.queries()[name], registry.oracle_sql()[name], SF.replace("0.001", "0.01")) > 50
