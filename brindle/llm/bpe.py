"""BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged over, so it marks a certain cut. Words
are cut there, the fragments are encoded independently of each other, many at once, and their tokens concatenated.
White space is a forced boundary of the vocabulary too (no token holds any), so equal words are encoded once per task.

Defined results: a null text counts as empty and has no tokens. Texts of any length are encoded whole. Rows are
independent of each other: ties, repeated rows, null ids and extra columns change nothing, an empty table gives an
empty result. Special tokens of the vocabulary are recognised in the text, as the vocabulary file says.
"""

from __future__ import annotations

import hashlib
import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shingles import in_chunks

#: Runs, and words, whose encoding a worker remembers at most, from task to task; beyond it only those at hand stay.
REMEMBERED = 250_000
#: Bytes of text whose new words are encoded together.
CHUNK_BYTES = 1 << 22
#: Longer fragments are merged with a heap instead of together with others.
TOGETHER = 96

# Unicode's white space, which is narrower than that of str.split.
_SPACES = r"[\t-\r \x85\xa0  -     　]+"
_ODD = regex.compile(r"[\x1c-\x1f]")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", regex.V1)
_NONE = np.uint32(0xFFFFFFFF)


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder of one vocabulary file with end-of-word tokens; read lazily, once in each Python worker."""

    _open: dict[str, ForcedBoundaryBPE] = {}

    @classmethod
    def at(cls, path: str) -> ForcedBoundaryBPE:
        if path not in cls._open:
            with open(path, encoding="utf-8") as f:
                cls._open[path] = cls(json.load(f))
        return cls._open[path]

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        chars = byte_characters()
        self.byte = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([self.vocab[c] for c in chars], np.uint32)
        self.last = np.array([self.vocab[c + self.end] for c in chars], np.uint32)
        self.width = len(self.vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([self.vocab[a] * self.width + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.uint32)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.uint32), made[order]
        self.joined = np.zeros((256, 256), bool)
        for t in self.vocab:
            raw = [self.byte[c] for c in t.removesuffix(self.end)] if t not in self.byte else []
            for x, y in zip(raw[:-1], raw[1:], strict=True):
                self.joined[x, y] = True
        self.known: dict[str, bytes] = {}
        self.word: dict[bytes, bytes] = {}
        self.remembered: int | None = None  # REMEMBERED if None

    @functools.cached_property
    def token(self) -> dict[int, str]:
        return {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}

    @functools.cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and result of each pair, for long fragments."""
        pairs = (divmod(k, self.width) for k in self.key.tolist())
        return dict(zip(pairs, zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))

    def forget(self) -> None:
        """Encoded runs and words go; they are encoded anew when needed."""
        self.known, self.word = {}, {}

    def _most(self) -> int:
        return REMEMBERED if self.remembered is None else self.remembered

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], _NONE), at

    def _long(self, sym: list[int]) -> list[int]:
        """One long fragment: lowest rank first, leftmost first, with a heap over a linked list."""
        n = len(sym)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(sym[:-1], sym[1:], strict=True)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or (sym[i], sym[j]) != pair:
                continue
            sym[i], alive[j], after[i] = self.merges[pair][1], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (sym[a], sym[b])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], a, p))
        return [s for s, ok in zip(sym, alive, strict=True) if ok]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, in order, and how many each word has. Words are not empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        cut = np.concatenate([[True], (word[1:] != word[:-1]) | ~self.joined[raw[:-1], raw[1:]]])
        fragment = np.cumsum(cut) - 1
        heads = np.flatnonzero(cut)
        lengths = np.diff(np.concatenate([heads, [len(raw)]]))
        place = np.arange(len(raw))
        done_sym, done_at = [], []
        for f in np.flatnonzero(lengths > TOGETHER):
            tokens = self._long(sym[heads[f] : heads[f] + lengths[f]].tolist())
            done_sym.append(np.array(tokens, np.uint32))
            done_at.append(heads[f] + np.arange(len(tokens)))
        keep = np.repeat(lengths <= TOGETHER, lengths)
        sym, fragment, place = sym[keep], fragment[keep], place[keep]
        while len(sym):
            rank, at = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
            near = np.flatnonzero(fragment[1:] == fragment[:-1])
            rank[near], at[near] = self._find(sym[near], sym[near + 1])
            begin = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            size = np.diff(np.concatenate([begin, [len(sym)]]))
            best = np.repeat(np.minimum.reduceat(rank, begin), size)
            ended = best == _NONE
            done_sym.append(sym[ended])
            done_at.append(place[ended])
            hit = np.flatnonzero((rank == best) & ~ended)
            first = hit[np.concatenate([[True], fragment[hit[1:]] != fragment[hit[:-1]]])] if len(hit) else hit
            sym[first] = self.made[at[first]]
            stay = ~ended
            stay[first + 1] = False
            sym, fragment, place = sym[stay], fragment[stay], place[stay]
        where = np.concatenate(done_at)
        order = np.argsort(where, kind="stable")
        tokens, where = np.concatenate(done_sym)[order], where[order]
        return tokens, np.bincount(word[where], minlength=len(words))

    @staticmethod
    def normal(chunk: str) -> str:
        """Composed, then each character lower-cased on its own."""
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk)
        return "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()

    def words_of(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The words of all runs without white space, in order, and how many each run has."""
        plain = [c if c.isascii() else self.normal(c) for c in chunks]
        joined = "\n".join(plain)
        joined = joined.lower() if joined.isascii() else "\n".join([c.lower() if c.isascii() else c for c in plain])
        if _ODD.search(joined):
            found = [_WORD.findall(c) for c in joined.split("\n")]
            return [w.encode() for f in found for w in f], np.fromiter(map(len, found), np.int64, len(found))
        marked = (_WORD.sub(r"\g<0> ", joined) + "\n").encode()  # a space ends each word, a line feed each run
        buf = np.frombuffer(marked, np.uint8)
        ends = np.flatnonzero((buf == 32) | (buf == 10))
        runs = np.flatnonzero(buf[ends] == 10)
        return marked.split(), np.diff(runs, prepend=-1) - 1

    def learn(self, chunks: set[str]) -> None:
        """Encode and remember runs without white space."""
        names = list(chunks)
        words, counts = self.words_of(names)
        here = set(words)
        if len(self.word) > self._most():
            self.word = {w: self.word[w] for w in here & self.word.keys()}
        fresh = list(here - self.word.keys())
        if fresh:
            tokens, per = self.encode_words(fresh)
            raw, ends = tokens.astype("<u4").tobytes(), (4 * np.cumsum(per)).tolist()
            self.word.update(zip(fresh, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        parts = list(map(self.word.__getitem__, words))
        at, known = 0, self.known
        for name, n in zip(names, counts.tolist(), strict=True):
            known[name] = parts[at] if n == 1 else b"".join(parts[at : at + n])
            at += n

    def pieces(self, text: str) -> list[str]:
        """Runs without white space, or special tokens."""
        if "<" in text and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [*self.pieces(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self.pieces(text[at:])
        if _ODD.search(text):
            return [x for x in regex.split(_SPACES, text) if x]
        return text.split()

    def cut_up(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; afterwards ``known`` has all of them."""
        cut = [self.pieces(t) for t in texts]
        here = set().union(*cut)
        if len(self.known) > self._most():
            self.known = {c: self.known[c] for c in here & self.known.keys()}
        for s, i in self.specials.items():
            self.known[s] = np.uint32(i).astype("<u4").tobytes()
        wanted = here - self.known.keys()
        if wanted:
            self.learn(wanted)
        return cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = self.cut_up(texts)
        known = self.known
        return [b"".join(map(known.__getitem__, c)) for c in cut]


class _Written:
    """How known words are written: ids in decimal, and their tokens as decoded; both joined by one space."""

    def __init__(self, coder: ForcedBoundaryBPE):
        self.coder, self.ids, self.text = coder, {}, {}
        top = max(coder.token) + 1
        self.number = [str(i) for i in range(top)]
        self.token = [coder.token.get(i, "") for i in range(top)]

    def of(self, pieces: list[list[str]]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.text.clear()
        for p in set().union(*pieces) - self.ids.keys():
            ids = np.frombuffer(self.coder.known[p], "<u4").tolist()
            self.ids[p] = " ".join([self.number[i] for i in ids])
            self.text[p] = " ".join([self.token[i] for i in ids])


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ForcedBoundaryBPE.at(path)
        written = _Written(coder)
        for batch in batches:
            counts, ids, texts = [], [], []
            for _, part in in_chunks(batch.column(1), CHUNK_BYTES):
                cut = coder.cut_up([t.decode() for t in part])
                written.of(cut)
                for c in cut:
                    numbers = " ".join(filter(None, map(written.ids.__getitem__, c)))
                    counts.append(numbers.count(" ") + 1 if numbers else 0)
                    ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                    texts.append(hashlib.sha256(" ".join(filter(None, map(written.text.__getitem__, c))).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of long): the tokens of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ForcedBoundaryBPE.at(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for _, part in in_chunks(batch.column(1), CHUNK_BYTES) for x in coder.encode([t.decode() for t in part])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the tokens of ``ids`` joined by one space, as the vocabulary (which names no decoder) has it; unknown ids are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = ForcedBoundaryBPE.at(path).token
        for batch in batches:
            texts = [" ".join(token[i] for i in ids or () if i in token) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


__all__ = ["ForcedBoundaryBPE", "decode_ids", "encode_digest", "encode_ids"]
