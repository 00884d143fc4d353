"""Language identification by error-correcting output codes.

Every language has a codeword. A linear classifier over byte n-grams (one to three bytes of the lower-cased text, other
ASCII than letters as spaces) predicts each bit of it. Decoding sums, for every codeword, the logistic losses of the
predicted bits weighted by how well each bit's classifier does on its sample; the nearest codeword wins, and a text
whose two nearest codewords are about as near is flagged as ambiguous.

The classifiers are fitted on ``SAMPLE_ROWS`` whole texts, or ``LEAST_PER_LANGUAGE`` of each language if those are more, chosen by
a hash of doc_id with equal shares for the languages (expected; twice as many at most). Every language that has a text to
learn from is learned: the code grows with the logarithm of their number. Every whole text is predicted.

Defined results: a text that is null or has no letter is ``und`` with score 0. Rows without doc_id are predicted like
others, are not held out and are not learned from. Without any row to learn from, or without a column ``lang``, every text is
``und``. Repeated rows and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_rows, fold, gives_back, keep
from brindle.llm.shingles import in_chunks

#: Texts from which the classifiers are fitted (expected; twice as many at most).
SAMPLE_ROWS = 1600
BUCKETS = 1 << 13
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Texts of a language, if it has as many.
LEAST_PER_LANGUAGE = 8
#: Bytes of texts whose n-grams are looked up at once (a longer text is whole): each of their bytes has three rows of weights.
CHUNK_BYTES = 1 << 16
#: Softmax share below which the nearest codeword is ambiguous.
SURE = 0.6

_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def codewords(k: int) -> np.ndarray:
    """A row of bits (-1, 1) for each of ``k`` languages; the first bit of no column is alone among equal columns."""
    if k < 2:
        return np.ones((k, 0), np.float32)
    if k <= 5:  # exhaustive: every way to part the languages in two
        cols = [[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for i in range(k)] for c in range(1, 1 << (k - 1))]
        return np.array(cols, np.float32).T
    bits, best, most = int(np.ceil(10 * np.log2(k))), None, 0
    for seed in range(200):
        r = np.random.default_rng(seed)
        m = np.where(r.random((k, bits)) < 0.5, -1, 1).astype(np.float32)
        flat = np.abs(m.sum(axis=0)) == k  # a bit that all have alike says nothing: one of them is turned
        m[r.integers(0, k, int(flat.sum())), np.flatnonzero(flat)] *= -1
        apart = int((bits - m @ m.T)[np.triu_indices(k, 1)].min()) // 2
        if apart > most:
            best, most = m, apart
    return best


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at each byte (three rows) and where each text begins (one more than texts)."""
    low = [(b" " + (t.lower() if t.isascii() else t.decode().lower().encode()) + b"  ").translate(_PLAIN) for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    b = np.frombuffer(b"".join(low), np.uint8).astype(np.uint32)
    one, two = b[1:], b[2:]
    n = len(b)
    pair, triple = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    pair[:-1] = b[:-1] * np.uint32(257) + one
    triple[:-2] = pair[:-2] * np.uint32(263) + two
    rows = [b, ((pair * np.uint32(0x9E3779B1)) >> np.uint32(19)), ((triple * np.uint32(0x85EBCA6B)) >> np.uint32(19))]
    blank = np.zeros(n, bool)
    blank[:-1] = (b[:-1] == 32) & (one == 32)
    blank[-1:] = True
    rows = np.stack([np.where(blank, BUCKETS, r) for r in rows])  # runs of spaces count nothing
    return rows, np.concatenate([[0], np.cumsum(sizes)])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, share, ids = [], [], batch.column(0)
        for _, texts in in_chunks(batch.column(1), 1 << 18):
            rows, first = grams(texts)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                count = np.bincount(rows[:, a:b].ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                used = np.flatnonzero(count)
                at.append(used.astype(np.int32))
                share.append((count[used] / max(1, count.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["lang", "at", "share"])


def _fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of every bit at once, by Adam on all rows; x is standardised inside."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-4
    x = (x - mean) / spread
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        g = x.T @ pull + 1e-3 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.003 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        b -= 0.5 * pull.sum(axis=0)
    w = (w.T / spread).T
    return w.astype(np.float32), (b - mean @ w).astype(np.float32)


class LanguageCodes:
    """Languages, their codewords, and the classifiers of the bits."""

    def __init__(self, names: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray, weight: np.ndarray):
        self.names, self.code, self.b, self.weight = names, code, b, weight
        self.w = np.concatenate([w, np.zeros((1, w.shape[1]), np.float32)])

    @classmethod
    def fit(cls, docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageCodes:
        if "lang" not in docs.columns:
            return cls([], np.ones((0, 0), np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
        known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
        counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
        names = sorted(counts)
        if not names:
            return cls([], np.ones((0, 0), np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
        per = max(LEAST_PER_LANGUAGE, rows // len(names))
        rows = per * len(names)
        share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, per / counts[n]))])
        drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
        part = known.select("lang", "text", drawn.alias("u")).filter(F.col("u") < share[F.col("lang")])  # other languages have no share
        part = part.orderBy("u", "lang", F.xxhash64("text")).limit(2 * rows).select("lang", "text")
        got = part.mapInArrow(_sample, "lang string, at array<int>, share array<float>").toArrow()
        x = np.zeros((got.num_rows, BUCKETS), np.float32)
        for i, (at, value) in enumerate(zip(got["at"], got["share"], strict=True)):
            x[i, at.values.to_numpy()] = value.values.to_numpy()
        code = codewords(len(names))
        y = code[[names.index(v) for v in got["lang"].to_pylist()]]
        w, b = _fit_bits(x, y)
        right = ((x @ w + b) * y > 0).mean(axis=0) if len(x) else np.ones(y.shape[1])
        return cls(names, code, w, b, np.log((right + 0.01) / (1.01 - right)).clip(0.1, None))

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        if not self.names:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        rows, first = grams(texts)
        total = sum(np.add.reduceat(self.w[r], first[:-1], axis=0) for r in rows)
        seen = sum(np.add.reduceat((r < BUCKETS).astype(np.float32), first[:-1]) for r in rows)
        z = total / np.maximum(seen, 1)[:, None] + self.b
        loss = np.stack([(self.weight * np.logaddexp(0, -z * c)).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        out = []
        for t, k, row in zip(texts, best.tolist(), p, strict=True):
            if _LETTER.search(t.decode()):
                out.append((self.names[k], float(row[k]), bool(row[k] < SURE)))
            else:
                out.append((UNKNOWN, 0.0, True))
        return out


def _predict(model: LanguageCodes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, texts in in_chunks(batch.column(1), CHUNK_BYTES) for x in model.predict(texts)]
            lang, score, doubt = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def predict_languages(docs: DataFrame, model: LanguageCodes | None = None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous: one row per input row; fits on ``docs`` unless given a model."""
    model = model or LanguageCodes.fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(gives_back(_predict(model)), "doc_id long, lang_pred string, score double, ambiguous boolean")


def with_known_language(docs: DataFrame, model: LanguageCodes | None = None) -> DataFrame:
    """The rows of ``docs`` for which a language is told, with the columns of ``docs``; null ids and repeated rows change nothing.

    The codes tell one for every text with letters, so texts without any go. Where nothing can be learned (no label, no column
    ``lang``) no language is told for any text, which is no verdict on them: then the letters alone decide. Rows are worked
    out at once, in small batches: whole rows pass through Python.
    """
    model = model or LanguageCodes.fit(docs)
    if not model.names:
        return keep(docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))), "language")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            ok = [x[0] != UNKNOWN for _, texts in in_chunks(column, CHUNK_BYTES) for x in model.predict(texts)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    with arrow_rows(docs.sparkSession):
        return keep(docs.mapInArrow(gives_back(run), schema), "language")


__all__ = ["LanguageCodes", "codewords", "predict_languages", "with_known_language"]
