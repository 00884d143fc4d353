"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded by a learned table; learned filters slide over windows of ``WINDOW`` bytes, every ``STEP`` bytes.
A text is covered whole by chunks of ``2 * HALF`` bytes that overlap by half; in each chunk every filter keeps its
largest response. Mean, largest and smallest of the chunks' responses, and how much text there was to respond to, go
through one hidden layer to one probability.

The network is fitted on at most ``2 * SAMPLE_ROWS`` whole labelled texts (``SAMPLE_ROWS`` expected), chosen by a hash
of doc_id with equal shares for both labels; short passages of them are learned from as well, so that a short text
isn't bad for being short. Every whole text is scored; inputs are its bytes alone.

Defined results: a null text counts as empty and gets the score of a text without any response. Rows without doc_id
are scored like others, are not held out and are not learned from; labels that are null or contradict each other are
not learned from. Without labels every score is 0.5. Repeated rows and extra columns change nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fold
from brindle.llm.shingles import in_chunks

#: Texts from which the network is fitted (expected; twice as many at most).
SAMPLE_ROWS = 1400
FOLDS, HELD_OUT = 4, 2
#: Score from which a text is predicted to be good.
GOOD = 0.7

#: Share of the loss that good texts have: most texts are good, and a good one lost is worse than a bad one kept.
WEIGHT = 0.65

EMBED, WINDOW, STEP, FILTERS, HALF, HIDDEN = 8, 8, 4, 24, 256, 16
_PER = HALF // STEP


class ByteNetwork:
    """Weights, forward pass and training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "e": normal(256, EMBED, scale=0.5), "f": normal(WINDOW * EMBED, FILTERS, scale=(WINDOW * EMBED) ** -0.5),
            "c": np.zeros(FILTERS, np.float32), "h": normal(3 * FILTERS + 2, HIDDEN, scale=(3 * FILTERS) ** -0.5),
            "d": np.zeros(HIDDEN, np.float32), "o": normal(HIDDEN, scale=HIDDEN**-0.5), "b": np.zeros(1, np.float32),
        }

    @staticmethod
    def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts padded with zero bytes to whole halves.

        Returns the bytes and where the halves of each text begin (one more than texts).
        """
        halves = np.array([max(2, -(-len(t) // HALF)) for t in texts])
        raw = b"".join(t.ljust(n * HALF, b"\0") for t, n in zip(texts, halves.tolist(), strict=True))
        return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(halves)])

    def pooled(self, raw: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each half, and in which window. Behind its last byte each text goes on with zeros."""
        e = self.p["e"][np.concatenate([raw, np.zeros(WINDOW - STEP, np.uint8)])]
        flat = np.ascontiguousarray(e).reshape(-1)
        n = len(raw) // STEP
        windows = np.lib.stride_tricks.as_strided(flat, (n, WINDOW * EMBED), (STEP * EMBED * 4, 4), writeable=False)
        out = windows @ self.p["f"]
        last = first[1:] * _PER - 1
        ends = np.zeros((len(last), WINDOW), np.uint8)
        ends[:, :STEP] = raw[last[:, None] * STEP + np.arange(STEP)]
        out[last] = self.p["e"][ends].reshape(len(last), -1) @ self.p["f"]
        out = out.reshape(-1, _PER, FILTERS)
        if not where:
            return out.max(axis=1) + self.p["c"], None
        at = out.argmax(axis=1)
        top = np.take_along_axis(out, at[:, None, :], axis=1)[:, 0, :]
        return top + self.p["c"], at

    def _head(self, half: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> dict:
        """From responses by half to a score for each text."""
        act = np.maximum(half, 0)
        pair = np.maximum(act[:-1], act[1:])  # chunk i: halves i and i + 1
        own = np.delete(np.arange(len(act)), first[1:] - 1)  # chunks inside one text
        chunks = pair[own[own < len(pair)]]
        begin = first[:-1] - np.arange(len(first) - 1)
        count = np.diff(np.concatenate([begin, [len(chunks)]]))
        stats = [np.add.reduceat(chunks, begin) / count[:, None], np.maximum.reduceat(chunks, begin), np.minimum.reduceat(chunks, begin)]
        much = [np.minimum(sizes / (2 * HALF), 1), np.log1p(sizes) / 10]
        x = np.concatenate([*stats, np.stack(much, axis=1).astype(np.float32)], axis=1)
        h = np.tanh(x @ self.p["h"] + self.p["d"])
        z = h @ self.p["o"] + self.p["b"]
        return {"act": act, "chunks": chunks, "own": own, "begin": begin, "count": count, "x": x, "h": h, "z": z}

    def score(self, texts: list[bytes]) -> np.ndarray:
        raw, first = self.layout(texts)
        half, _ = self.pooled(raw, first)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return 1 / (1 + np.exp(-self._head(half, first, sizes)["z"].astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        raw, first = self.layout(texts)
        half, at = self.pooled(raw, first, where=True)
        s = self._head(half, first, np.fromiter(map(len, texts), np.int64, len(texts)))
        g = {}
        dz = (weight * (1 / (1 + np.exp(-s["z"])) - y) / len(texts)).astype(np.float32)
        g["o"], g["b"] = s["h"].T @ dz, dz.sum(keepdims=True)
        dh = np.outer(dz, self.p["o"]) * (1 - s["h"] ** 2)
        g["h"], g["d"] = s["x"].T @ dh, dh.sum(axis=0)
        dx = dh @ self.p["h"].T
        text = np.repeat(np.arange(len(texts)), s["count"])
        mean, top, low = (s["x"][text, i * FILTERS : (i + 1) * FILTERS] for i in range(3))
        dm, dt, dl = (dx[text, i * FILTERS : (i + 1) * FILTERS] for i in range(3))
        dc = dm / s["count"][text][:, None] + dt * (s["chunks"] == top) + dl * (s["chunks"] == low)
        own = s["own"][: len(dc)]
        left = s["act"][own] >= s["act"][own + 1]
        da = np.zeros_like(s["act"])
        np.add.at(da, own, dc * left)
        np.add.at(da, own + 1, dc * ~left)
        da *= s["act"] > 0
        g["c"] = da.sum(axis=0)
        byte = (np.arange(len(half))[:, None] * _PER + at) * STEP  # first byte of each kept window
        padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
        ending = np.isin(byte, first[1:] * HALF - STEP)
        df, de = np.zeros_like(self.p["f"]), np.zeros_like(self.p["e"])
        f = self.p["f"].reshape(WINDOW, EMBED, FILTERS)
        for k in range(WINDOW):
            b = np.where(ending & (k >= STEP), 0, padded[byte + k])  # halves x filters
            e = self.p["e"][b]
            df[k * EMBED : (k + 1) * EMBED] = np.einsum("hf,hfe->ef", da, e)
            np.add.at(de, b.ravel(), (da[:, :, None] * f[k].T[None]).reshape(-1, EMBED))
        g["f"], g["e"] = df, de
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 11) -> ByteNetwork:
        r = np.random.default_rng(seed)
        more = [(t[a : a + n], v) for t, v in zip(texts, y, strict=True) for n in [int(r.integers(15, 400))] for a in [int(r.integers(0, max(1, len(t) - n)))]]
        texts, y = texts + [t for t, _ in more], np.concatenate([y, np.array([v for _, v in more], np.float32)])
        share = y.mean()
        good, bad = WEIGHT / max(share, 1e-6), (1 - WEIGHT) / max(1 - share, 1e-6)
        weight = np.where(y > 0, good, bad).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                g = self.gradients([texts[i] for i in pick], y[pick], weight[pick])
                t += 1
                rate = 0.006 * (1 - t / (total + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7) + rate * 1e-3 * self.p[k]
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteNetwork | None:
    """A network fitted on labelled documents outside the held-out fold; None without any of them."""
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi").select("_id", F.col("lo").alias("y"))
    marks = marks.filter(fold(F.col("_id"), FOLDS) != HELD_OUT)
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, rows / 2 / counts.get(1, 1))).otherwise(min(1.0, rows / 2 / counts.get(0, 1)))
    chosen = marks.withColumn("u", drawn).filter(F.col("u") < share).orderBy("u", "_id").limit(2 * rows)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        "u", "_id", "y", F.coalesce("text", F.lit("")).alias("text")).orderBy("u", "_id", "text").limit(2 * rows).toArrow().to_pylist()
    y = np.array([r["y"] for r in got], np.float32)
    return ByteNetwork().fit([r["text"].encode() for r in got], y) if len(got) else None


def _scores(net: ByteNetwork | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if net is not None:
                for at, texts in in_chunks(batch.column(1), 1 << 19):
                    score[at : at + len(texts)] = net.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """doc_id, score: one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scores(net), "doc_id long, score double")


__all__ = ["ByteNetwork", "GOOD", "fit_quality", "score_quality"]
