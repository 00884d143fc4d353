r"""Gated recurrent language model with a class-factored softmax, and the add-one unigram base.

Tokens are the words ``[^\x20\x09-\x0D]+`` of the text after lower-casing A-Z, then one end. All training documents are
counted; the ``VOCABULARY`` most frequent words are outputs of their own, dealt to ``CLASSES`` classes. All others fall
into four classes by how they are written, and have the add-one probability of their count within their class. So a
token's probability is that of its class given the state, times that of the word in the class, and the probabilities
of all words (with one place for the unseen words of each of the four classes) sum to one.

The network starts at the unigram probabilities. It is fitted by truncated backpropagation: first briefly on
``SEED_ROWS`` documents, chosen by a hash of doc_id, in the driver, then in every partition on all its training documents; the partitions' weights
are averaged by their tokens.
Scoring carries the state across windows from the first token of a document to its end, however long it is.

Words are known by 64-bit hashes; counts of the ``HOT`` most frequent ones go to every task, those of the others are
joined by key, so no word's occurrences meet in one task. Defined results: a null text counts as empty: one end
token. Rows without doc_id are scored, are not held out and are not learned from. Rows that repeat a doc_id are rows
of their own. Without training documents every count is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, fold, keep
from brindle.llm.shingles import in_chunks, words

VOCABULARY, CLASSES, STATE = 1023, 31, 16
#: Most frequent words whose counts every task gets (16 bytes each).
HOT = 400_000
FOLDS, HELD_OUT = 7, 2
SEED_ROWS = 200
STEPS, STREAMS = 16, 256
#: Tokens whose logits are held at once.
AT_ONCE = 8192

_SLOTS = -(-(VOCABULARY + 1) // CLASSES)
_RARE = 4
#: Key of the end of a text; keys of words keep their two bits of shape at the bottom.
END = np.int64(-4)


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, an end after each text, and the number of tokens of each text."""
    hashed, first, shape = words(texts, shape=True)
    keys = (hashed.astype(np.int64) & np.int64(-4)) | shape
    counts = np.diff(first)
    return np.insert(keys, first[1:], END), counts + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in in_chunks(batch.column(0), 1 << 23):
            parts = [np.unique(token_keys(part)[0], return_counts=True) for _, part in in_chunks(pa.array(texts, pa.binary()))]
            key, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, weights=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class GatedModel:
    """Vocabulary, counts of the hot words, and the weights."""

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, rare: np.ndarray, hot: np.ndarray, hot_n: np.ndarray):
        """``rare``: four rows of occurrences and distinct words; ``hot`` is sorted."""
        order = np.argsort(vocabulary)
        self.sorted, self.id_of = vocabulary[order], order
        self.hot, self.hot_n = hot, hot_n
        self.rare = rare
        r = np.random.default_rng(5)
        size = len(vocabulary)
        word = np.full((CLASSES, _SLOTS), -30.0, np.float32)
        word[np.arange(size) % CLASSES, np.arange(size) // CLASSES] = np.log(counts + 0.5)
        mass = np.concatenate([np.bincount(np.arange(size) % CLASSES, weights=counts, minlength=CLASSES), rare[:, 0]])
        word -= np.log(np.exp(word).sum(axis=1, keepdims=True))
        self.w = {
            "in": (r.standard_normal((VOCABULARY + 1 + _RARE, 3 * STATE)) * 0.3).astype(np.float32),
            "u": (r.standard_normal((STATE, 3 * STATE)) * STATE**-0.5).astype(np.float32),
            "b": np.concatenate([np.ones(STATE), np.zeros(2 * STATE)]).astype(np.float32),
            "c": np.zeros((STATE, CLASSES + _RARE), np.float32), "cb": np.where((mass > 0) | (np.arange(len(mass)) >= CLASSES), np.log(mass + 0.5), -30).astype(np.float32),
            "o": np.zeros((CLASSES, STATE, _SLOTS), np.float32), "ob": word,
        }

    def packed(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.w.values()]).astype(np.float32).tobytes()

    def unpack(self, flat: np.ndarray) -> GatedModel:
        at = 0
        for k, v in self.w.items():
            self.w[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Outputs of the tokens: words of the vocabulary, then the four classes of the others."""
        rare = VOCABULARY + 1 + (keys & np.int64(3))
        if not len(self.sorted):
            return rare
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, self.id_of[at], rare)

    def _gates(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        s, hh = STATE, h @ self.w["u"]
        zr = _sigmoid(x[:, : 2 * s] + hh[:, : 2 * s])
        n = np.tanh(x[:, 2 * s :] + zr[:, s:] * hh[:, 2 * s :])
        return zr[:, :s], zr[:, s:], n, hh[:, 2 * s :]

    def _class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids <= VOCABULARY, ids % CLASSES, CLASSES + ids - VOCABULARY - 1)

    def _words(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Tokens of the vocabulary by class, where each class has them, their states and logits (a column for each token)."""
        order = np.argsort(own.astype(np.uint8), kind="stable")
        ends = np.searchsorted(own[order], np.arange(CLASSES + 1)).tolist()
        order, spans = order[: ends[-1]], list(zip(ends[:-1], ends[1:], strict=True))
        states, y = np.ascontiguousarray(h[order].T), np.empty((_SLOTS, len(order)), np.float32)
        for c, (a, b) in enumerate(spans):
            if a < b:
                np.matmul(self.w["o"][c].T, states[:, a:b], out=y[:, a:b])
                y[:, a:b] += self.w["ob"][c][:, None]
        return order, spans, states, y

    def log_probability(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of the class's probability times that of the word of the vocabulary within it."""
        out = np.empty(len(ids))
        for a in range(0, len(ids), AT_ONCE):
            out[a : a + AT_ONCE] = self._log_probability(h[a : a + AT_ONCE], ids[a : a + AT_ONCE])
        return out

    def _log_probability(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        own = self._class_of(ids)
        logits = self.w["c"].T @ h.T + self.w["cb"][:, None]
        logits -= logits.max(axis=0)
        out = logits[own, np.arange(len(ids))] - np.log(np.exp(logits).sum(axis=0))
        rows, _, _, y = self._words(h, own)
        y -= y.max(axis=0)
        out[rows] += y[ids[rows] // CLASSES, np.arange(len(rows))] - np.log(np.exp(y).sum(axis=0))
        return out

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of ``log_probability`` over each text; texts run side by side, longest first, in windows of ``STEPS``."""
        order = np.argsort(-counts, kind="stable")
        size, start = counts[order], (np.cumsum(counts) - counts)[order]
        h, total = np.zeros((len(order), STATE), np.float32), np.zeros(len(order))
        table, t, longest = self.w["in"] + self.w["b"], 0, int(counts.max(initial=0))
        ids = np.concatenate([ids, np.zeros(STEPS, ids.dtype)])
        while t < longest:
            active = int(np.searchsorted(-size, -t))  # texts longer than t
            states, tokens, who = [], [], []
            h = h[:active]
            for i in range(t, min(t + STEPS, longest)):
                a = int(np.searchsorted(-size, -i))
                now = ids[start[:a] + i]
                states.append(h[:a].copy())
                tokens.append(now)
                who.append(np.arange(a))
                z, _, n, _ = self._gates(table[now], h[:a])
                h[:a] = n + z * (h[:a] - n)
            who = np.concatenate(who)
            got = self.log_probability(np.concatenate(states), np.concatenate(tokens))
            total[:active] += np.bincount(who, weights=got, minlength=active)
            t += STEPS
        out = np.empty(len(order))
        out[order] = total
        return out

    def train(self, ids: np.ndarray, counts: np.ndarray, rate: float = 0.004) -> int:
        """One pass of truncated backpropagation by Adam over texts laid into parallel streams; tokens learned from."""
        fresh = np.zeros(len(ids), bool)
        fresh[np.cumsum(counts) - counts] = True
        streams = max(1, min(STREAMS, len(ids) // (4 * STEPS)))
        n = -(-len(ids) // streams)
        pad = n * streams - len(ids)  # at the end of the last streams; nothing is learned from it
        x, new = (np.concatenate([v, np.zeros(pad, v.dtype)]).reshape(streams, n) for v in (ids, fresh))
        real = (np.arange(n * streams) < len(ids)).reshape(streams, n)
        h = np.zeros((streams, STATE), np.float32)
        if not hasattr(self, "moments"):
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
            self.updates = 0
        for a in range(0, n, STEPS):
            part = slice(a, a + STEPS)
            g, h = self._window(x[:, part], new[:, part], real[:, part], h)
            self.updates += 1
            t, step = self.updates, rate / (1 + self.updates / 2000)
            for k, v in self.w.items():
                m, q = self.moments[k]
                m += 0.1 * (g[k] - m)
                q += 0.01 * (g[k] ** 2 - q)
                v -= step * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-6)
        return len(ids)

    def _window(self, ids: np.ndarray, new: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        s, w, steps = STATE, self.w, ids.shape[1]
        table, kept, before = w["in"] + w["b"], [], []
        for t in range(steps):
            h = h * ~new[:, t : t + 1]
            z, r, n, hn = self._gates(table[ids[:, t]], h)
            before.append(h)
            kept.append((z, r, n, hn))
            h = n + z * (h - n)
        states, flat = np.concatenate(before), ids.T.reshape(-1)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        own, scale = self._class_of(flat), real.T.reshape(-1).astype(np.float32)
        scale /= max(1, scale.sum())
        p = w["c"].T @ states.T + w["cb"][:, None]
        p = np.exp(p - p.max(axis=0))
        p /= p.sum(axis=0)
        p[own, np.arange(len(flat))] -= 1
        p *= scale
        g["c"], g["cb"] = states.T @ p.T, p.sum(axis=1)
        ds = p.T @ w["c"].T
        rows, spans, sorted_states, y = self._words(states, own)
        y = np.exp(y - y.max(axis=0))
        y /= y.sum(axis=0)
        y[flat[rows] // CLASSES, np.arange(len(rows))] -= 1
        y *= scale[rows]
        back = np.empty((s, len(rows)), np.float32)
        for c, (a, b) in enumerate(spans):
            if a < b:
                g["o"][c], g["ob"][c] = sorted_states[:, a:b] @ y[:, a:b].T, y[:, a:b].sum(axis=1)
                np.matmul(w["o"][c], y[:, a:b], out=back[:, a:b])
        ds[rows] += back.T
        ds = ds.reshape(steps, -1, s)
        dh, dx = np.zeros_like(h), np.empty((steps, len(h), 3 * s), np.float32)
        for t in reversed(range(steps)):
            z, r, n, hn = kept[t]
            dn = (1 - z) * dh * (1 - n * n)
            dz = (before[t] - n) * dh * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            dhh = np.concatenate([dz, dr, dn * r], axis=1)
            g["u"] += before[t].T @ dhh
            dh = (z * dh + dhh @ w["u"].T + ds[t]) * ~new[:, t : t + 1]
        dx = dx.reshape(-1, 3 * s)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
        g["in"][flat[order][heads]] = np.add.reduceat(dx[order], heads, axis=0)
        g["b"] = dx.sum(axis=0)
        for k in g:
            g[k] = np.clip(g[k], -1, 1)
        return g, h


def _tokens(model: GatedModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = [], []
    with np.errstate(over="ignore"):
        for _, texts in in_chunks(column):
            keys, n = token_keys(texts)
            ids.append(model.ids(keys))
            counts.append(n)
    return np.concatenate(ids), np.concatenate(counts)


def _learn(model: GatedModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows:
                seen += model.train(*_tokens(model, batch.column(0)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([model.packed()], pa.binary())], names=["n", "w"])

    return run


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for n, w in zip(group["n"], group["w"], strict=True))
    n = int(group["n"].sum())
    return pd.DataFrame({"n": [n], "w": [(total / n).astype(np.float32).tobytes()]})


def word_counts(docs: DataFrame) -> DataFrame:
    """key, n: occurrences of every token in ``docs``; equal words meet within each task first."""
    parts = docs.select("text").mapInArrow(_count, "key long, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def fit(s: Scratch, training: DataFrame, counts: DataFrame) -> GatedModel:
    """The model of the training documents whose words are ``counts``."""
    top = counts.orderBy(F.desc("n"), "key").limit(HOT).toArrow()
    keys, n = top["key"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(keys)
    pick = keys[: VOCABULARY + 1]
    by = counts.groupBy(F.col("key").bitwiseAND(F.lit(3)).alias("r")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    rare = np.zeros((_RARE, 2))
    for row in by:
        mine = (pick & np.int64(3)) == row["r"]
        rare[row["r"]] = row["n"] - n[: len(pick)][mine].sum(), row["v"] - mine.sum()
    model = GatedModel(pick, n[: len(pick)].astype(np.float64), rare, keys[order], n[order])
    first = training.select("text", "doc_id").orderBy(F.xxhash64(F.lit("seed"), "doc_id"), "doc_id", F.xxhash64("text")).limit(SEED_ROWS)
    first = first.select("text").toArrow()["text"].combine_chunks()
    if len(first):
        for _ in range(3):
            model.train(*_tokens(model, first))
        bare = GatedModel(pick, n[: len(pick)].astype(np.float64), rare, keys[:0], n[:0]).unpack(np.frombuffer(model.packed(), np.float32))
        parts = training.select("text").mapInArrow(_learn(bare), "n long, w binary")
        parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(32)))
        means = s.keep(parts.groupBy("g").applyInPandas(lambda x: _mean(x[["n", "w"]]), "n long, w binary"), "weights").toPandas()
        if len(means):
            model.unpack(np.frombuffer(_mean(means)["w"][0], np.float32))
    return model


_SCORED = "doc_id long, n_tokens long, n_hot long, hot_sum double, lm double, cold array<long>, times array<long>"


def _score(model: GatedModel):
    shift = np.log10(model.rare.sum(axis=1) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts, rows = [], [], []
            with np.errstate(over="ignore"):
                for _, texts in in_chunks(batch.column(1)):
                    keys, n = token_keys(texts)
                    distinct, at = np.unique(keys, return_inverse=True)
                    place = np.minimum(np.searchsorted(model.hot, distinct), max(0, len(model.hot) - 1))
                    known = model.hot[place] == distinct if len(model.hot) else np.zeros(len(distinct), bool)
                    c = np.where(known, model.hot_n[place], 0) if len(model.hot) else np.zeros(len(distinct))
                    out = model.ids(distinct)
                    logs, hit, own = np.log10(c + 1)[at], known[at], out[at].astype(np.int16)
                    first = np.cumsum(n) - n
                    hot_sum, hot_n = np.add.reduceat(logs, first), np.add.reduceat(hit.astype(np.int64), first)
                    rare = own > VOCABULARY
                    lm = np.add.reduceat(np.where(rare, logs - shift[np.maximum(own - VOCABULARY - 1, 0)], 0.0), first)
                    cold = np.flatnonzero(~hit)
                    ends = np.searchsorted(cold, np.append(first, len(keys)))
                    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                        k, times = np.unique(keys[cold[a:b]], return_counts=True)
                        rows.append((int(n[i]), int(hot_n[i]), float(hot_sum[i]), float(lm[i]), k, times))
                    ids.append(own)
                    counts.append(n)
            lm = model.score(np.concatenate(ids).astype(np.int64), np.concatenate(counts)) / np.log(10)
            n, hot_n, hot_sum, fixed, cold, times = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hot_n, pa.int64()), pa.array(hot_sum), pa.array(lm + np.array(fixed)),
                 pa.array(cold, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row."""
    learn = F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False))
    training = docs.filter(learn).select("doc_id", "text")
    with Scratch(docs.sparkSession) as s:
        counts = s.keep(word_counts(training), "counts")
        total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).collect()[0]
        total = total or 0
        model = fit(s, training, counts)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), _SCORED)
        rows = s.keep(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
        cold = rows.select("_row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("_row", F.col("x.cold").alias("key"), "x.times")
        met = cold.join(counts, "key").groupBy("_row").agg(
            F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("times").alias("more"))
        n, logs = F.col("n_tokens"), F.coalesce("logs", F.lit(0.0))
        base = F.col("hot_sum") + logs - n * float(np.log10(total + distinct + 1))
        held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
        return keep(rows.drop("cold", "times").join(met, "_row", "left").select(
            "doc_id", held_out.alias("held_out"), n.alias("n_tokens"), (F.col("n_hot") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lm") + logs).alias("score")), "scores")


__all__ = ["GatedModel", "fit", "score_documents", "token_keys", "word_counts"]
