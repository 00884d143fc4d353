"""HTML extraction: gradient-boosted trees over features of DOM nodes, decoded hierarchically.

Every block element and every run of text between block boundaries is a node with features: text and link density of
its subtree, tokens of its class, id and role and of its ancestors', depth, place among its siblings and their share
of text. Boosted trees give the probability that a node holds main text. Decoding takes the likeliest choice of nodes
in which no kept node has a dropped ancestor, so an element and what is in it can't contradict each other.

The trees are fitted on ``PAGES`` pages of a seeded generator, the same in every session; pages of the table are only
scored, each whole.

Ahead of the trees only what never is text of a page is left out: scripts, styles, the head, sources of frames and the
controls of forms (``html_nodes.UNSEEN``). Elements that a style or an attribute hides are judged by the trees like others;
formulas and drawings stand in their line.

Defined results: null html counts as empty; a page without main text has the empty text and 0 characters. ``<br>`` is
white space inside its block. Rows are independent of each other: ties, repeated rows, null ids and extra columns
change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.html_nodes import MadeUpPages, features, golden, parse

#: Made-up pages from which the trees are fitted.
PAGES = 700
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32


class BoostedTrees:
    """Logistic gradient boosting of complete binary trees over binned features."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float):
        self.trees, self.base = trees, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin k: x <= edge k
        flat = b + np.arange(m) * BINS
        base = float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight))))
        z, trees = np.full(n, base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (p - y), weight * p * (1 - p)
            where = np.zeros(n, np.int64)
            feature, limit = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf, np.float32)
            for level in range(DEPTH):
                size, first = 1 << level, (1 << level) - 1
                at = (where[:, None] * (m * BINS) + flat).ravel()
                sums = [np.bincount(at, weights=np.repeat(v, m), minlength=size * m * BINS).reshape(size, m, BINS).cumsum(axis=2) for v in (g, h)]
                lg, lh = sums[0][:, :, :-1], sums[1][:, :, :-1]
                tg, th = sums[0][:, :1, -1:], sums[1][:, :1, -1:]
                gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                gain[(lh < 1) | (th - lh < 1)] = 0
                for j, e in enumerate(edges):
                    gain[:, j, len(e) :] = 0
                best = gain.reshape(size, -1).argmax(axis=1)
                for k in range(size):
                    j, cut = divmod(int(best[k]), BINS - 1)
                    if gain[k, j, cut] > 1e-6:
                        feature[first + k], limit[first + k] = j, edges[j][cut]
                where = 2 * where + (x[np.arange(n), feature[first + where]] > limit[first + where])
            size = 1 << DEPTH
            leaf = -RATE * np.bincount(where, weights=g, minlength=size) / (np.bincount(where, weights=h, minlength=size) + 1)
            z += leaf[where]
            trees.append((feature, limit, leaf))
        return cls(trees, base)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            z += leaf[at - ((1 << DEPTH) - 1)]
        return z


@cache
def learned() -> BoostedTrees:
    """The trees of the made-up pages; an element weighs as much as the logarithm of its text."""
    pages = MadeUpPages(19)
    xs, ys = [], []
    for _ in range(PAGES):
        nodes = parse(pages.page(), marked=True)
        x, parent = features(nodes)
        xs.append(x)
        ys.append(golden(nodes, parent))
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    return BoostedTrees.fit(x, y, 0.5 + np.maximum(x[:, 3], 0) / 5)


def decode(logit: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The likeliest keeping of nodes (parents come first) in which every kept node's parent is kept."""
    worth = logit.astype(float)  # log p - log(1 - p): what keeping a node adds to dropping it and all below
    for i in range(len(worth) - 1, 0, -1):
        worth[parent[i]] += max(0.0, worth[i])
    kept = np.zeros(len(worth), bool)
    for i in range(len(worth)):
        kept[i] = worth[i] > 0 and (parent[i] < 0 or kept[parent[i]])
    return kept


def _extract(trees: BoostedTrees, group: int = 200):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, pages = [], [], batch.column(2)

            def settle(held=held, texts=texts) -> None:
                if not held:
                    return
                logit = trees.logits(np.concatenate([x for _, x, _ in held]))
                at = 0
                for nodes, x, parent in held:
                    kept = decode(logit[at : at + len(x)], parent)
                    at += len(x)
                    texts.append("\n".join(n.text for n, k in zip(nodes, kept, strict=True) if k and n.text))
                held.clear()

            size = 0
            for html in pages:
                nodes = parse(html.as_py() or "")
                held.append((nodes, *features(nodes)))
                size += len(nodes)
                if len(held) >= group or size > 50_000:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract(learned()), "page_id long, url string, text string, n_chars long")


__all__ = ["BoostedTrees", "decode", "extract_text", "learned"]
