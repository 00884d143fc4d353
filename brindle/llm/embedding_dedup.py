"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors are one class from the start. Centroids are fitted on a bounded sample; within each cluster, centres of cells
are picked from a sample of its own vectors, as many as its size asks for and no two of them within range of each other.
So cells stay small however many vectors there are, and only vectors that lie within range of one spot fill a large one.
Every class goes to the two nearest cells of its nearest cluster and to the nearest one of its second.

A cell with more than ``BLOCK`` classes is dealt to blocks of about that size by a hash. Each block builds its part of
the graph (the nearest candidates and a few far ones of every node, robust-pruned, reverse edges too); the adjacency
lists of a class from all its cells are united. Then every two blocks of a cell meet in one task: the classes of one
search the other, along the united lists, from its medoid, by a greedy beam search whose beam widens to everything within
range. Links are verified in double precision and counted in the first cell that both ends share; a task returns numbers
of links and, for the components, one row for each class that has any, never the links themselves. (The number of links
of each vector is part of the result, so within a crowd all pairs are looked at, block by block.)

Recall is audited against brute force over all vectors, from the numbers of links of a fixed sample of queries that grows
until ``SEEN`` of them have links. Below ``RECALL`` the graph is built anew, twice and four times as wide; if even the last is
below ``LEAST_RECALL``, the job fails. The figure is logged.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; a shorter
vector counts as padded with zeros. Rows without vec_id link with nothing and have a null component_id. Rows that
repeat a vec_id stay rows of their own; their vectors count as other vectors. Extra columns (labels too) are not looked
at. An empty table gives an empty result.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, keep, split_join
from brindle.llm.components import components

COSINE = 0.95
#: Vectors on which the centroids are fitted, and how many centroids there are at most.
SAMPLE_ROWS, MOST_CENTROIDS = 16_384, 2048
#: Vectors of a cluster from which centres of its cells are picked, at most, and those that are dealt to cells at once.
CELL_SAMPLE, CHUNK = 8192, 20_000
BLOCK, CELL, OVERLAP, DEGREE, BEAM, ALPHA = 1500, 3000, 2, 24, 24, 1.2
#: Queries of an audit at first and at most, how many of them should have links, and the recall asked for and the least.
AUDITED, MOST_AUDITED, SEEN, RECALL, LEAST_RECALL = 200, 3200, 50, 0.98, 0.9

_log = logging.getLogger(__name__)


def unit(rows: list, width: int | None = None) -> np.ndarray:
    width = width or max(map(len, rows), default=0)
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; empty clusters keep their centre."""
    c = sample[np.random.default_rng(3).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def robust_prune(near: np.ndarray, sim: np.ndarray, degree: int) -> list[int]:
    """Of candidates (nearest first) those to which no kept one is nearer by the factor ``ALPHA``.

    ``sim``: cosines of the candidates with the node (first column) and each other.
    """
    apart = np.sqrt(np.maximum(0, 2 - 2 * sim))
    alive, kept = np.ones(len(near), bool), []
    for i in range(len(near)):
        if alive[i]:
            kept.append(int(near[i]))
            if len(kept) == degree:
                break
            alive &= ALPHA * apart[i, 1:] > apart[:, 0]
            alive[: i + 1] = False
    return kept


def build(x: np.ndarray, degree: int) -> list[list[int]]:
    """Adjacency lists of the vectors of one block; edges go both ways, and a random tree keeps it connected.

    A list that reverse edges make longer than ``2 * degree`` is pruned again.
    """
    n = len(x)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    wide = min(n - 1, 2 * degree)
    r = np.random.default_rng(n)
    lists: list[set[int]] = [set() for _ in range(n)]
    if n < 2:
        return [[] for _ in range(n)]
    near = np.argpartition(-sim, wide - 1, axis=1)[:, :wide]
    far = r.integers(0, n, (n, 8))
    for i in range(n):
        pick = np.unique(np.concatenate([near[i], far[i][far[i] != i]]))
        pick = pick[np.argsort(-sim[i, pick], kind="stable")]
        among = sim[np.ix_(pick, pick)]
        np.fill_diagonal(among, 1)
        kept = robust_prune(pick, np.concatenate([sim[i, pick][:, None], among], axis=1), degree)
        kept += [int(j) for j in pick[: degree // 3]]  # the very nearest stay, so that copies of one another stay connected
        for j in kept:
            lists[i].add(j)
            lists[j].add(i)
    for i, own in enumerate(lists):
        if len(own) > 2 * degree:
            pick = np.fromiter(own, np.int64, len(own))
            pick = pick[np.argsort(-sim[i, pick], kind="stable")]
            among = sim[np.ix_(pick, pick)]
            np.fill_diagonal(among, 1)
            lists[i] = set(robust_prune(pick, np.concatenate([sim[i, pick][:, None], among], axis=1), 2 * degree))
    for i in range(1, n):
        j = int(r.integers(0, i))
        lists[i].add(j)
        lists[j].add(i)
    return [sorted(s) for s in lists]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def search(index: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of cosine >= ``least``: greedy from the medoid, then on through everything in range."""
    n, q = len(index), len(queries)
    degree = np.array([len(v) for v in lists])
    flat, begin = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64), np.cumsum(degree) - degree
    seen = np.zeros((q, n), bool)
    start = medoid(index)
    at = np.full((q, beam), -1)
    sim = np.full((q, beam), -3.0)
    done = np.ones((q, beam), bool)
    at[:, 0], sim[:, 0], done[:, 0] = start, queries @ index[start], False
    seen[:, start] = True
    found_q, found_n = [np.flatnonzero(sim[:, 0] >= least)], [np.full(int((sim[:, 0] >= least).sum()), start)]

    def some(who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = degree[nodes]
        pairs_n = flat[np.repeat(begin[nodes] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pairs_q = np.repeat(who, many)
        fresh = ~seen[pairs_q, pairs_n]
        both = np.unique(pairs_q[fresh] * n + pairs_n[fresh])
        pairs_q, pairs_n = both // n, both % n
        seen[pairs_q, pairs_n] = True
        cos = np.concatenate([np.einsum("ij,ij->i", queries[pairs_q[a : a + 16384]], index[pairs_n[a : a + 16384]]) for a in range(0, len(both), 16384)] or [np.empty(0)])
        inside = cos >= least
        found_q.append(pairs_q[inside])
        found_n.append(pairs_n[inside])
        return pairs_q, pairs_n, cos

    def reach(who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen neighbours of nodes, each once for each query and by query, with their cosines; half a million at a time."""
        parts, total, a = [], np.cumsum(degree[nodes]), 0
        while a < len(nodes):
            to = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 500_000)))
            parts.append(some(who[a:to], nodes[a:to]))
            a = to
        pairs_q, pairs_n, cos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(pairs_q, kind="stable")
        return pairs_q[order], pairs_n[order], cos[order]

    while True:
        best = np.where(done, -3.0, sim).argmax(axis=1)
        who = np.flatnonzero(~done[np.arange(q), best])
        if not len(who):
            break
        nodes = at[who, best[who]]
        done[who, best[who]] = True
        pq, pn, cos = reach(who, nodes)
        if not len(pq):
            continue
        rank = np.arange(len(pq)) - np.searchsorted(pq, pq)  # pq is sorted
        width = int(rank.max()) + 1
        new_at, new_sim = np.full((q, width), -1), np.full((q, width), -3.0)
        new_at[pq, rank], new_sim[pq, rank] = pn, cos
        all_at, all_sim = np.concatenate([at, new_at], axis=1), np.concatenate([sim, new_sim], axis=1)
        all_done = np.concatenate([done, new_at < 0], axis=1)
        top = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        at, sim, done = (np.take_along_axis(v, top, axis=1) for v in (all_at, all_sim, all_done))
    fq, fn = np.concatenate(found_q), np.concatenate(found_n)
    while len(fq):
        pq, pn, cos = reach(fq, fn)
        inside = cos >= least
        fq, fn = pq[inside], pn[inside]
    return np.concatenate(found_q), np.concatenate(found_n)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """cls (smallest vec_id), v (array of double), size: distinct usable vectors."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    return rows.groupBy("v").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("size"))


def separated(x: np.ndarray, most: int, least: float) -> np.ndarray:
    """Places of the first vectors no two of which are within range of each other, ``most`` at most."""
    kept = np.empty((min(most, len(x)), x.shape[1]))
    places: list[int] = []
    for i, v in enumerate(x):
        if len(places) == len(kept):
            break
        if not places or (kept[: len(places)] @ v).max() < least:
            kept[len(places)] = v
            places.append(i)
    return np.array(places, np.int64)


def _clustered(classes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """cls, v, cluster, near (0 for the nearest of its clusters)."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                top = np.argsort(-(unit(list(pdf["v"]), centres.shape[1]) @ centres.T), axis=1, kind="stable")[:, :overlap]
                yield pd.DataFrame({"cls": pdf["cls"], "v": pdf["v"], "clusters": list(top.astype(np.int32))})

    rows = classes.select("cls", "v").mapInPandas(run, "cls long, v array<double>, clusters array<int>")
    return rows.select("cls", "v", F.posexplode("clusters").alias("near", "cluster"))


def _cells(s: Scratch, classes: DataFrame, centres: np.ndarray, overlap: int, width: int, least: float) -> DataFrame:
    """cls, cell: the cells of each class."""
    rows = s.keep(_clustered(classes, centres, min(overlap, len(centres))), "clusters")
    sizes = s.keep(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster-sizes")  # a row per centroid
    many = F.ceil(F.col("n") / CELL)
    sizes = F.broadcast(sizes.select("cluster", "n", many.alias("many"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    drawn = F.pmod(F.xxhash64(F.lit("cell"), "cls"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(sizes, "cluster").withColumn("u", drawn).filter(F.col("u") * F.col("n") < F.least(4 * F.col("many"), F.lit(CELL_SAMPLE)))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["u", "cls"])
        at = separated(unit(list(group["v"]), width), int(group["many"].iloc[0]), least)
        return pd.DataFrame({"cluster": group["cluster"].iloc[0], "chunks": group["chunks"].iloc[0], "sub": np.arange(len(at)), "c": group["v"].iloc[at]})

    picked = sample.select("cluster", "cls", "u", "v", "many", "chunks").groupBy("cluster").applyInPandas(pick, "cluster int, chunks int, sub int, c array<double>")
    picked = s.keep(picked, "cell-centres").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = rows.join(sizes.select("cluster", "chunks"), "cluster").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))

    def assign(group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"cls": np.empty(0, np.int64), "cell": np.empty(0, np.int64)})
        own = own.sort_values("sub")
        first = int(group["cluster"].iloc[0]) << 32
        if len(own) < 2:  # one cell, or so few vectors that none was drawn
            return pd.DataFrame({"cls": group["cls"], "cell": first})
        top = np.argsort(-(unit(list(group["v"]), width) @ unit(list(own["c"]), width).T), axis=1, kind="stable")[:, :overlap]
        each = np.where(group["near"] == 0, top.shape[1], 1)
        flat = top[np.arange(top.shape[1]) < each[:, None]]
        return pd.DataFrame({"cls": np.repeat(group["cls"].to_numpy(), each), "cell": first + flat})

    return dealt.select("cluster", "chunk", "cls", "near", "v").groupBy("cluster", "chunk").cogroup(
        picked.select("cluster", "chunk", "sub", "c").groupBy("cluster", "chunk")).applyInPandas(assign, "cls long, cell long")


def _built(degree: int, width: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls")
        ids = group["cls"].to_numpy()
        lists = build(unit(list(group["v"]), width), degree)
        return pd.DataFrame({"node": ids, "near": [ids[v] for v in lists]})

    return run


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches over the links x - y."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        root = root[root]
        if (root == before).all():
            return root


def _shared_cell(x: list, y: list) -> np.ndarray:
    """The least common number of each two lists of a few numbers; -1 without one."""
    wide = max(len(v) for v in [*x, *y])
    a, b = (np.array([list(v) + [-1] * (wide - len(v)) for v in z], np.int64) for z in (x, y))
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for i in range(wide):
        both = (a[:, i] >= 0) & (a[:, i][:, None] == b).any(axis=1)
        out = np.where(both, np.minimum(out, a[:, i]), out)
    return np.where(out == none, -1, out)


def _searched(beam: int, width: int, least: float):
    """Links between two blocks of a cell, or within one: their numbers, and who is connected (a with b)."""
    empty = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "n": np.empty(0, np.int64)})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = (int(group[c].iloc[0]) for c in ("cell", "i", "j"))
        own = group[group["block"] == i].sort_values("cls")
        ask = own if i == j else group[group["block"] == j].sort_values("cls")
        if not len(own) or not len(ask):
            return empty
        ids = own["cls"].to_numpy()
        lists = []
        for near in own["near"]:
            near = np.asarray(near, np.int64)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            lists.append(at[ids[at] == near])
        q, n = search(unit(list(own["v"]), width), lists, unit(list(ask["v"]), width), beam, least)
        if i == j:  # found from either end
            q, n = np.divmod(np.unique(np.minimum(q, n)[q != n] * len(own) + np.maximum(q, n)[q != n]), len(own))
        if not len(q):
            return empty
        offset = 0 if i == j else len(own)
        names = np.concatenate([ids, ask["cls"].to_numpy()[: 0 if i == j else None]])
        root = _roots(len(names), n, q + offset)
        linked = np.flatnonzero(root != np.arange(len(root)))
        cells, asked = list(own["cells"]), list(ask["cells"])
        counted = np.concatenate([
            _shared_cell([cells[k] for k in n[at : at + 200_000]], [asked[k] for k in q[at : at + 200_000]]) == cell for at in range(0, len(q), 200_000)])
        q, n = q[counted], n[counted]
        size, asked_size = own["size"].to_numpy(), ask["size"].to_numpy()
        total = np.bincount(n, weights=asked_size[q], minlength=len(names)) + np.bincount(q + offset, weights=size[n], minlength=len(names))
        some = np.flatnonzero(total)
        return pd.concat([
            pd.DataFrame({"a": names[some], "b": np.full(len(some), -1), "n": total[some].astype(np.int64)}),
            pd.DataFrame({"a": names[linked], "b": names[root[linked]], "n": np.zeros(len(linked), np.int64)})])

    return run


def _links(s: Scratch, classes: DataFrame, count: int, width: int, more: int, least: float) -> tuple[DataFrame, DataFrame]:
    """cls, n (other vectors linked directly) of the classes with any; a, b: links that connect the same components."""
    overlap, degree, beam = OVERLAP * more, DEGREE * more, BEAM * more
    k = int(min(MOST_CENTROIDS, max(1, -(-count // CELL))))
    sample = classes.orderBy(F.xxhash64("cls")).limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    cells = s.keep(_cells(s, classes, centroids(unit(list(sample), width), k), overlap, width, least), "cells")
    sizes = s.keep(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    homes = split_join(cells, sizes, ["cell"], "n", ["cls"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    homes = homes.groupBy("cls").agg(F.collect_list(F.struct("cell", "block", "blocks")).alias("homes"))
    placed = s.keep(classes.join(homes, "cls"), "placed")
    each = placed.select("cls", "v", F.inline("homes"))
    made = each.groupBy("cell", "block").applyInPandas(_built(degree, width), "node long, near array<long>")
    graph = s.keep(made.groupBy(F.col("node").alias("cls")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    rows = placed.join(graph, "cls").select("cls", "v", "size", "near", F.col("homes.cell").alias("cells"), F.inline("homes"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "v", "size", "near", "cells")
    found = s.keep(rows.groupBy("cell", "i", "j").applyInPandas(_searched(beam, width, least), "a long, b long, n long"), "found")
    counts = s.keep(found.filter("n > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n")), "counts")
    return counts, found.filter("n = 0").select("a", "b")


def true_counts(classes: DataFrame, width: int, least: float = COSINE) -> dict[int, int]:
    """Other vectors within range of a fixed sample of classes, by brute force over all classes."""
    asked = AUDITED
    while True:
        some = classes.orderBy(F.xxhash64(F.lit("audit"), "cls")).limit(asked).select("cls", "v").toPandas()
        if not len(some):
            return {}
        ids, q = some["cls"].to_numpy(), unit(list(some["v"]), width)

        def run(batches, ids=ids, q=q):
            for pdf in batches:
                if len(pdf):
                    near = (q @ unit(list(pdf["v"]), width).T >= least) & (ids[:, None] != pdf["cls"].to_numpy())
                    yield pd.DataFrame({"cls": ids, "n": near @ pdf["size"].to_numpy()})

        rows = classes.select("cls", "v", "size").mapInPandas(run, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n")).collect()
        true = {r["cls"]: r["n"] for r in rows}
        if sum(n > 0 for n in true.values()) >= SEEN or asked >= MOST_AUDITED or len(some) < asked:
            return true
        asked *= 4


def audited_recall(counts: DataFrame, true: dict[int, int]) -> float:
    """Mean, over the queries that have links, of the share of them that ``counts`` has."""
    asked = [c for c, n in true.items() if n]
    if not asked:
        return 1.0
    found = {r["cls"]: r["n"] for r in counts.filter(F.col("cls").isin(asked)).collect()}
    return float(np.mean([found.get(c, 0) / true[c] for c in asked]))


def near_links(s: Scratch, classes: DataFrame, least: float = COSINE) -> tuple[DataFrame, DataFrame, float]:
    """Numbers of links, links that connect the components, and the audited recall."""
    count, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).collect()[0]
    if not count:
        return classes.select("cls", F.col("size").alias("n")), classes.select(F.col("cls").alias("a"), F.col("cls").alias("b")), 1.0
    true = true_counts(classes, width, least)
    for more in (1, 2, 4):
        counts, links = _links(s, classes, count, width, more, least)
        recall = audited_recall(counts, true)
        _log.info("recall %.5f of %d queries with links, width %d", recall, sum(n > 0 for n in true.values()), more)
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"recall of the near-dedup graph is {recall:.3f}, below {LEAST_RECALL}")
    return counts, links, recall


def embedding_components(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    with Scratch(vectors.sparkSession) as s:
        classes = s.keep(vector_classes(vectors), "classes")
        counts, links, _ = near_links(s, classes, least)
        roots = components(links, "a", "b").withColumnRenamed("node", "cls")
        facts = classes.join(counts, "cls", "left").join(roots, "cls", "left").select(
            "v", "size", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root"))
        facts = s.keep(facts, "facts")
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        some = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        found = split_join(rows.filter(some), facts, ["v"], "size", ["vec_id"], "left").select("vec_id", "n_links", "root")
        found = found.unionByName(rows.filter(~some).select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root")))
        root = F.coalesce("root", "vec_id")
        return keep(found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"),
                                 F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept")), "vectors")


__all__ = ["COSINE", "audited_recall", "build", "embedding_components", "near_links", "robust_prune", "search", "separated", "true_counts", "vector_classes"]
