import collections
import hashlib
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import embedding_dedup as emb
from brindle.llm import common, exact_dedup, jaccard_join
from brindle.llm.components import components
from brindle.llm.registry import oracle_sql, queries
from tests.against_sql import check
from tests.conftest import SF
from tests.llm.cases import TEXTS, none, table

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_equals_sql(spark):
    check(spark, queries()["op1_exact_dedup"], oracle_sql()["op1_exact_dedup"], SF)


def test_jaccard_join_equals_sql(spark):
    check(spark, queries()["op8_jaccard_join"], oracle_sql()["op8_jaccard_join"], SF)


def test_blocks_that_share_a_hash_are_told_apart(spark):
    for hashed in (lambda c: F.octet_length(c).cast("long"), lambda c: F.lit(0).cast("long") * F.octet_length(c)):
        rows = exact_dedup.block_identity(table(spark), 7, hashed).collect()
        assert len(rows) == len(TEXTS)
        names, texts = collections.defaultdict(set), collections.defaultdict(set)
        for r in rows:
            names[bytes(r.sha)].add((r.n, r.name))
            texts[r.n, r.name].add(bytes(r.sha))
        assert all(len(v) == 1 for v in [*names.values(), *texts.values()])


def test_joins_split_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 5)
    rows = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 700")
    inner, left = (common.split_join(rows, facts, ["k"], "n", ["id"], how) for how in ("inner", "left"))
    assert "_salt" in inner._jdf.queryExecution().toString() and inner.columns == ["k", "id", "n"]
    assert {(r.k, r.id, r.n) for r in inner.collect()} == {(0 if i < 600 else i, i, 600 if i < 600 else 1) for i in range(1000) if i != 700}
    assert left.count() == 1000 and left.filter("n is null").count() == 1


def test_tables_go_when_they_are_done(spark):
    with common.Scratch(spark) as s:
        df = s.keep(spark.range(5), "a")
        path = df.inputFiles()[0]
        assert df.count() == 5
    assert not os.path.exists(path.removeprefix("file://"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with common.arrow_rows(spark, 7):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_embeddings_equal_sql(spark):
    check(spark, queries()["op5_embeddings"], oracle_sql()["op5_embeddings"], SF)


def test_exact_dedup_of_odd_rows_in_small_blocks(spark):
    groups = collections.defaultdict(list)
    for d, t in TEXTS:
        groups[(t or "").translate(UP)].append(d)
    want = collections.Counter(
        (d, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)
    for size in (7, 4096):
        got = exact_dedup.exact_dedup(table(spark), size).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_dedup(none(spark)).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    kept = exact_dedup.dedup_rows(table(spark))
    assert kept.columns == table(spark).columns
    assert len({(r.text or "").translate(UP) for r in kept.collect()}) == len({(t or "").translate(UP) for _, t in TEXTS})


def test_one_row_of_each_text_stays(spark):
    texts = [(1, "a"), (1, "A"), (1, "b"), (2, "b"), (3, "c"), (3, "d"), (None, "a"), (None, "e"), (None, "e"), (None, None), (4, "")]
    kept = exact_dedup.dedup_rows(table(spark, texts))
    assert kept.columns == table(spark).columns
    want = [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, ""), (None, "e")]
    assert collections.Counter((r.doc_id, (r.text or "").translate(UP)) for r in kept.collect()) == collections.Counter(want)
    assert exact_dedup.dedup_rows(table(spark)).count() == len({(t or "").translate(UP) for _, t in TEXTS})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))


def brute(texts):
    sets = []
    for d, t in texts:
        w = words(t)
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (d, s) in enumerate(known):
        for e, z in known[:i]:
            if 100 * len(s & z) >= 75 * len(s | z):
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return collections.Counter((d, len(s), top(d) if d is not None else None) for d, s in sets)


def test_jaccard_join_of_odd_rows(spark):
    got = jaccard_join.jaccard_components(table(spark)).collect()
    assert collections.Counter(map(tuple, got)) == brute(TEXTS)
    assert jaccard_join.jaccard_components(none(spark)).collect() == []


def test_jaccard_join_of_chains_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 3)
    r = np.random.default_rng(2)
    texts, n = [], 0
    for base in range(6):
        w = [f"b{base}x{i}" for i in range(80)]
        for _ in range(25):
            v = list(w)
            for i in r.integers(0, 80, r.integers(0, 5)):
                v[i] = f"n{r.integers(9999)}"
            texts.append((n, " ".join(v[: r.integers(70, 81)])))
            n += 1
    for size in range(1, 40):  # a chain in which neighbours are similar
        texts.append((n, " ".join(f"c{i}" for i in range(size, size + 60))))
        n += 1
    got = jaccard_join.jaccard_components(table(spark, texts)).collect()
    assert collections.Counter(map(tuple, got)) == brute(texts)


def shingles(text):
    return next(jaccard_join.shingle_sets([text.encode()]))


def filled(text, level):
    with np.errstate(over="ignore"):
        return len(np.unique(((shingles(text) >> np.uint64(32)) * np.uint64(2 * jaccard_join.first_partitions(level))) >> np.uint64(32)))


def test_jaccard_join_of_sets_in_few_partitions(spark):
    # Alone in the table: three shingles in one partition, and the same and one in another.
    pairs = ((t, f"{t} more{i}") for i in range(9999) for t in [" ".join(f"s{i}x{j}" for j in range(7))])
    one, two = next((a, b) for a, b in pairs if filled(a, 0) == 1 and filled(b, 0) == 2)
    got = jaccard_join.jaccard_components(table(spark, [(1, one), (2, two)])).collect()
    assert collections.Counter(map(tuple, got)) == {(1, 3, 1): 1, (2, 4, 1): 1}


def test_jaccard_join_of_short_texts(spark):
    texts = []
    for small, large in ((3, 4), (4, 5), (6, 8)):
        for i in range(250):
            w = [f"p{small}i{i}x{j}" for j in range(large + 4)]
            texts += [(len(texts), " ".join(w[: small + 4])), (len(texts) + 1, " ".join(w))]
    got = jaccard_join.jaccard_components(table(spark, texts)).collect()
    assert collections.Counter(map(tuple, got)) == brute(texts)


def test_jaccard_join_of_many_short_texts(spark):
    r = np.random.default_rng(12)
    texts = []
    for i in range(1000):
        w = [f"q{i}x{j}" for j in range(int(r.integers(5, 21)))]
        for _ in range(5):
            v = list(w)
            for j in r.integers(0, len(v), int(r.integers(0, 2))):
                v[j] = f"n{r.integers(10**9)}"
            texts.append((len(texts), " ".join(v[: max(1, len(v) - int(r.integers(0, 3)))])))
    got = jaccard_join.jaccard_components(table(spark, texts)).collect()
    want = collections.Counter()
    for i in range(0, len(texts), 5):  # texts of different words have nothing in common
        want += brute(texts[i : i + 5])
    assert collections.Counter(map(tuple, got)) == want


def test_jaccard_join_with_frequent_signatures(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)  # so nearly all that repeats counts as frequent
    shared = [f"common{i}" for i in range(40)]
    texts = [(i, " ".join([f"u{i // 3}w{j}" for j in range(30)] + shared + ([f"z{i}"] if i % 3 else []))) for i in range(90)]
    texts += [(100 + i, " ".join(shared)) for i in range(30)]
    got = jaccard_join.jaccard_components(table(spark, texts)).collect()
    assert collections.Counter(map(tuple, got)) == brute(texts)


def emitted(texts, buckets):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    return pa.Table.from_batches(jaccard_join._emit(buckets, np.empty(0, np.uint64))([batch])).to_pandas()


def test_bytes_of_a_signature_do_not_grow_with_the_buckets():
    texts = [" ".join(f"w{i}-{j}" for j in range(400)) for i in range(50)] * 2
    few, many = ([sum(map(len, rows[c])) for c in rows.columns if c != "bucket"] for rows in (emitted(texts, 4), emitted(texts, 5000)))
    assert sum(many) <= sum(few) and sum(few) <= 13 * few[-1]  # the last column has a byte for each signature


def test_signatures_meet_with_the_names_of_their_sets():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 1 << 48, 1000, dtype=np.uint64)
    assert (jaccard_join._unpacked(jaccard_join._packed(names)) == names).all()
    words = [f"w{j}" for j in range(80)]
    rows = emitted([" ".join(words), " ".join([*words[:-1], "new"]), " ".join(words), "quite other words", None], 3)
    found = pd.concat(jaccard_join._shared(g) for _, g in rows.groupby("bucket"))
    want = {jaccard_join._name(jaccard_join._digest(shingles(" ".join(x)))[0]) for x in (words, [*words[:-1], "new"])}
    assert set(found["sid"]) == want and set(found["c"]) == {2}
    assert jaccard_join._numbers(np.array([5, 7, 5, 9], np.uint64), 3) == (3, 2)


def test_parities_rule_out_no_linked_sets():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 700):
        for d in range(0, n + 1, max(1, n // 20)):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[d:], rng.integers(0, 1 << 63, d // 2, dtype=np.uint64)]))
            x, y = jaccard_join._parities(a), jaccard_join._parities(b)
            assert x.shape == (jaccard_join.PARITIES,) and sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_jaccard_join_with_keys_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW_KEYS", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    check(spark, queries()["op8_jaccard_join"], oracle_sql()["op8_jaccard_join"], SF)


def test_frequent_numbers_are_never_missed():
    r = np.random.default_rng(3)
    stream = np.concatenate([np.full(4000, 7), np.full(900, 9), r.integers(100, 10**9, 20_000)]).astype(np.uint64)
    r.shuffle(stream)
    seen = jaccard_join._Frequent(50)
    for part in np.array_split(stream, 90):
        seen.add(part)
    seen.settle()
    found = dict(zip(seen.key.tolist(), seen.n.tolist(), strict=True))
    assert 4000 - len(stream) / 50 <= found[7] <= 4000 and found.get(9, 0) >= 900 - len(stream) / 50 and len(found) <= 50


def test_one_row_of_each_group_stays_of_repeated_ids(spark):
    near = "a b c d e f g"
    texts = [(5, near), (5, near + " h"), (5, near), (7, near + " h"), (5, "quite another text"), (8, ""), (8, ""), (9, None), (None, near)]
    kept = jaccard_join.drop_near_copies(table(spark, texts)).collect()
    count = collections.Counter((r.doc_id, r.text) for r in kept)
    assert sum(n for (d, t), n in count.items() if d is not None and t and t.startswith(near)) == 1 and (7, near + " h") not in count
    assert count[5, "quite another text"] == count[8, ""] == count[9, None] == count[None, near] == 1


def test_near_copies_go_and_rows_stay_whole(spark):
    kept = jaccard_join.drop_near_copies(table(spark))
    assert kept.columns == table(spark).columns
    ids = {r.doc_id for r in kept.collect()}
    assert 1 in ids and not {2, 3, 4, 13} & ids and {6, 7, 12, 14} <= ids


def test_rows_without_an_id_are_no_near_copies(spark):
    texts = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (None, "a b c d e f g"), (None, "quite another text"), (None, None)]
    kept = jaccard_join.drop_near_copies(table(spark, texts)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter([texts[0], *texts[2:]])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 500), (None, 3), (900, 901), (901, 900)], "x long, y long")
    got = {r.node: r.root for r in components(links, "x", "y").collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def brute_vectors(rows, least):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    return {d: (int(near[i].sum()) - 1, rows[root[i]][0]) for i, (d, _) in enumerate(rows)}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(emb, "BLOCK", 40)
    r = np.random.default_rng(1)
    centres = r.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.08 * r.standard_normal(16)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300 + i, r.standard_normal(16).tolist()) for i in range(60)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] + [1.0] * 15), (905, [float("inf")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame([(d, v, 1, 0) for d, v in rows + odd], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in emb.embedding_components(df).collect()}
    want = brute_vectors(sorted(rows), 0.95)
    right = sum(got[d] == want[d] for d in want)
    assert right >= 0.97 * len(want)
    assert all(got[d] == (0, d) for d, _ in odd[:-1]) and got[None][1] is None
    assert emb.embedding_components(df.limit(0)).collect() == []


def test_embeddings_in_many_cells_and_blocks(spark, monkeypatch):
    for name, value in {"BLOCK": 30, "CELL": 60, "CHUNK": 70, "MOST_CENTROIDS": 3, "SEEN": 10}.items():
        monkeypatch.setattr(emb, name, value)
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 8))
    rows = [(i, (centres[i % 40] + 0.1 * r.standard_normal(8)).tolist()) for i in range(400)]
    rows += [(500 + i, (centres[0] + 0.05 * r.standard_normal(8)).tolist()) for i in range(150)]  # a crowd of several blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in emb.embedding_components(df).collect()}
    want = brute_vectors(sorted(rows), 0.95)
    assert np.mean([min(got[d][0], want[d][0]) / max(got[d][0], want[d][0], 1) if want[d][0] else got[d][0] == 0 for d in want]) > 0.98
    assert all(got[d][0] <= want[d][0] for d in want)


def test_audit_counts_and_fails_below_the_least_recall(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.standard_normal((30, 8))
    rows = [(i, (base[i % 30] + 0.01 * r.standard_normal(8)).tolist()) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    classes = emb.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    true = emb.true_counts(classes, 8)
    want = brute_vectors(sorted(rows), 0.95)
    assert len(true) == 90 and all(n == want[c][0] - (5 if c == 0 else 0) for c, n in true.items())
    half = spark.createDataFrame([(c, n // 2) for c, n in true.items()], "cls long, n long")
    assert 0.4 < emb.audited_recall(half, true) < 0.6 and emb.audited_recall(half, {}) == 1.0
    widths = []

    def poor(s, classes, count, width, more, least):
        widths.append(more)
        return half, classes.select("cls")

    monkeypatch.setattr(emb, "_links", poor)
    with pytest.raises(RuntimeError):
        emb.near_links(None, classes)
    assert widths == [1, 2, 4]


def test_lists_stay_short_and_blocks_connected():
    r = np.random.default_rng(7)
    x = emb.unit([*(np.array([1.0, 0, 0]) + 0.01 * r.standard_normal((150, 3))), *r.standard_normal((50, 3))])
    lists = emb.build(x, 4)
    assert max(map(len, lists)) <= 2 * 4 + 20 and set(emb._roots(200, *np.array([(i, j) for i, v in enumerate(lists) for j in v]).T)) == {0}


def test_robust_prune_keeps_one_of_a_tight_bunch():
    x = emb.unit([[1, 0], [0.9, 0.1], [0.9, 0.11], [-1, 0.5]])
    sim = x[1:] @ x[1:].T
    kept = emb.robust_prune(np.arange(3), np.concatenate([(x[1:] @ x[0])[:, None], sim], axis=1), 3)
    assert kept[0] in (0, 1) and len(kept) == 2
