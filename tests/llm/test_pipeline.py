import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm.registry import queries
from tests.llm.cases import none, table


def test_stages_in_order(spark, tmp_path):
    docs, seen = table(spark), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/nowhere")
        seen.append((name, out.count()))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    assert [n for n, _ in seen] == ["language", "exact_dedup", "near_dedup", "pii", "packing"]
    assert seen[0][1] == 17 and seen[1][1] == 14 and seen[2][1] < seen[1][1] and seen[3][1] == seen[2][1] <= seen[4][1]
    texts = {r.text for r in docs.collect()}
    assert "[EMAIL] [IP] [IBAN]" in texts


def test_run_over_a_table(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048 and len(got) and got.doc_id.notna().all()


def test_folds_of_the_queries(spark):
    for name, k in (("op10_language_id", 4), ("op3_quality", 4), ("op7_language_model", 7)):
        rows = queries()[name](spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
        assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == 2) for r in rows)


def test_stages_of_odd_rows(spark, tmp_path):
    near = "one two three four five six seven"
    texts = [(1, near), (2, near + " eight"), (3, near.upper()), (None, near), (None, "nothing like it"), (None, "nothing like it"), (4, None), (5, ""), (6, "12345"), (7, "mail a@b.co"), (7, "mail a@b.co"), (7, "quite other words")]
    docs = table(spark, texts).withColumn("_k", F.lit("x")).withColumn("root", F.lit(1))
    want = [
        [(1, near), (2, near + " eight"), (3, near.upper()), (None, near), (None, "nothing like it"), (None, "nothing like it"), (7, "mail a@b.co"), (7, "mail a@b.co"), (7, "quite other words")],
        [(2, near + " eight"), (3, near.upper()), (None, "nothing like it"), (7, "mail a@b.co"), (7, "quite other words")],
        [(2, near + " eight"), (None, "nothing like it"), (7, "mail a@b.co"), (7, "quite other words")],
        [(2, near + " eight"), (None, "nothing like it"), (7, "mail [EMAIL]"), (7, "quite other words")]]
    key = lambda rows: sorted((d or 0, t or "") for d, t in rows)
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want, strict=False):
        out = stage(spark, docs, "/nowhere")
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert key((r.doc_id, r.text) for r in docs.collect()) == key(rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere").collect()
    assert sorted(r.doc_id or 0 for r in packed) == [0, 2, 7, 7]


def test_stages_of_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none(spark), "/nowhere").collect() == []


def test_language_stage_keeps_what_nobody_labelled(spark):
    texts = [(i, f"plain english words number {i}") for i in range(10)] + [(10, "12 !"), (11, None), (12, "日本"), (None, "no id here")]
    docs = table(spark, texts)
    want = sorted([*range(10), 12, -1])
    stage = corpus_pipeline.STAGES[0][1]
    for df in (docs.withColumn("lang", F.lit(None).cast("string")), docs.drop("lang"), docs):
        out = stage(spark, df, "/nowhere")
        assert out.columns == df.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want
    assert stage(spark, docs.drop("lang").limit(0), "/nowhere").collect() == []
