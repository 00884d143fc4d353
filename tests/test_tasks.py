"""Tasks as streams: one that fails, states by key, restarts."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brindle.streaming import tasks
from tests.test_operators import found


def test_a_failing_task_fails_alone(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"task_id": f"t{i}", "content": "boom" if i == 3 else f"/api/{i}"}) for i in range(16)))
    places = [str(tmp_path / x) for x in ("events", "results", "checkpoint")]

    def analyze(rows):
        return rows.select("script_id", F.when(F.col("content") == "boom", F.raise_error(F.lit("no such thing"))).otherwise(F.col("content")).alias("url"))

    tasks.run_requests(spark, str(source), *places, analyze).awaitTermination()
    events = spark.read.parquet(places[0])
    assert found(tasks.latest_state(events), "task_id", "status") == {(f"t{i}", "failed" if i == 3 else "completed") for i in range(16)}
    assert found(spark.read.parquet(places[1]), "url") == {(f"/api/{i}",) for i in range(16) if i != 3}
    assert {t for t, e in found(events.filter("status = 'failed'"), "task_id", "error") if e} == {"t3"}


def test_states_by_key_over_restarts(spark, tmp_path):
    source, start = tmp_path / "in", datetime(2024, 1, 1)
    source.mkdir()

    def send(name, *rows):
        (source / name).write_text("\n".join(json.dumps({"task_id": t, "status": s, "at": (start + timedelta(seconds=at)).isoformat(), "error": e}) for t, s, at, e in rows))

    def run():
        stream = tasks.with_task_store(spark).readStream.schema(tasks.EVENT).json(str(source))
        changes = tasks.task_changes(stream, patience=60, kept=100)
        changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return {(r.task_id, r.status, int((r.updated_at - start).total_seconds()), r.error) for r in spark.read.schema(tasks.TASK).parquet(str(tmp_path / "out")).collect()}

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        send("1.json", ("a", "queued", 0, None), ("a", "running", 1, None), ("b", "queued", 0, None), ("c", "odd", 0, None))
        first = {("a", "queued", 0, None), ("a", "running", 1, None), ("b", "queued", 0, None)}
        assert run() == first
        send("2.json", ("a", "completed", 5, None), ("a", "queued", 6, None), ("a", "failed", 7, "late"), ("d", "failed", 5, "bad"))
        second = first | {("a", "completed", 5, None), ("d", "failed", 5, "bad")}
        assert run() == second
        send("3.json", ("e", "queued", 90, None))
        run()
        send("4.json", ("e", "running", 91, None))
        got = run()
        assert got - second == {("e", "queued", 90, None), ("e", "running", 91, None), ("b", "failed", 60, tasks.TIMED_OUT)}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
