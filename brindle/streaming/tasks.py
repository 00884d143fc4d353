"""Asynchronous analysis as Structured Streaming: requests in, task events and results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brindle.operators.order import last_by, newest

STATES = ("queued", "running", "completed", "failed")
#: Parts that the tasks of a batch are dealt to at most, to tell failing ones apart.
PARTS = 1 << 20
TIMED_OUT = "analysis took too long"
REQUEST = "task_id string, url string, content string, mode string"


def latest_state(events: DataFrame) -> DataFrame:
    """task_id, status, updated_at, created_at: the last event of each task; ties go to the later state."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    created = events.groupBy("task_id").agg(F.min("at").alias("created_at"))
    return last_by(events.select("task_id", "status", F.col("at").alias("updated_at")), ["task_id"], F.struct("updated_at", rank)).join(created, "task_id")


def evicted(tasks: DataFrame, most: int = 1000) -> DataFrame:
    """The newest tasks that the store keeps."""
    return newest(tasks, [F.col("created_at").desc(), F.col("task_id").desc()], most)


def task(events: DataFrame, task_id: str) -> DataFrame:
    return latest_state(events.filter(F.col("task_id") == task_id))


def failing_apart(rows: DataFrame, work: Callable[[DataFrame, str], None]) -> list[tuple[str, str]]:
    """Runs ``work`` (rows, name of the part) on all of ``rows``, apart from tasks that make it fail: these are returned with their errors.

    A part that fails is halved by a hash of its tasks until the failing ones stand alone, so each costs as many more runs as
    the logarithm of the number of tasks, and no other task fails with it.
    """
    part = F.pmod(F.xxhash64("task_id"), F.lit(PARTS))
    failed: list[tuple[str, str]] = []

    def attempt(low: int, high: int) -> None:
        own = rows if (low, high) == (0, PARTS) else rows.filter((part >= low) & (part < high))
        try:
            work(own, f"{low}-{high}")
        except Exception as e:  # noqa: BLE001 - the state of the tasks tells
            some = [r["task_id"] for r in own.select("task_id").distinct().limit(2).collect()]
            if len(some) == 1 or high - low == 1:
                message = str(e).splitlines()[0][:500] if str(e) else type(e).__name__
                failed.extend((r["task_id"], message) for r in own.select("task_id").distinct().collect())
            elif some:
                middle = (low + high) // 2
                attempt(low, middle)
                attempt(middle, high)

    attempt(0, PARTS)
    return failed


def run_requests(spark: SparkSession, source: str, events: str, results: str, checkpoint: str, analyze: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Analyse JSON requests as their files arrive; each batch appends queued, running and completed or failed events.

    A task that makes the analysis fail is marked as failed, with its error, and no other. A batch that is repeated after a
    loss writes the same rows to the same folder again.
    """
    stream = spark.readStream.schema(REQUEST).json(source)

    def note(rows: DataFrame, status: str, batch: int) -> None:
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        marked = rows.select("task_id", F.lit(status).alias("status"), F.current_timestamp().alias("at"), error.alias("error"))
        marked.write.mode("overwrite").parquet(f"{events}/batch={batch}/status={status}")

    def step(rows: DataFrame, batch: int) -> None:
        rows = rows.filter("task_id is not null").persist()  # the source is read once a batch
        for status in ("queued", "running"):
            note(rows, status, batch)

        def work(own: DataFrame, part: str) -> None:
            analyze(own.withColumnRenamed("task_id", "script_id")).write.mode("overwrite").parquet(f"{results}/batch={batch}/part={part}")

        failed = rows.sparkSession.createDataFrame(failing_apart(rows, work), "task_id string, error string")
        note(rows.join(failed.select("task_id"), "task_id", "left_anti"), "completed", batch)
        note(failed, "failed", batch)
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENT = "task_id string, status string, at timestamp, error string"
TASK = "task_id string, status string, created_at timestamp, updated_at timestamp, error string"
_MOVED = "task_id string, status string, created long, updated long, error string"


class TaskState(StatefulProcessor):
    """The state of one task: events move it on, never back; it fails when it doesn't end in time and is let go of when it is old."""

    def __init__(self, patience: int, kept: int):
        self.patience, self.kept = patience, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status string, created long, updated long, error string")

    def _after(self, at: int, seconds: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + 1000 * seconds)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        found = self.state.get() if self.state.exists() else None
        status, created, updated, error = found if found else (None, None, None, None)
        moved = []
        for row in sorted((r for r in rows if r.ms is not None and r.status in STATES), key=lambda r: (r.ms, STATES.index(r.status))):
            if status in STATES[2:] or (status is not None and STATES.index(row.status) <= STATES.index(status)):
                continue  # repeated or late
            status, created, updated, error = row.status, row.ms if created is None else created, max(updated or row.ms, row.ms), row.error
            moved.append(Row(task_id=key[0], status=status, created=created, updated=updated, error=error))
        if moved:
            self.state.update((status, created, updated, error))
            self._after(updated, self.kept if status in STATES[2:] else self.patience)
        yield from moved

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        status, created, _, _ = self.state.get()
        if status in STATES[2:]:
            self.state.clear()
            return
        late = expiredTimerInfo.getExpiryTimeInMs()
        self.state.update(("failed", created, late, TIMED_OUT))
        self._after(late, self.kept)
        yield Row(task_id=key[0], status="failed", created=created, updated=late, error=TIMED_OUT)

    def close(self) -> None:
        pass


def task_changes(events: DataFrame, patience: int = 600, kept: int = 86_400) -> DataFrame:
    """A row for each change of a task's state (``TASK``), from a stream of events (``EVENT``), keyed by task.

    Events that repeat a state or come after a later one change nothing. A task that hasn't ended ``patience`` seconds after its last
    event fails; its state is let go of ``kept`` seconds after its end, so the store holds the tasks of that time only. Needs a
    session with RocksDB as its state store (``with_task_store``). Times are those of the events, by their watermark.
    """
    rows = events.withWatermark("at", "0 seconds").withColumn("ms", F.unix_millis("at")).groupBy("task_id")
    moved = rows.transformWithState(statefulProcessor=TaskState(patience, kept), outputStructType=_MOVED, outputMode="Append", timeMode="EventTime")
    return moved.select("task_id", "status", F.timestamp_millis("created").alias("created_at"), F.timestamp_millis("updated").alias("updated_at"), "error")


def with_task_store(spark: SparkSession) -> SparkSession:
    """``spark``, with the state store that ``task_changes`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


__all__ = ["evicted", "failing_apart", "latest_state", "run_requests", "task", "task_changes", "with_task_store"]
