"""Reviews in rounds: candidates of a script go out in batches through a transport that the caller gives.

A batch is a row. The batches of a script are sent in order by one task, and those of different scripts by all tasks; a batch
that fails for a passing reason is tried again after a while, and the first that fails for good ends the script's round: it and
what comes after it keep what the rules say. The text that leaves is without credentials.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import clamped
from brindle.operators.order import batches, first_wins, worked_out
from brindle.operators.secrets import FINDING_BATCH, SECRET_BATCH, allowed, fallback_secrets, finding_id, hidden_text

#: Times a batch is sent at most, and seconds between them.
ATTEMPTS, DELAY = 2, 0.5
ANSWERED, FAILED, NOT_SENT = "answered", "failed", "not sent"
#: Takes a request as JSON and returns an HTTP status and a body; may raise.
Transport = Callable[[str], tuple[int, str]]
_ANSWER = ("secrets array<struct<id:string,is_secret:boolean,secret_type:string,severity:string,confidence:double,reason:string>>, "
           "findings array<struct<id:string,is_risk:boolean,category:string,type:string,severity:string,confidence:double,reason:string>>")
_SENT = "script_id string, batch int, status string, attempts int, error string, answer string"


def requests(secrets: DataFrame, findings: DataFrame) -> DataFrame:
    """script_id, batch, request (JSON) of candidates (script_id, batch, id, ...): one row per batch, either side may be missing."""
    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        shown = [hidden_text(F.col(c)).alias(c) if c in ("evidence", "value") else F.col(c) for c in columns]
        return rows.groupBy("script_id", "batch").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", *shown))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))).alias(name))

    one, two = listed(secrets, "_s", "id", "type", "severity", "evidence"), listed(findings, "_f", "id", "category", "type", "value", "severity", "evidence")
    rows = one.join(two, ["script_id", "batch"], "full")
    part = lambda c: F.coalesce(c, F.lit("[]"))
    return rows.select("script_id", "batch", F.concat(F.lit('{"secrets":'), part("_s"), F.lit(',"findings":'), part("_f"), F.lit("}")).alias("request"))


def passing(error: Exception) -> bool:
    """Whether an error may be gone the next time: broken connections, but never a timeout."""
    return isinstance(error, OSError) and not isinstance(error, TimeoutError)


def _asked(transport: Transport, request: str, attempts: int, delay: float) -> tuple[str, int, str | None, str | None]:
    for attempt in range(1, attempts + 1):
        try:
            status, body = transport(request)
            again, error = status == 429 or status >= 500, None if 200 <= status < 300 else f"review failed with {status}"
            if error is None:
                json.loads(body)
                return ANSWERED, attempt, None, body
        except ValueError:
            again, error = False, "the answer is no JSON"
        except Exception as e:  # noqa: BLE001 - whatever a transport raises is the batch's error
            again, error = passing(e), f"{type(e).__name__}: {e}"[:500]
        if not again or attempt == attempts:
            return FAILED, attempt, error, None
        time.sleep(delay)
    return FAILED, attempts, None, None


def sent(asked: DataFrame, transport: Transport, attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    """script_id, batch, status (answered, failed, not sent), attempts, error, answer of each request."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, over = None, False
        for batch in rows:
            out = []
            for script, number, request in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                over = over and script == before
                before = script
                found = (NOT_SENT, 0, None, None) if over else _asked(transport, request, attempts, delay)
                over = over or found[0] == FAILED
                out.append((script, number, *found))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _SENT.split(", ")]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([(x.split()[0], k) for x, k in zip(_SENT.split(", "), kinds, strict=True)]))

    ordered = asked.select("script_id", F.col("batch").cast("int").alias("batch"), "request").repartition("script_id").sortWithinPartitions("script_id", "batch")
    return worked_out(ordered.mapInArrow(run, _SENT))  # sent once, whatever is made of the answers


def _settled(rows: DataFrame, answers: DataFrame, name: str, yes: str) -> DataFrame:
    """``rows`` (with batch) with ``_status`` of their batch and ``_r``, their review."""
    told = answers.select("script_id", F.explode(name).alias("_r")).withColumn("id", F.col("_r.id"))
    told = told.groupBy("script_id", "id").agg(F.last("_r").alias("_r"))
    return rows.join(answers.select("script_id", "batch", F.col("status").alias("_status")), ["script_id", "batch"], "left").join(told, ["script_id", "id"], "left").withColumn("_yes", F.coalesce(F.col(f"_r.{yes}"), F.lit(False)))


def reviewed_in_rounds(
        candidates: DataFrame, findings: DataFrame, transport: Transport, secret_types: list[str] = (), categories: list[str] = (), review_secrets: bool = True, review_findings: bool = True,
        attempts: int = ATTEMPTS, delay: float = DELAY) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Secrets, findings, counters (script_id, ...) and batches (see ``sent``, without answers) after a review.

    Of an answered batch those stay that the answer confirms. Candidates of a batch that failed or wasn't sent stay as the rules
    have them and count as dropped. Those that the lists or switches leave out pass by.
    """
    named = findings.withColumn("id", finding_id())
    asked, passed = allowed(candidates, "type", list(secret_types)) if review_secrets else (candidates.filter(F.lit(False)), candidates)
    wanted, left = allowed(named, "category", list(categories)) if review_findings else (named.filter(F.lit(False)), named)
    asked = batches(asked, ["script_id"], [F.col("ord"), F.col("id")], SECRET_BATCH)
    wanted = batches(wanted, ["script_id"], [F.col("ord"), F.col("id")], FINDING_BATCH)
    told = sent(requests(asked, wanted), transport, attempts, delay)
    answers = told.select("script_id", "batch", "status", F.from_json("answer", _ANSWER).alias("_a")).select("script_id", "batch", "status", "_a.secrets", "_a.findings")
    one, two = _settled(asked, answers, "secrets", "is_secret"), _settled(wanted, answers, "findings", "is_risk")
    answered = F.col("_status") == ANSWERED

    def counted(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.groupBy("script_id").agg(
            F.count(F.lit(1)).alias(f"{prefix}candidate_count"), F.countDistinct(F.when(F.col("_status") != NOT_SENT, F.col("batch"))).alias(f"{prefix}batch_count"), F.count_if(answered).alias(f"{prefix}reviewed_count"),
            F.count_if(answered & F.col("_yes")).alias(f"{prefix}confirmed_count"), F.count_if(answered & ~F.col("_yes")).alias(f"{prefix}rejected_count"), F.count_if(~answered).alias(f"{prefix}dropped_count"))

    counters = counted(one, "llm_").join(counted(two, "llm_finding_"), "script_id", "full")
    reviews = lambda rows: rows.filter(answered & F.col("_yes"))
    columns, more = candidates.columns, named.columns
    said = lambda *names: {c: F.coalesce(F.nullif(F.col(f"_r.{r}"), F.lit("")), c) for c, r in names}
    sure = reviews(one).withColumns(said(("type", "secret_type"), ("severity", "severity")) | {"confidence": clamped(F.col("_r.confidence")), "source": F.lit("llm+regex")}).select(*columns, "confidence", "source")
    secrets = fallback_secrets(passed).unionByName(sure).unionByName(fallback_secrets(one.filter(~answered).select(columns)))
    secrets = first_wins(secrets, ["script_id", "type", F.coalesce("value", F.lit("")), F.coalesce("evidence", F.lit(""))], "ord")
    risky = reviews(two).withColumns(said(("category", "category"), ("type", "type"), ("severity", "severity")) | {"confidence": clamped(F.col("_r.confidence")), "source": F.lit("llm")}).select(more)
    found = left.unionByName(risky).unionByName(two.filter(~answered).select(more)).drop("id")
    found = first_wins(found, ["script_id", "category", "type", "source", F.coalesce("value", F.lit("")), F.coalesce("evidence", F.lit(""))], "ord")
    return secrets, found, counters, told.drop("answer")


__all__ = ["ATTEMPTS", "DELAY", "passing", "requests", "reviewed_in_rounds", "sent"]
