"""Queries over tasks, schedules and logs, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import order
from brindle.plans import made_scripts as made
from brindle.sources import logs, scripts
from brindle.streaming import tasks

_STATE = {"signup": "queued", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}


def _millis() -> Column:
    """Milliseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((day * 24 + F.hour("ts")) * 60 + F.minute("ts")) * 60_000 + F.floor(F.expr("extract(second from ts)") * 1000).cast("long")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*[F.lit(x) for kv in _STATE.items() for x in kv])
    return made.table(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 3)).alias("task_id"), named[F.col("event_type")].alias("status"), F.col("event_id").alias("at"))


_EVENTS = """e as (select 't' || event_id // 3 as task_id, case event_type when 'signup' then 'queued' when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status, event_id as moment from events)"""


def task_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.latest_state(_events(spark, sf_dir))


TASK_LATEST_STATE = f"with {_EVENTS} select task_id, max_by(status, moment) as status, max(moment) as updated_at, min(moment) as created_at from e group by 1"


def task_evict_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.evicted(tasks.latest_state(_events(spark, sf_dir)), 1000).select("task_id", "created_at")


TASK_EVICT_TOPK = f"with {_EVENTS} select task_id, min(moment) as created_at from e group by 1 order by created_at desc limit 1000"


def rate_limit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made.table(spark, sf_dir, "events").select("event_id", "user_id", _millis().alias("arrived"))
    return order.rate_limited(rows, ["user_id"], "arrived", ["arrived", "event_id"], 1_000_000).select("event_id", "start")


RATE_LIMIT_SCHEDULE = """
with r as (select event_id, user_id, epoch_us(ts) // 1000 as arrived, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as n from events)
select event_id, max(arrived - n * 1000000) over (partition by user_id order by n) + n * 1000000 as start from r
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.col("event_id") % 5 + 1).cast("int") * 10
    record = F.to_json(F.struct(level.alias("level"), _millis().alias("time"), F.concat(F.lit("llm_"), "event_type").alias("msg"), F.struct(
        F.lit("POST").alias("method"), F.concat(F.lit("/u/"), "user_id").alias("url")).alias("req")))
    return made.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "plain words").otherwise(record).alias("line"))


def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = logs.at_least(logs.parsed(_records(spark, sf_dir)), "warn")
    return logs.mirrored(shown).groupBy("level", "channel", "event").agg(F.count(F.lit(1)).alias("n"))


LOG_LEVELS = """
select case event_id % 5 when 4 then 'error' when 3 then 'warn' end as level, case event_id % 5 when 4 then 'stderr' else 'stdout' end as channel, 'llm_' || event_type as event, count(*) as n
from events where event_id % 11 <> 0 and event_id % 5 >= 3 group by all
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.formatted(logs.parsed(_records(spark, sf_dir)).filter("level is not null"), ["method", "url", "host"])


LOG_LINES = """
select strftime(ts, '%Y-%m-%d') as log_date, '[' || ['DEBUG', 'DEBUG', 'INFO', 'WARN', 'ERROR'][event_id % 5 + 1] || '] ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || strftime(ts, '%g') || 'Z llm_' || event_type
  || ' method="POST" url="/u/' || user_id || '"' as line from events where event_id % 11 <> 0
"""

def task_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task(_events(spark, sf_dir), "t7")


TASK_LOOKUP = f"with {_EVENTS} select task_id, max_by(status, moment) as status, max(moment) as updated_at, min(moment) as created_at from e where task_id = 't7' group by 1"


def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    rows = made.table(spark, sf_dir, "pages").select(
        k, F.when(k % 3 > 0, F.concat(F.lit("https://u@H"), k, F.lit(".example:443/p/"), k, F.lit("?q=1"))).alias("url"), F.when(k % 2 == 0, F.concat(F.lit("a\nb"), k)).otherwise(" ").alias("content"),
        (k % 5 == 0).alias("async"), F.lit(None).cast("string").alias("response_mode"), F.when(k % 4 == 0, True).alias("fast_mode"), F.when(k % 7 == 0, "fast").alias("mode"))
    return scripts.request_summary(rows).select(
        "page_id", "has_url", "url_host", "url_path", "has_content", "content_length", "content_lines", "content_sha256", "is_async", "response_mode", "requested_mode", "mode", "llm_expected")


REQUEST_SUMMARY = """
with r as (select page_id as k, page_id % 4 = 0 or page_id % 7 = 0 as fast, page_id % 2 = 0 as has, case when page_id % 2 = 0 then 'a' || chr(10) || 'b' || page_id else ' ' end as t from pages)
select k as page_id, k % 3 > 0 as has_url, case when k % 3 > 0 then 'h' || k || '.example' end as url_host, case when k % 3 > 0 then '/p/' || k end as url_path, has as has_content,
  cast(length(t) as int) as content_length, case when has then 2 else 0 end as content_lines, case when has then sha256(t) end as content_sha256, k % 5 = 0 as is_async, 'full' as response_mode,
  case when k % 7 = 0 then 'fast' end as requested_mode, case when fast then 'fast' else 'full' end as mode, not fast as llm_expected from r
"""


def secret_request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("candidate"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise("").alias("context"))
    return scripts.secret_requests(rows).select("doc_id", "candidate")


SECRET_REQUEST_CHECK = "select doc_id, source as candidate from documents where doc_id % 5 > 0 and doc_id % 3 > 0 and length(source) > 0 and length(text) > 0"


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by a made-up transport: some are found, some aren't, some are too long."""
    def fetch(url: str, most: int, seconds: float) -> tuple[int, str]:
        return (404, "") if url.endswith("3") else (200, url * (9 if url.endswith("7") else 1))

    rows = made.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h.example/"), "page_id").alias("url"), F.lit(None).cast("string").alias("content"), F.lit("url").alias("origin"), F.lit(None).cast("string").alias("error"))
    return scripts.downloaded(rows, fetch, 100).select("page_id", "content", "error")


DOWNLOADS = """
select page_id, case when page_id % 10 not in (3, 7) then 'https://h.example/' || page_id end as content,
  case page_id % 10 when 3 then 'download failed with status 404' when 7 then 'download exceeds 100 bytes' end as error from pages
"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings spelled from customers: switches, lists, numbers, the mode and a text with a byte-order mark."""
    k = F.col("c_custkey")
    rows = made.table(spark, sf_dir, "customer").select(
        k, F.element_at(F.array(*map(F.lit, (" Yes", "off", "1", "TRUE "))), (k % 4 + 1).cast("int")).alias("s"), F.concat(F.lit(" a, ,b"), k, F.lit(",")).alias("l"),
        F.when(k % 3 == 0, "x1").otherwise(k.cast("string")).alias("n"), F.concat(F.when(k % 2 == 0, "\ufeff").otherwise(""), "c_name").alias("t"))
    return rows.select("c_custkey", text.flag(F.col("s")).alias("is_on"), F.array_join(text.comma_list(F.col("l")), "|").alias("items"), text.number(F.col("n"), 7).alias("number"),
                       text.chosen_mode(k % 4 == 0, F.when(k % 5 == 0, "fast")).alias("mode"), text.strip_bom(F.col("t")).alias("name"))


SETTINGS = """
select c_custkey, c_custkey % 4 <> 1 as is_on, 'a|b' || c_custkey as items, case when c_custkey % 3 = 0 then 7.0 else cast(c_custkey as double) end as number,
  case when c_custkey % 4 = 0 or c_custkey % 5 = 0 then 'fast' else 'full' end as mode, c_name as name from customer
"""

QUERIES = {
    "task_lookup": (task_lookup, TASK_LOOKUP), "request_summary": (request_summary, REQUEST_SUMMARY), "secret_request_check": (secret_request_check, SECRET_REQUEST_CHECK),
    "downloads": (downloads, DOWNLOADS), "settings": (settings, SETTINGS),
    "task_latest_state": (task_latest_state, TASK_LATEST_STATE), "task_evict_topk": (task_evict_topk, TASK_EVICT_TOPK),
    "rate_limit_schedule": (rate_limit_schedule, RATE_LIMIT_SCHEDULE), "log_levels": (log_levels, LOG_LEVELS), "log_lines": (log_lines, LOG_LINES),
}
