"""Queries that run a stream over a table's files to its end and read what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.scratch import shared_folder
from quire.sources import store
from quire.streaming import events as S
from quire.streaming import jobs


def workspace(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return S.read_stream(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3: counters by operation, complete after each batch."""
    w = workspace(spark)
    S.run(S.counters(events(spark, sf_dir), ["event_type"]), S.write_version(f"{w}/t"), f"{w}/c", "complete")
    return S.versioned(spark, f"{w}/t", 1 << 60)


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1: what a stream of chapters leaves in the library, the first copy of each kept."""
    w = workspace(spark)
    new = events(spark, sf_dir).select(F.col("event_type").alias("book"), (F.col("user_id") + 1).alias("id"), F.col("event_id").cast("double").alias("fetched_at"))
    S.run(new, S.upsert_chapters(f"{w}/t"), f"{w}/c")
    return S.versioned(spark, f"{w}/t", 1 << 60)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: counts by day of event time."""
    w = workspace(spark)
    counted = S.windows(events(spark, sf_dir), "ts", ["event_type"], "1 day", "30 days")
    S.run(counted, S.write_version(f"{w}/t"), f"{w}/c", "complete")
    return S.versioned(spark, f"{w}/t", 1 << 60).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4: the state that each user's events lead to, taking event types for states."""
    w = workspace(spark)
    state = F.create_map(*[F.lit(x) for p in {"view": "running", "click": "pending", "error": "failed", "purchase": "done", "signup": "stopping"}.items() for x in p])
    e = events(spark, sf_dir).select(F.col("user_id").alias("job"), state[F.col("event_type")].alias("state"), "ts")
    S.run(S.job_states(e), S.write_version(f"{w}/t"), f"{w}/c", "complete")
    return S.versioned(spark, f"{w}/t", 1 << 60)


def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, S20: events appended to a log in two parts, read as a stream into a copy of it, and the copy's tail."""
    w = workspace(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(F.col("event_id").cast("string").alias("id"), F.format_string("%012d", "event_id").alias("timestamp"), F.col("event_type").alias("operation"), F.lit("logical").alias("event"))
    for part in ("event_id < 60", "event_id >= 60"):
        store.append_log(log.where(part.replace("event_id", "int(id)")), f"{w}/log")
        S.run(store.read_log_stream(spark, f"{w}/log"), lambda batch, number: batch.write.mode("overwrite").json(f"{w}/copy/batch={number}"), f"{w}/c")
    return store.tail(spark, f"{w}/copy/*", 20).select("id", "operation")


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5: chapters as a stream, without those committed with the same text before."""
    w = workspace(spark)
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    row = lambda d: d.select(F.col("source").alias("book"), (F.col("doc_id") + 1).alias("id"), F.md5("text").alias("raw_hash"))
    done = spark.read.parquet(path).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").withColumn("text", F.when(F.col("quality") == 1, F.col("text")).otherwise("changed"))
    S.run(S.pending_work(row(S.read_stream(spark, path, schema)), row(done), ["raw_hash"]), lambda batch, number: batch.write.mode("overwrite").parquet(f"{w}/t/batch={number}"), f"{w}/c")
    return spark.read.parquet(f"{w}/t").select("book", "id")


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7: each fingerprint's first event."""
    w = workspace(spark)
    e = events(spark, sf_dir).select("ts", F.concat("event_type", F.col("user_id").cast("string")).alias("fingerprint"))
    S.run(S.once(e, "fingerprint", "ts", "10000 days"), lambda batch, number: batch.write.mode("overwrite").parquet(f"{w}/t/batch={number}"), f"{w}/c")
    return spark.read.parquet(f"{w}/t").select("fingerprint")


EVENTS = {"view": "running", "click": "stopping", "error": "failed", "purchase": "done", "signup": "cancelled"}


def stream_job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4: three jobs for each user, their events one by one, and what each one's state allowed; 20 log lines are kept of a job."""
    w = workspace(spark)
    named = F.create_map(*[F.lit(x) for p in EVENTS.items() for x in p])
    e = events(spark, sf_dir).select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("job"), F.col("event_id").alias("id"), "ts", named[F.col("event_type")].alias("event"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("line"),
    )
    with jobs.state_store(spark):
        S.run(jobs.transitions(e, 20), lambda batch, number: batch.write.mode("overwrite").parquet(f"{w}/t/batch={number}"), f"{w}/c")
    return spark.read.schema(jobs.MOVED).parquet(f"{w}/t").drop("ts", "batch")


def _transitions_sql() -> str:
    moves = ", ".join(f"'{before}/{event}': '{after}'" for (before, event), after in jobs.TRANSITIONS.items())
    names = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENTS.items())
    return f"""
WITH RECURSIVE e AS (
  SELECT user_id || '/' || event_id % 3 AS job, event_id AS id, CASE event_type {names} END AS event, row_number() OVER w AS k, count(*) FILTER (event_type <> 'view') OVER w AS seen
  FROM events WINDOW w AS (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id)),
s AS (
  SELECT job, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::VARCHAR AS event, NULL::VARCHAR AS before, 'pending' AS state, FALSE AS accepted, 0::BIGINT AS seen FROM (SELECT DISTINCT job FROM e)
  UNION ALL SELECT e.job, e.k, e.id, e.event, s.state, coalesce(MAP {{{moves}}}[s.state || '/' || e.event], s.state), MAP {{{moves}}}[s.state || '/' || e.event] IS NOT NULL, e.seen FROM s JOIN e ON e.job = s.job AND e.k = s.k + 1)
SELECT job, id, event, before, state, accepted, greatest(0, seen - 20) AS first_line, least(seen, 20) AS lines FROM s WHERE k > 0"""


QUERIES = {
    "stream_job_transitions": (stream_job_transitions, _transitions_sql()),
    "stream_event_counts": (stream_event_counts, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "stream_upserts": (stream_upserts, "SELECT event_type AS book, user_id + 1 AS id, min(event_id)::DOUBLE AS fetched_at FROM events GROUP BY 1, 2"),
    "stream_windows": (stream_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_job_states": (
        stream_job_states,
        """WITH e AS (SELECT user_id AS job, ts, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'stopping' END AS state FROM events),
r AS (SELECT job, ts, state, list_position(['pending', 'running', 'stopping', 'cancelled', 'done', 'failed'], state) AS rank FROM e),
t AS (SELECT job, state FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, rank) AS k FROM r WHERE rank > 3) WHERE k = 1),
w AS (SELECT job, arg_max(state, rank) AS state FROM r WHERE rank <= 3 GROUP BY job)
SELECT j.job, coalesce(t.state, w.state) AS state FROM (SELECT DISTINCT job FROM e) j LEFT JOIN t USING (job) LEFT JOIN w USING (job)""",
    ),
    "stream_log_tail": (stream_log_tail, "SELECT event_id::VARCHAR AS id, event_type AS operation FROM events ORDER BY event_id DESC LIMIT 20"),
    "stream_resume": (
        stream_resume,
        "SELECT source AS book, doc_id + 1 AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)",
    ),
    "stream_once": (stream_once, "SELECT event_type || user_id AS fingerprint FROM events GROUP BY 1"),
}
