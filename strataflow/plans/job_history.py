"""Queries over events as a job history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import jobs as J

_COLUMNS = {
    "id": "event_id",
    "worker": "user_id",
    "name": "concat(event_type, '-', CAST(user_id AS STRING))",
    "job_type": "event_type",
    "state": "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'RUNNING' ELSE CASE WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END END",
    "created_at": "ts",
    "completed_at": "ts",
    "duration": "round(value, 3)",
}
SQL = "WITH j AS (SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in _COLUMNS.items()) + " FROM events)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} AS {n}" for n, e in _COLUMNS.items()])
    return rows.withColumn("tags", F.array(F.col("job_type"), F.concat(F.lit("w"), (F.col("worker") % 4).cast("string"))))


def found(s, d):
    return J.search(jobs(s, d), ["FAILED", "COMPLETED"], start=datetime(2024, 1, 5), end=datetime(2024, 1, 20), name_like="-1", tags=["w1", "w2"], order="duration", limit=100, offset=10).select("id", "state", "duration")


def statistics(s, d):
    return J.statistics(jobs(s, d)).select("job_type", "n", "completed", "failed", *[F.round(c, 6).alias(c) for c in ("mean_duration", "min_duration", "max_duration", "total_duration")], "error_rate")


_D = "FILTER (WHERE state = 'COMPLETED')"
QUERIES = {
    "job_search": (found, SQL + " SELECT id, state, duration FROM j WHERE state IN ('FAILED', 'COMPLETED') AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND contains(name, '-1') AND worker % 4 IN (1, 2) ORDER BY duration DESC NULLS LAST, id LIMIT 100 OFFSET 10"),
    "job_recent": (lambda s, d: J.search(jobs(s, d), limit=20).select("id", "state", "completed_at"), SQL + " SELECT id, state, completed_at FROM j ORDER BY completed_at DESC NULLS LAST, id LIMIT 20"),
    "job_failed": (lambda s, d: J.search(jobs(s, d), ["FAILED"], limit=20).select("id", "state", "completed_at"), SQL + " SELECT id, state, completed_at FROM j WHERE state = 'FAILED' ORDER BY completed_at DESC NULLS LAST, id LIMIT 20"),
    "job_statistics": (statistics, SQL + f" SELECT job_type, count(*) AS n, count(*) {_D} AS completed, count(*) FILTER (WHERE state = 'FAILED') AS failed, round(avg(duration) {_D}, 6) AS mean_duration, round(min(duration) {_D}, 6) AS min_duration, round(max(duration) {_D}, 6) AS max_duration, round(sum(duration) {_D}, 6) AS total_duration, round(coalesce(100.0 * count(*) FILTER (WHERE state = 'FAILED') / nullif(count(*) FILTER (WHERE state IN ('FAILED', 'COMPLETED')), 0), 0), 2) AS error_rate FROM j GROUP BY ROLLUP (job_type)"),
    "job_daily_counts": (lambda s, d: J.daily_counts(jobs(s, d)), SQL + " SELECT CAST(created_at AS DATE) AS day, state, count(*) AS n FROM j GROUP BY 1, 2"),
    "job_consecutive_failures": (lambda s, d: J.consecutive_failures(jobs(s, d), "worker", 2), SQL + ", b AS (SELECT *, sum(CASE WHEN state = 'FAILED' THEN 0 ELSE 1 END) OVER (PARTITION BY worker ORDER BY created_at, id) AS b FROM j) SELECT worker, min(created_at) AS run_start, max(created_at) AS run_end, count(*) AS n FROM b WHERE state = 'FAILED' GROUP BY worker, b HAVING count(*) >= 2"),
    "job_error_rates": (lambda s, d: J.error_rates(jobs(s, d)).withColumn("error_rate", F.round("error_rate", 6)), SQL + " SELECT date_trunc('hour', created_at) AS window_start, count(*) AS n, count(*) FILTER (WHERE state = 'FAILED') AS failed, round(count(*) FILTER (WHERE state = 'FAILED') / CAST(count(*) AS DOUBLE), 6) AS error_rate, count(*) >= 5 AND count(*) FILTER (WHERE state = 'FAILED') >= 0.2 * count(*) AS alert FROM j GROUP BY 1"),
    "job_long_running": (lambda s, d: J.long_running(jobs(s, d), datetime(2024, 1, 10), 2).select("id", "created_at"), SQL + " SELECT id, created_at FROM j WHERE state = 'RUNNING' AND created_at < TIMESTAMP '2024-01-09 22:00:00'"),
    "job_progress": (lambda s, d: J.progress(jobs(s, d).select(F.col("worker").alias("job_id"), F.when(F.col("state") == "COMPLETED", 1).otherwise(0).alias("processed"), F.lit(1).alias("total"))).withColumn("percent", F.round("percent", 6)), SQL + " SELECT worker AS job_id, round(100.0 * count(*) FILTER (WHERE state = 'COMPLETED') / count(*), 6) AS percent FROM j GROUP BY worker"),
}
