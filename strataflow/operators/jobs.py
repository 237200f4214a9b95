"""Job history: filters, statistics, daily counts, alerts. Jobs are rows (id, name, job_type, state, created_at, completed_at, duration, tags)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDERS = ("created_at", "completed_at", "duration", "name", "state")
STATES = ("PENDING", "QUEUED", "RUNNING", "PAUSED", "COMPLETED", "FAILED", "CANCELLED", "RETRYING", "TIMEOUT")


def search(jobs: DataFrame, states: list[str] | None = None, types: list[str] | None = None, start=None, end=None, name_like: str | None = None, tags: list[str] | None = None, order: str = "completed_at", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Jobs by states, types, creation time, part of the name and any of the tags, newest first; an unknown order is completed_at. Tags are asked before the limit, so a page is full where rows allow."""
    rows = jobs
    if states:
        rows = rows.where(F.col("state").isin(states))
    if types:
        rows = rows.where(F.col("job_type").isin(types))
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("created_at") <= F.lit(end))
    if name_like:
        rows = rows.where(F.contains(F.col("name"), F.lit(name_like)))
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    rows = rows.orderBy(F.desc_nulls_last(order if order in ORDERS else "completed_at"), "id")
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def statistics(jobs: DataFrame) -> DataFrame:
    """(job_type, n, completed, failed, mean, least, most, total duration of completed, error_rate percent) by type, and of all under null."""
    done, failed = F.col("state") == "COMPLETED", F.col("state") == "FAILED"
    d = F.when(done, F.col("duration"))
    rows = jobs.rollup("job_type").agg(F.count("*").alias("n"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"), F.avg(d).alias("mean_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"), F.sum(d).alias("total_duration"))
    return rows.withColumn("error_rate", F.round(F.coalesce(F.try_divide(100.0 * F.col("failed"), F.col("failed") + F.col("completed")), F.lit(0.0)), 2))


def daily_counts(jobs: DataFrame) -> DataFrame:
    """(day, state, n)."""
    return jobs.groupBy(F.to_date("created_at").alias("day"), "state").agg(F.count("*").alias("n"))


def consecutive_failures(jobs: DataFrame, by: str, threshold: int = 3) -> DataFrame:
    """(by, run_start, run_end, n): runs of failures, unbroken by another state, at least as long as the threshold."""
    w = Window.partitionBy(by).orderBy("created_at", "id")
    failed = F.col("state") == "FAILED"
    rows = jobs.withColumn("_breaks", F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(failed)
    return rows.groupBy(by, "_breaks").agg(F.min("created_at").alias("run_start"), F.max("created_at").alias("run_end"), F.count("*").alias("n")).where(F.col("n") >= threshold).drop("_breaks")


def error_rates(jobs: DataFrame, minutes: int = 60, slide: int | None = None, least: int = 5, rate: float = 0.2) -> DataFrame:
    """(window_start, n, failed, error_rate, alert) by window of creation time."""
    w = F.window("created_at", f"{minutes} minutes", f"{slide} minutes" if slide else None)
    rows = jobs.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "FAILED").alias("failed"))
    r = F.col("failed") / F.col("n")
    return rows.select(F.col("w.start").alias("window_start"), "n", "failed", r.alias("error_rate"), ((F.col("n") >= least) & (r >= rate)).alias("alert"))


def long_running(jobs: DataFrame, now, hours: float = 2.0) -> DataFrame:
    """Running jobs begun so many hours before now."""
    return jobs.where((F.col("state") == "RUNNING") & (F.col("created_at") < F.lit(now) - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")))


def progress(workers: DataFrame) -> DataFrame:
    """(job_id, percent) of workers(job_id, processed, total)."""
    return workers.groupBy("job_id").agg((100 * F.coalesce(F.try_divide(F.sum("processed"), F.sum("total")), F.lit(0.0))).alias("percent"))
