"""Gathers in ordered headers: boundaries, sub-gathers, sorting, partitions and sort-order detection.

Ordered operators work in blocks: a column that doesn't fall along the order splits the rows into
blocks small enough for a task; what spans blocks is settled on one row per block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensemble_index(headers: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """(ensemble_id, keys, start_trace, end_trace inclusive, n_traces): runs of equal keys along the order.

    Runs are found within blocks by a window; a run that goes on into the next block is joined to it by
    the blocks' first and last keys. Only blocks' summaries are seen by one task.
    """
    key = F.struct(*keys)
    rows = headers.select(block.alias("_block"), key.alias("_key"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    w = Window.partitionBy("_block").orderBy(*[f"_o{i}" for i in range(len(order))])
    new = ~F.lag("_key").over(w).eqNullSafe(F.col("_key"))
    rows = rows.withColumn("_at", F.row_number().over(w)).withColumn("_new", F.when((F.col("_at") == 1) | new, 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("_block", "_run").agg(F.first("_key").alias("_key"), F.min("_at").alias("_at"), F.count("*").alias("_n"))
    blocks = runs.groupBy("_block").agg(F.min_by("_key", "_run").alias("_first"), F.max_by("_key", "_run").alias("_last"), F.count("*").alias("_runs"), F.sum("_n").alias("_rows"))
    along = Window.orderBy("_block")
    goes_on = F.when(F.lag("_block").over(along).isNotNull() & F.lag("_last").over(along).eqNullSafe(F.col("_first")), 1).otherwise(0)
    blocks = blocks.withColumn("_on", goes_on)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        (F.coalesce(F.sum(F.col("_runs") - F.col("_on")).over(before), F.lit(0)) - F.col("_on")).alias("_runs_before"),
    )
    placed = runs.join(blocks, F.col("_block").eqNullSafe(F.col("_b")))
    ids = placed.groupBy((F.col("_runs_before") + F.col("_run") - 1).alias("ensemble_id")).agg(
        F.first("_key").alias("_key"), F.min(F.col("_rows_before") + F.col("_at") - 1).alias("start_trace"), F.sum("_n").alias("n_traces")
    )
    return ids.select("ensemble_id", "_key.*", "start_trace", (F.col("start_trace") + F.col("n_traces") - 1).alias("end_trace"), "n_traces")


def sub_gathers(headers: DataFrame, gather: str, boundary: str, order: list[str], least: int = 8) -> DataFrame:
    """(gather, sub_id, boundary value, start, end inclusive, n_traces, enough) of each run of the boundary header in a gather; start counts within the gather."""
    w = Window.partitionBy(gather).orderBy(*order)
    new = F.when((F.row_number().over(w) == 1) | ~F.lag(boundary).over(w).eqNullSafe(F.col(boundary)), 1).otherwise(0)
    rows = headers.withColumn("_at", F.row_number().over(w) - 1).withColumn("_new", new)
    rows = rows.withColumn("sub_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = rows.groupBy(gather, "sub_id").agg(F.first(boundary).alias(boundary), F.min("_at").cast("long").alias("start_trace"), F.max("_at").cast("long").alias("end_trace"), F.count("*").alias("n_traces"))
    return out.withColumn("enough", F.col("n_traces") >= least)


def sort_in_gathers(headers: DataFrame, gather: str, keys: list[tuple[str, bool]], trace: list[str]) -> DataFrame:
    """headers with new_index, the place within the gather by the keys (name, ascending); ties by trace."""
    by = [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in keys if k in headers.columns]
    return headers.withColumn("new_index", (F.row_number().over(Window.partitionBy(gather).orderBy(*by, *trace)) - 1).cast("long"))


def sort_mapping(sorted_headers: DataFrame, gather: str, trace_index: str) -> DataFrame:
    """(new_trace_index, original_trace_index): gathers keep their ranges, which start where their least trace does."""
    first = sorted_headers.groupBy(gather).agg(F.min(trace_index).alias("_first"))
    return sorted_headers.join(first, gather).select((F.col("_first") + F.col("new_index")).alias("new_trace_index"), F.col(trace_index).alias("original_trace_index"))


def gather_partitions(ensembles: DataFrame, n: int) -> DataFrame:
    """ensembles(ensemble_id, n_traces) with segment, 0 to n - 1: whole gathers, cut where their running total passes equal shares. Rows are gathers, few beside traces."""
    before = F.coalesce(F.sum("n_traces").over(Window.orderBy("ensemble_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_traces").over(Window.partitionBy())
    return ensembles.withColumn("segment", F.least(F.lit(n - 1), F.floor(before * n / total)).cast("long"))


def key_continuity(headers: DataFrame, key: str, order: list[str], block: Column) -> DataFrame:
    """(key, n_unique, n_runs, score): unique values over runs; 1 where each value is one run, as in headers sorted by the key."""
    runs = ensemble_index(headers, [key], order, block)
    return runs.agg(F.count_distinct(key).alias("n_unique"), F.count("*").alias("n_runs")).select(F.lit(key).alias("key"), "n_unique", "n_runs", F.try_divide("n_unique", "n_runs").alias("score"))


def sort_order(headers: DataFrame, candidates: list[str], order: list[str], block: Column) -> DataFrame:
    """Candidates, as key_continuity() has them, by score times a penalty for gathers of a few or of nearly all traces; the first of the best comes first.

    One sort along the order serves all candidates: blocks are summed up to their runs and their first and last keys.
    """
    w, along = Window.partitionBy("_block").orderBy(*order), Window.orderBy("_block")
    rows = headers.select(block.alias("_block"), *dict.fromkeys([*candidates, *order])).withColumn("_at", F.row_number().over(w))
    new = [F.when((F.col("_at") == 1) | ~F.lag(c).over(w).eqNullSafe(F.col(c)), 1).otherwise(0).alias(f"_new{i}") for i, c in enumerate(candidates)]
    sums = [f(c, i) for i, c in enumerate(candidates) for f in (
        lambda c, i: F.sum(f"_new{i}").alias(f"_runs{i}"), lambda c, i: F.min_by(F.struct(c), "_at").alias(f"_first{i}"), lambda c, i: F.max_by(F.struct(c), "_at").alias(f"_last{i}"))]
    blocks = rows.select("_block", "_at", *candidates, *new).groupBy("_block").agg(F.count("*").alias("_rows"), *sums)
    on = [F.when((F.row_number().over(along) > 1) & F.lag(f"_last{i}").over(along).eqNullSafe(F.col(f"_first{i}")), 1).otherwise(0) for i in range(len(candidates))]
    runs = blocks.select("_rows", *[(F.col(f"_runs{i}") - o).alias(f"_runs{i}") for i, o in enumerate(on)])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = runs.agg(total("_rows").alias("_n"), F.array(*[total(f"_runs{i}") for i in range(len(candidates))]).alias("_runs"))
    unique = reduce(DataFrame.unionByName, [headers.agg(F.count_distinct(c).alias("n_unique")).select(F.lit(i).alias("_place"), F.lit(c).alias("key"), "n_unique") for i, c in enumerate(candidates)])
    rows = unique.join(counted.select("_n", F.posexplode("_runs").alias("_place", "n_runs")), "_place")
    size = F.try_divide(F.col("_n").cast("double"), "n_unique")
    penalty = F.when(size < 2, 0.7).when(size > F.col("_n") / 2, 0.9).otherwise(1.0)
    return rows.select("key", "n_unique", "n_runs", (F.try_divide("n_unique", "n_runs") * penalty).alias("score"), "_place").orderBy(F.desc("score"), "_place").drop("_place")


def available_headers(headers: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(header, n_unique) of numeric headers with at least so many values (and at most), most first. One pass."""
    numeric = [f.name for f in headers.schema.fields if f.dataType.typeName() in ("integer", "long", "short", "float", "double")]
    one = headers.agg(*[F.count_distinct(c).alias(c) for c in numeric])
    rows = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in numeric]), F.array(*[F.col(c) for c in numeric]))).alias("header", "n_unique"))
    kept = rows.where((F.col("n_unique") >= least) & (F.lit(most is None) | (F.col("n_unique") <= (most or 0))))
    return kept.orderBy(F.desc("n_unique"), "header")


def _steps(headers: DataFrame, value: str, order: list[str], gather: str) -> DataFrame:
    w = Window.partitionBy(gather).orderBy(*order)
    return headers.select(gather, (F.col(value) - F.lag(value).over(w)).alias("step")).where("step IS NOT NULL")


def spacing(headers: DataFrame, value: str, order: list[str], gather: str, default: float = 25.0) -> DataFrame:
    """By gather, statistics of the magnitudes of steps that aren't zero; spacing is their median where that lies in 0.1 to 1000, else the default."""
    size = F.abs(F.col("step"))
    rows = _steps(headers, value, order, gather).where(size > 0).groupBy(gather).agg(
        F.percentile(size, F.lit(0.5)).alias("median"), F.avg(size).alias("mean"), F.stddev_pop(size).alias("std"), F.min(size).alias("least"), F.max(size).alias("most"), F.count("*").alias("n_steps")
    )
    gathers = headers.select(gather).distinct()
    usable = F.col("median").between(0.1, 1000)
    return gathers.join(rows, gather, "left").withColumn("spacing", F.when(usable, F.col("median")).otherwise(F.lit(default)))


def step_uniformity(headers: DataFrame, value: str, order: list[str], gather: str, multiple: float = 3.0) -> DataFrame:
    """By gather: median step, coefficient of variation in percent, and how many steps are gaps (over multiple times the median)."""
    steps = _steps(headers, value, order, gather).select(gather, F.abs("step").alias("step"))
    stats = steps.groupBy(gather).agg(F.percentile("step", F.lit(0.5)).alias("median"), (100 * F.try_divide(F.stddev_pop("step"), F.avg("step"))).alias("cv"), F.count("*").alias("n_steps"))
    gaps = steps.join(stats.select(gather, "median"), gather).where(F.col("step") > multiple * F.col("median")).groupBy(gather).agg(F.count("*").alias("n_gaps"))
    return stats.join(gaps, gather, "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))
