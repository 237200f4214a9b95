"""Offset and azimuth bins: constructors, assignment, coverage, overlaps, gaps and suggestions.

A bin holds offset_min <= offset < offset_max and azimuth_min <= azimuth < azimuth_max, where an
azimuth range whose end is below its start goes through north. Bins are configuration, a list made by
a person or a constructor; MOST_BROADCAST of them at most are joined by broadcast, more by offset cells.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BROADCAST = 1000
SCHEMA = "bin_name string, offset_min double, offset_max double, azimuth_min double, azimuth_max double, enabled boolean"


class Bin(NamedTuple):
    bin_name: str
    offset_min: float
    offset_max: float
    azimuth_min: float = 0.0
    azimuth_max: float = 360.0
    enabled: bool = True


def common_offset(ranges: list[tuple[float, float]], prefix: str = "offset") -> list[Bin]:
    return [Bin(f"{prefix}_{int(a):04d}_{int(b):04d}", a, b) for a, b in ranges]


def uniform_offset(least: float = 0.0, most: float = 5000.0, n: int = 10) -> list[Bin]:
    edges = [least + (most - least) * k / n for k in range(n + 1)]
    return common_offset(list(zip(edges[:-1], edges[1:], strict=True)))


def ovt(ranges: list[tuple[float, float]], sectors: int = 4) -> list[Bin]:
    """Offset vector tiles: each range by each azimuth sector."""
    size = 360 / sectors
    return [Bin(f"ovt_off{int(a):04d}_az{int(k * size):03d}", a, b, k * size, (k + 1) * size) for a, b in ranges for k in range(sectors)]


def narrow_azimuth(least: float = 0.0, most: float = 5000.0, inline_azimuth: float = 0.0, width: float = 20.0) -> list[Bin]:
    """Four bins, along and across the inline direction both ways; an end at north counts as 360."""
    turns = {"inline_pos": 0, "inline_neg": 180, "xline_pos": 90, "xline_neg": 270}
    return [Bin(name, least, most, (inline_azimuth + turn - width / 2) % 360, (inline_azimuth + turn + width / 2) % 360 or 360.0) for name, turn in turns.items()]


def full_stack(most: float = 10000.0) -> list[Bin]:
    return [Bin("full_stack", 0.0, most)]


def custom_offset(least: float, most: float, n: int, logarithmic: bool = False) -> list[Bin]:
    """n bins of equal width, or of equal ratio (from 1 where the first edge is lower), whose first edge is least."""
    if logarithmic:
        low = max(least, 1.0)
        edges = [least, *[low * (most / low) ** (k / n) for k in range(1, n + 1)]]
    else:
        edges = [least + (most - least) * k / n for k in range(n + 1)]
    return common_offset(list(zip(edges[:-1], edges[1:], strict=True)))


# Offset edges of the presets.
LAND_3D = (0, 200, 400, 600, 800, 1000, 1500, 2000, 2500, 3000, 5000)
MARINE = (0, 500, 1000, 2000, 3000, 4500, 8000)
WIDE_AZIMUTH = (0, 1000, 2000, 3500, 6000)


def preset(name: str, **how) -> list[Bin]:
    """land_3d, marine, wide_azimuth_ovt, narrow_azimuth (by inline_azimuth) or full_stack (by most)."""
    ranges = lambda e: list(zip(map(float, e[:-1]), map(float, e[1:]), strict=True))
    if name == "narrow_azimuth":
        return narrow_azimuth(0.0, 8000.0, width=30.0, **how)
    if name == "full_stack":
        return full_stack(**how)
    return {"land_3d": common_offset(ranges(LAND_3D), "land3d"), "marine": common_offset(ranges(MARINE), "marine"), "wide_azimuth_ovt": ovt(ranges(WIDE_AZIMUTH), 4)}[name]


def frame(spark: SparkSession, bins: list[Bin]) -> DataFrame:
    return spark.createDataFrame([(b.bin_name, *map(float, b[1:5]), b.enabled) for b in bins], SCHEMA)


def contains(offset: Column, azimuth: Column, b) -> Column:
    """Whether a bin (a Bin, or a mapping of its columns) holds a trace."""
    low, high = (b.azimuth_min, b.azimuth_max) if isinstance(b, Bin) else (b["azimuth_min"], b["azimuth_max"])
    near, far = (b.offset_min, b.offset_max) if isinstance(b, Bin) else (b["offset_min"], b["offset_max"])
    low, high = (F.lit(x) if isinstance(x, float | int) else x for x in (low, high))
    turn = F.when(high < low, (azimuth >= low) | (azimuth < high)).otherwise((azimuth >= low) & (azimuth < high))
    return (offset >= near) & (offset < far) & turn


def assign(traces: DataFrame, bins: list[Bin], offset: str = "offset", azimuth: str = "azimuth", enabled_only: bool = True, how: str = "inner") -> DataFrame:
    """traces with bin_name, a row for each bin that holds a trace (how=left: a trace in none keeps a row of null).

    The bins' number is checked: up to MOST_BROADCAST they are broadcast; beyond, traces and bins meet
    in cells of offset and only then compare, so that a trace meets the bins around it, not all.
    """
    chosen = [b for b in bins if b.enabled or not enabled_only]
    table = frame(traces.sparkSession, chosen).drop("enabled")
    columns = {c: F.col(f"_{c}") for c in table.columns}
    renamed = table.toDF(*[f"_{c}" for c in table.columns])
    holds = contains(F.col(offset), F.col(azimuth), columns)
    if len(chosen) <= MOST_BROADCAST:
        joined = traces.join(F.broadcast(renamed), holds, how)
    else:
        width = sorted(b.offset_max - b.offset_min for b in chosen)[len(chosen) // 2] or 1.0
        cell = lambda c: F.floor(c / width).cast("long")
        cells = renamed.withColumn("_cell", F.explode(F.sequence(cell(F.col("_offset_min")), cell(F.col("_offset_max")))))
        joined = traces.withColumn("_own", cell(F.col(offset))).join(cells, (F.col("_own") == F.col("_cell")) & holds, how).drop("_own", "_cell")
    return joined.withColumn("bin_name", F.col("_bin_name")).drop(*columns.values())


def _row_number_free(traces: DataFrame, bins: list[Bin], offset: str, azimuth: str) -> Column:
    """How many enabled bins hold a trace: a sum of predicates, without a join."""
    out = F.lit(0)
    for b in bins:
        if b.enabled:
            out = out + F.when(contains(F.col(offset), F.col(azimuth), b), 1).otherwise(0)
    return out


def coverage(traces: DataFrame, bins: list[Bin], offset: str = "offset", azimuth: str = "azimuth") -> DataFrame:
    """(n_traces, n_unassigned, n_multiple, coverage_percent) in one pass."""
    n = _row_number_free(traces, bins, offset, azimuth)
    one = traces.select(n.alias("n")).agg(F.count("*").alias("n_traces"), F.count_if(F.col("n") == 0).alias("n_unassigned"), F.count_if(F.col("n") > 1).alias("n_multiple"))
    return one.withColumn("coverage_percent", F.coalesce(F.try_divide(100.0 * (F.col("n_traces") - F.col("n_unassigned")), "n_traces"), F.lit(0.0)))


def summary(traces: DataFrame, bins: list[Bin], offset: str = "offset", azimuth: str = "azimuth") -> DataFrame:
    """(bin_name, n_traces) of all bins, also empty ones."""
    counts = assign(traces, bins, offset, azimuth).groupBy("bin_name").agg(F.count("*").alias("n_traces"))
    return frame(traces.sparkSession, [b for b in bins if b.enabled]).select("bin_name").join(counts, "bin_name", "left").withColumn("n_traces", F.coalesce("n_traces", F.lit(0)))


def overlaps(bins: DataFrame) -> DataFrame:
    """(bin_a, bin_b) of enabled bins(bin_name, offset_min, offset_max, azimuth_min, azimuth_max, enabled) that share offsets and azimuths, the earlier name first.

    Bins meet in cells of their mean width, to each of which a bin is sent that it reaches, so it is a join by
    equality; of the cells that two share, the first counts.
    """
    on = bins.where("enabled AND offset_max > offset_min")
    width = on.agg(F.avg(F.col("offset_max") - F.col("offset_min"))).first()[0]
    if not width:
        return on.select(F.col("bin_name").alias("bin_a"), F.col("bin_name").alias("bin_b")).limit(0)
    cell = lambda c: F.floor(F.col(c) / width)
    sent = on.withColumn("first", cell("offset_min")).withColumn("cell", F.explode(F.sequence(F.col("first"), cell("offset_max"))))
    a, b = (sent.select("cell", *[F.col(c).alias(f"{c}_{k}") for c in ("bin_name", "offset_min", "offset_max", "azimuth_min", "azimuth_max", "first")]) for k in "ab")
    inside = lambda x, k: F.when(F.col(f"azimuth_max_{k}") < F.col(f"azimuth_min_{k}"), (x >= F.col(f"azimuth_min_{k}")) | (x < F.col(f"azimuth_max_{k}"))).otherwise((x >= F.col(f"azimuth_min_{k}")) & (x < F.col(f"azimuth_max_{k}")))
    met = a.join(b, "cell").where("bin_name_a < bin_name_b AND offset_min_a < offset_max_b AND offset_min_b < offset_max_a AND cell = greatest(first_a, first_b)")
    met = met.where(inside(F.col("azimuth_min_a"), "b") | inside(F.col("azimuth_min_b"), "a"))
    return met.select(F.col("bin_name_a").alias("bin_a"), F.col("bin_name_b").alias("bin_b"))


def gaps(bins: DataFrame, step: float = 100.0) -> DataFrame:
    """(gap_start, gap_end): runs of offsets, in steps over the range of bins(offset_min, offset_max, enabled), that no enabled bin holds. Runs are numbered over the gaps' steps alone."""
    on = bins.where("enabled")
    low, high = on.agg(F.min("offset_min"), F.max("offset_max")).first()
    if low is None:
        return on.select(F.col("offset_min").alias("gap_start"), F.col("offset_max").alias("gap_end"))
    every = bins.sparkSession.range(max(0, math.ceil((high - low) / step))).withColumnRenamed("id", "k")
    first = lambda c: F.ceil((F.col(c) - low) / step)
    held = on.where(first("offset_min") < first("offset_max")).select(F.explode(F.sequence(first("offset_min"), first("offset_max") - 1)).alias("k")).distinct()
    free = every.join(held, "k", "left_anti")
    runs = free.withColumn("run", F.col("k") - F.row_number().over(Window.orderBy("k")))
    return runs.groupBy("run").agg(F.min(F.col("k") * step + low).alias("gap_start"), F.max((F.col("k") + 1) * step + low).alias("gap_end")).drop("run")


def suggest(traces: DataFrame, offset: str = "offset", target: int = 10000) -> DataFrame:
    """(bin_index, offset_min, offset_max) of bins with about so many traces each: exact quantiles of offset."""
    n = max(1, traces.count() // target)
    edges = traces.agg(F.percentile(offset, F.array(*[F.lit(k / n) for k in range(n + 1)])).alias("e"))
    return edges.select(F.posexplode(F.slice("e", 1, n)).alias("bin_index", "offset_min"), "e").select("bin_index", "offset_min", F.element_at("e", F.col("bin_index") + 2).alias("offset_max"))


def shot_id(sx: Column, sy: Column) -> Column:
    """An id for a source position; positions stay apart, as the id is the pair."""
    return F.concat_ws("_", sx.cast("long").cast("string"), sy.cast("long").cast("string"))


def index_statistics(index: DataFrame) -> DataFrame:
    """One row about index(offset, azimuth, inline, xline): extremes, mean, spread and completeness."""
    return index.agg(
        F.count("*").alias("n_traces"), F.min("offset").alias("offset_min"), F.max("offset").alias("offset_max"), F.avg("offset").alias("offset_mean"), F.stddev_pop("offset").alias("offset_std"),
        F.min("azimuth").alias("azimuth_min"), F.max("azimuth").alias("azimuth_max"), (F.count("inline") == F.count("*")).alias("has_inline"), (F.count("xline") == F.count("*")).alias("has_xline"),
    )


def validate_index(index: DataFrame) -> DataFrame:
    """One row of counts, and the issues they make: many zero offsets, very large offsets, azimuths out of range."""
    one = index.agg(F.count("*").alias("n_traces"), F.count_if(F.col("offset") == 0).alias("n_zero"), F.count_if(F.col("offset") > 50000).alias("n_far"), F.count_if((F.col("azimuth") < 0) | (F.col("azimuth") >= 360)).alias("n_azimuth"))
    return one.withColumn("many_zero_offsets", F.col("n_zero") > 0.1 * F.col("n_traces")).withColumn("valid", (F.col("n_traces") > 0) & ~F.col("many_zero_offsets") & (F.col("n_far") == 0) & (F.col("n_azimuth") == 0))
