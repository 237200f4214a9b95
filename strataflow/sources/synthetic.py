"""Synthetic traces and geometries, made by ranges, expressions and arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Samples that are made at once.
BLOCK = 1 << 16


def _ricker(t: np.ndarray, frequency: float) -> np.ndarray:
    a = (math.pi * frequency * t) ** 2
    return (1 - 2 * a) * np.exp(-a)


def ricker(t, frequency: float):
    a = (F.lit(math.pi) * frequency * t) * (F.lit(math.pi) * frequency * t)
    return (1 - 2 * a) * F.exp(-a)


def events(traces: DataFrame, n_samples: int = 1000, dt_s: float = 0.002, frequency: float = 30.0, noise: float = 0.1, seed: int = 42, index: str = "trace_index") -> DataFrame:
    """traces with samples: a flat event, a dipping and a hyperbolic one by the traces' index, 25 m apart, and noise that a trace's index and the seed make."""
    i = F.col(index)

    @F.arrow_udf(T.ArrayType(T.DoubleType() if noise else T.FloatType()))
    def found(at: pa.Array) -> pa.Array:
        t, x = np.arange(n_samples) * dt_s, at.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)[:, None]
        out = np.empty((len(x), n_samples), float if noise else np.float32)
        step = max(1, BLOCK // max(1, n_samples))
        for k in range(0, len(x), step):
            own = x[k : k + step]
            waves = [_ricker(v, frequency) for v in (t - 0.2, t - 0.4 - 0.001 * own, t - np.sqrt(0.36 + (own * 25.0 / 2000) * (own * 25.0 / 2000)))]
            out[k : k + step] = waves[0] + 0.7 * waves[1] + 0.5 * waves[2]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(n_samples)), pa.array(out.ravel(), mask=np.repeat(at.is_null().to_numpy(zero_copy_only=False), n_samples)))

    def noisy(a, k):
        uniform = lambda s: (F.pmod(F.xxhash64(i, k, F.lit(seed + s)), F.lit(1 << 30)) + 1) / ((1 << 30) + 1)
        return (a + noise * F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))).cast("float")

    return traces.withColumn("samples", F.transform(found(i), noisy) if noise else found(i))


def gather(spark: SparkSession, n_traces: int = 100, n_samples: int = 1000, dt_s: float = 0.002, frequency: float = 30.0, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """(trace_index, offset, samples): events() of so many traces."""
    i = F.col("id")
    return events(spark.range(n_traces).select(i.alias("trace_index"), (i * 25.0).alias("offset")), n_samples, dt_s, frequency, noise, seed).select("trace_index", "offset", "samples")


def towed(shots: DataFrame, receivers: int = 100, shot_spacing: float = 100.0, receiver_spacing: float = 25.0, near: float = 100.0) -> DataFrame:
    """(trace_index, shot, sx, sy, rx, ry) of shots(shot) along x, numbered from 0, each with a cable of receivers behind it."""
    shot, r = F.col("shot"), F.explode(F.sequence(F.lit(0), F.lit(receivers - 1)))
    rows = shots.select("shot", r.alias("r"))
    return rows.select((shot * receivers + F.col("r")).alias("trace_index"), "shot", (shot * shot_spacing).alias("sx"), F.lit(0.0).alias("sy"), (shot * shot_spacing + near + F.col("r") * receiver_spacing).alias("rx"), F.lit(0.0).alias("ry"))


def marine(spark: SparkSession, shots: int = 10, receivers: int = 100, shot_spacing: float = 100.0, receiver_spacing: float = 25.0, near: float = 100.0) -> DataFrame:
    """towed() of so many shots."""
    return towed(spark.range(shots).withColumnRenamed("id", "shot"), receivers, shot_spacing, receiver_spacing, near)


def land_3d(spark: SparkSession, source_grid: tuple[int, int] = (10, 10), receiver_grid: tuple[int, int] = (20, 20), source_spacing: float = 200.0, receiver_spacing: float = 100.0) -> DataFrame:
    """Each source of a grid into each receiver of a grid, numbered by one range."""
    n = receiver_grid[0] * receiver_grid[1]
    s, r = F.floor(F.col("id") / n).cast("long"), F.col("id") % n
    xy = lambda k, width, step: ((k % width) * step, F.floor(k / width) * step)
    (sx, sy), (rx, ry) = xy(s, source_grid[0], source_spacing), xy(r, receiver_grid[0], receiver_spacing)
    return spark.range(source_grid[0] * source_grid[1] * n).select(F.col("id").alias("trace_index"), s.alias("shot"), sx.alias("sx"), sy.alias("sy"), rx.alias("rx"), ry.alias("ry"))


def volume(spark: SparkSession, nx: int = 32, ny: int = 32, nt: int = 128, dt_s: float = 0.004) -> DataFrame:
    """(ix, iy, samples): a plane and a curved event."""
    ix, iy = F.floor(F.col("id") / ny).cast("long"), F.col("id") % ny
    sample = lambda k: (ricker(k * dt_s - 0.15, 25.0) + ricker(k * dt_s - 0.3 - 0.00005 * (ix * ix + iy * iy), 25.0)).cast("float")
    return spark.range(nx * ny).select(ix.alias("ix"), iy.alias("iy"), F.transform(F.sequence(F.lit(0), F.lit(nt - 1)), sample).alias("samples"))


def diffractor(spark: SparkSession, n: int = 20, spacing: float = 50.0, nt: int = 256, dt_s: float = 0.004, velocity: float = 2000.0, at: tuple[float, float, float] = (500.0, 500.0, 0.4)) -> DataFrame:
    """(trace_index, tx, ty, offset, samples): zero-offset traces over a point at (x, y, two-way time)."""
    i = F.col("id")
    x, y = (i % n) * spacing, F.floor(i / n) * spacing
    t0 = F.sqrt(F.lit(at[2] ** 2) + 4 * ((x - at[0]) * (x - at[0]) + (y - at[1]) * (y - at[1])) / velocity**2)
    return spark.range(n * n).select(i.alias("trace_index"), x.alias("tx"), y.alias("ty"), F.lit(0.0).alias("offset"), F.transform(F.sequence(F.lit(0), F.lit(nt - 1)), lambda k: ricker(k * dt_s - t0, 25.0).cast("float")).alias("samples"))
