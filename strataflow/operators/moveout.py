"""Moveout with a velocity function of time, forwards and back, and lookups of tables and samples at times.

The velocity function or table is configuration (knots, a few kilobytes); its size is checked before it
goes to workers with the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.filters import per_trace_with

MOST_KNOTS = 1_000_000


def collected(knots: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(t, v) of knots(t, v), in order; more than MOST_KNOTS is an error, as a function of time has no need of them."""
    rows = knots.select("t", "v").orderBy("t").limit(MOST_KNOTS + 1).collect()
    if len(rows) > MOST_KNOTS:
        raise ValueError(f"more than {MOST_KNOTS} knots")
    return np.array([r["t"] for r in rows], float), np.array([r["v"] for r in rows], float)


def times(n: int, dt_s: float, offset: float, v: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t0 = np.arange(n) * dt_s
    return t0, np.sqrt(t0**2 + (abs(offset) / np.interp(t0, *v)) ** 2)


def stretch_mask(n: int, dt_s: float, offset: float, v: tuple[np.ndarray, np.ndarray], most: float = 1.5) -> np.ndarray:
    """True where stretch passes the limit; the first sample is as the second."""
    t0, t = times(n, dt_s, offset, v)
    out = t > most * t0
    if n > 1:
        out[0] = out[1]
    return out


def _sinc(trace: np.ndarray, at: np.ndarray, half: int = 4) -> np.ndarray:
    """Samples at fractional places, by a Hann-windowed sinc; 0 outside the trace."""
    k = np.floor(at).astype(int)[:, None] + np.arange(1 - half, half + 1)[None, :]
    d = at[:, None] - k
    w = np.sinc(d) * np.where(np.abs(d) < half, 0.5 * (1 + np.cos(np.pi * d / half)), 0)
    inside = (k >= 0) & (k < len(trace))
    return np.where((at >= 0) & (at <= len(trace) - 1), (np.where(inside, trace[np.clip(k, 0, len(trace) - 1)], 0) * w).sum(axis=1), 0)


def nmo(df: DataFrame, knots: DataFrame, dt_s: float, stretch: float = 1.5, taper: int = 10, method: str = "linear", offset: str = "offset") -> DataFrame:
    """df with samples from the moveout times, zero beyond the trace and where stretched, a linear taper before the first muted sample. method: linear or sinc."""
    v = collected(knots)

    def one(trace: np.ndarray, x: float) -> np.ndarray:
        t0, t = times(len(trace), dt_s, x, v)
        out = np.interp(t, t0, trace, left=0, right=0) if method == "linear" else _sinc(trace, t / dt_s)
        muted = stretch_mask(len(trace), dt_s, x, v, stretch)
        if muted.any() and (first := int(np.argmax(muted))):
            k = min(taper, first)
            out[first - k : first] *= np.linspace(1, 0, k)
        return np.where(muted, 0, out)

    return per_trace_with(df, offset, one)


def inverse_nmo(df: DataFrame, knots: DataFrame, dt_s: float, offset: str = "offset") -> DataFrame:
    """df with samples put back to their moveout times, as far as they weren't muted."""
    v = collected(knots)

    def one(trace: np.ndarray, x: float) -> np.ndarray:
        t0, t = times(len(trace), dt_s, x, v)
        return np.interp(t0, t, trace, left=0, right=0)

    return per_trace_with(df, offset, one)


def sample_at(samples: Column, t_ms: Column, dt_ms: float, t_min_ms: float = 0.0) -> Column:
    """The sample at a time, between its neighbours linearly; times outside are clamped to the trace."""
    n = F.size(samples)
    at = F.greatest(F.lit(0.0), F.least(n - 1.001, (t_ms - t_min_ms) / dt_ms))
    k = F.floor(at).cast("int")
    a, b = F.get(samples, k).cast("double"), F.get(samples, k + 1).cast("double")
    return a + (b - a) * (at - k)


def table_lookup(table: list[list[float]], x: Column, y: Column, step: tuple[float, float]) -> Column:
    """Bilinear lookup of a table (rows by x) at regular steps, clamped to it; the table is a literal, of MOST_KNOTS entries at most."""
    nx, ny = len(table), len(table[0])
    if nx * ny > MOST_KNOTS:
        raise ValueError(f"a table of more than {MOST_KNOTS} entries")
    flat = F.array(*[F.lit(float(v)) for row in table for v in row])
    u, v = (F.greatest(F.lit(0.0), F.least(F.lit(n - 1.000001), c / s)) for c, n, s in ((x, nx, step[0]), (y, ny, step[1])))
    i, j = F.floor(u).cast("int"), F.floor(v).cast("int")
    at = lambda a, b: F.element_at(flat, a * ny + b + 1)
    fu, fv = u - i, v - j
    return (at(i, j) * (1 - fu) + at(i + 1, j) * fu) * (1 - fv) + (at(i, j + 1) * (1 - fu) + at(i + 1, j + 1) * fu) * fv


def depth_groups(depths: DataFrame, most: float, max_angle: float, n: int = 5) -> DataFrame:
    """(z, aperture, depth_group) of depths(z): those with apertures of like size, in groups by equal ratios between the least (100 at least) and the largest."""
    from strataflow.functions.physics import effective_aperture

    rows = depths.select("z").withColumn("aperture", effective_aperture(F.col("z"), most, max_angle))
    ends = rows.agg(F.greatest(F.lit(100.0), F.min(F.when(F.col("aperture") > 0, F.col("aperture")))).alias("low"), (F.max("aperture") * 1.1).alias("high"))
    share = F.log(F.greatest(F.col("aperture"), F.col("low")) / F.col("low")) / F.log(F.col("high") / F.col("low"))
    group = F.when(F.col("high") > F.col("low"), F.least(F.lit(n - 1), F.floor(share * n))).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).select("z", "aperture", group.cast("long").alias("depth_group"))


def trace_estimates(traces: DataFrame, cell: float, x: str = "tx", y: str = "ty") -> DataFrame:
    """(cx, cy, n): traces by square cell, to size image tiles."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    return traces.groupBy(at(x).alias("cx"), at(y).alias("cy")).agg(F.count("*").alias("n"))
