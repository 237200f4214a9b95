"""Trace operators that are expressions over an array of samples; gain control is a NumPy kernel over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions import dsp


def doubles(samples: Column) -> Column:
    return F.transform(samples, lambda x: x.cast("double"))


def gain(samples: Column, factor: float) -> Column:
    if factor == 0:
        raise ValueError("gain must not be zero")
    return F.transform(samples, lambda x: x.cast("double") * factor)


def mute(samples: Column, offset: Column, velocity: float, dt_ms: float, top: bool = False, bottom: bool = False, taper: int = 20) -> Column:
    """Linear mutes: samples before (top) or after (bottom) offset over velocity are zero, next to them a half-cosine taper."""
    if not top and not bottom:
        raise ValueError("a mute is at the top, the bottom or both")
    at = F.floor(F.abs(offset) / (velocity / 1000.0) / dt_ms)
    ramp = lambda k: 0.5 * (1 - F.cos(F.lit(math.pi) * k / max(taper - 1, 1)))

    def weight(i: Column) -> Column:
        w = F.lit(1.0)
        if top:
            w = w * F.when(i < at, 0.0).when(i < at + taper, ramp(i - at)).otherwise(1.0)
        if bottom:
            w = w * F.when(i >= at, 0.0).when(i >= at - taper, ramp(at - 1 - i)).otherwise(1.0)
        return w

    return F.transform(samples, lambda x, i: x.cast("double") * weight(i))


def window(samples: Column, start_ms: float, end_ms: float, dt_ms: float) -> Column:
    """The samples of a time window, clamped to the trace; one at least."""
    first = F.least(F.lit(int(start_ms / dt_ms)), F.size(samples) - 1)
    last = F.least(F.lit(int(end_ms / dt_ms)), F.size(samples))
    return F.slice(samples, first + 1, F.greatest(last - first, F.lit(1)))


def energy(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))


def rms(samples: Column) -> Column:
    return F.sqrt(energy(samples) / F.size(samples))


def live_count(samples: Column) -> Column:
    return F.size(F.filter(samples, lambda x: F.abs(x) > 1e-30))


def autocorrelation(samples: Column, max_lag: int) -> Column:
    """Sums of products at lags 0 to max_lag (below the length), over the length."""
    a = doubles(samples)
    n = F.size(samples)

    def at(k: Column) -> Column:
        products = F.zip_with(F.slice(a, F.lit(1), n - k), F.slice(a, k + 1, n - k), lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x) / n

    return F.transform(F.sequence(F.lit(0), F.least(F.lit(max_lag), n - 1)), at)


#: Gathers whose floors are broadcast, a number each; more are joined by shuffles.
MOST_GATHERS = 100_000


def agc(traces: DataFrame, half: int, target: float = 1.0, key: str = "trace_index", gather: str = "gather", floor: float | None = None) -> DataFrame:
    """(key, samples, scales): each sample times its scale, the target over the root mean square of the window of 2 half + 1 about it, reflected at the ends, with a floor that steadies quiet windows.

    The floor is a thousandth of the root mean square of the trace's whole gather, if none is given: one
    partial sum for each gather and task, joined to the traces. remove_agc() undoes it by the scales. Null
    samples stay null; a null within a trace counts as zero.
    """
    rows = traces.select(key, gather, "samples")
    if floor is None:
        square = F.sum(energy(F.col("samples"))) / F.sum(F.size("samples"))
        floors = traces.where("size(samples) > 0").groupBy(F.col(gather).alias("agc_gather")).agg(F.greatest(0.001 * F.sqrt(square), F.lit(1e-10)).alias("agc_floor"))
        if traces.select(gather).distinct().limit(MOST_GATHERS + 1).count() <= MOST_GATHERS:
            floors = F.broadcast(floors)
        rows = rows.join(floors, F.col(gather).eqNullSafe(F.col("agc_gather")), "left")
    else:
        rows = rows.withColumn("agc_floor", F.lit(float(floor)))
    rows = rows.select(key, doubles(F.col("samples")).alias("samples"), F.coalesce("agc_floor", F.lit(1e-10)).alias("agc_floor"))
    schema = T.StructType([rows.schema[key], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("samples", "scales")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples, floors_ = b["samples"], b["agc_floor"].to_numpy()
            flat = samples.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(samples).fill_null(0).to_numpy()
            starts, scales = np.cumsum(sizes) - sizes, np.empty(len(flat))
            for n in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == n)
                places = starts[at][:, None] + np.arange(n)
                scales[places] = dsp.agc_scales(flat[places], half, floors_[at, None], target)
            ends, nulls = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), samples.is_null()
            lists = [pa.ListArray.from_arrays(ends, pa.array(v), mask=nulls) for v in (flat * scales, scales)]
            yield pa.record_batch([b[key], *lists], schema=pa.schema([b.schema.field(key), *[pa.field(c, pa.list_(pa.float64())) for c in ("samples", "scales")]]))

    return rows.mapInArrow(run, schema)


def remove_agc(samples: Column, scales: Column) -> Column:
    return F.zip_with(samples, scales, lambda x, s: x / (s + 1e-10))


def nmo(samples: Column, offset: Column, velocity: float, dt_s: float, stretch_mute: float = 1.5) -> Column:
    """Moveout correction at constant velocity: linear interpolation at the moveout time, zero outside the trace and where stretch passes the limit."""
    n = F.size(samples)

    def at(i: Column) -> Column:
        t0 = i * dt_s
        t = F.sqrt(t0 * t0 + (offset / velocity) * (offset / velocity))
        k = F.floor(t / dt_s).cast("int")
        part = t / dt_s - k
        a = F.get(samples, k).cast("double")
        b = F.coalesce(F.get(samples, k + 1).cast("double"), F.lit(0.0))
        value = a + (b - a) * part
        too_far = (k > n - 1) | ((k == n - 1) & (part > 0))
        stretched = F.when(t0 > 0, t / t0 > stretch_mute).otherwise(offset != 0)
        return F.when(too_far | stretched, 0.0).otherwise(value)

    return F.transform(F.sequence(F.lit(0), n - 1), at)
