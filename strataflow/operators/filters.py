"""NumPy kernels over traces in Spark: trace by trace, gather by gather, cube by cube.

Traces are rows with samples ARRAY<FLOAT or DOUBLE>. Trace kernels see Arrow batches, and a batch's
traces of one length as one matrix; nothing is shuffled. Gather kernels see a gather's traces in order.
Where a kernel looks only so many neighbours far, a long gather goes in blocks with a halo of that many
traces from the blocks beside, so a gather of any size has bounded tasks. Cubes need all their traces
at once; they spread over tasks by volume.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions import cones, dsp
from strataflow.operators import volumes

Kernel = Callable[[np.ndarray], np.ndarray]


def _matrix(samples: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all values) of a list array."""
    lengths = pa.compute.list_value_length(samples).fill_null(0).to_numpy()
    return lengths, samples.flatten().to_numpy(zero_copy_only=False).astype(float)


def _applied(samples: pa.Array, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Array:
    """f(traces of one length, their places) for each length, put together in order; null samples stay null."""
    lengths, flat = _matrix(samples)
    starts = np.cumsum(lengths) - lengths
    out: list[np.ndarray] = [np.empty(0)] * len(lengths)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = flat[starts[at][:, None] + np.arange(n)[None, :]]
        for k, row in zip(at, f(rows, at) if n else rows, strict=True):
            out[k] = np.asarray(row, float)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), np.concatenate([np.empty(0), *out]), mask=samples.is_null())


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == "samples" else f.dataType) for f in df.schema.fields])


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over as many tasks as a shuffle has, for kernels that cost far more than that: a small file is one task's, however long its rows take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def per_trace(df: DataFrame, kernel: Kernel) -> DataFrame:
    """df with samples put through a kernel that takes traces as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("samples")
            yield b.set_column(k, "samples", _applied(b.column(k), lambda x, _: kernel(x)))

    return df.mapInArrow(run, _schema(df))


def per_trace_with(df: DataFrame, column: str, kernel: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """df with samples put through a kernel of one trace and its value of a column, as an offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("samples")
            values = b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
            yield b.set_column(k, "samples", _applied(b.column(k), lambda x, at, v=values: np.array([kernel(row, float(v[i])) for row, i in zip(x, at, strict=True)])))

    return df.mapInArrow(run, _schema(df))


def per_gather(df: DataFrame, kernel: Kernel, gather: str, order: list[str], halo: int | None = None, block: int = 2048) -> DataFrame:
    """df with each gather put through a kernel that takes its traces in order. halo: how many neighbours to each side a trace's result depends on; None: all."""
    schema, names = _schema(df), df.columns
    by = [gather]
    rows = df
    if halo is not None:
        at = (F.row_number().over(Window.partitionBy(gather).orderBy(*order)) - 1).alias("_at")
        rows = df.withColumn("_at", at)
        around = F.sequence(F.floor(F.greatest(F.col("_at") - halo, F.lit(0)) / block), F.floor((F.col("_at") + halo) / block))
        rows = rows.withColumn("_block", F.explode(around))
        by = [gather, "_block"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(o, "ascending") for o in order])
        samples = _applied(table["samples"].combine_chunks(), lambda x, _: kernel(x))
        table = table.set_column(table.schema.get_field_index("samples"), "samples", samples)
        if halo is not None:
            own = pa.compute.equal(pa.compute.floor(pa.compute.divide(table["_at"].cast(pa.float64()), float(block))).cast(pa.int64()), table["_block"].cast(pa.int64()))
            table = table.filter(own)
        return table.select(names)

    return rows.groupBy(*by).applyInArrow(run, schema)


def per_cube(df: DataFrame, kernel: Kernel, volume: str, ix: str, iy: str) -> DataFrame:
    """df(volume, ix, iy, trace_index, samples) with each volume put through a kernel of a cube (x, y, time); cells without a trace are zero, of several traces on a cell the one of the largest trace_index counts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (ix, iy, "trace_index") if c in table.column_names])
        x, y = (table[c].to_numpy() for c in (ix, iy))
        x, y = x - x.min(), y - y.min()
        lengths, flat = _matrix(table["samples"].combine_chunks())
        cube = np.zeros((x.max() + 1, y.max() + 1, lengths.max()))
        for k, start in enumerate(np.cumsum(lengths) - lengths):
            cube[x[k], y[k], : lengths[k]] = flat[start : start + lengths[k]]
        done = kernel(cube)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.concatenate([done[x[k], y[k], :n] for k, n in enumerate(lengths)])
        return table.set_column(table.schema.get_field_index("samples"), "samples", pa.ListArray.from_arrays(offsets, values))

    return df.groupBy(volume).applyInArrow(run, _schema(df))


def average_spectrum(df: DataFrame, rate: float, by: list[str]) -> DataFrame:
    """(by, frequency, amplitude): mean magnitudes of the traces' spectra. Batches send sums, so a group is a row per batch and frequency."""
    keys = T.StructType([df.schema[k] for k in by])
    schema = T.StructType([*keys.fields, T.StructField("frequency", T.DoubleType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in by), strict=True)):
                groups.setdefault(key, []).append(k)
            lengths, flat = _matrix(b.column(b.schema.get_field_index("samples")))
            starts, rows = np.cumsum(lengths) - lengths, []
            for key, at in groups.items():
                for n in np.unique(lengths[at]):
                    own = [k for k in at if lengths[k] == n]
                    if n:
                        f, a = dsp.amplitude_spectrum(flat[starts[own][:, None] + np.arange(n)[None, :]], rate)
                        rows += [(*key, float(x), float(t), len(own)) for x, t in zip(f, a.sum(axis=0), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * (len(by) + 3)
            types = [b.schema.field(c).type for c in by] + [pa.float64(), pa.float64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*by, "frequency", "total", "n"])

    sums = df.select(*by, "samples").mapInArrow(run, schema)
    return sums.groupBy(*by, "frequency").agg((F.sum("total") / F.sum("n")).alias("amplitude"))


def dominant_frequency(spectrum: DataFrame, by: list[str], low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """(by, frequency, db) of the highest amplitude within a range; of equals the lowest frequency."""
    rows = spectrum.where((F.col("frequency") >= low) & (F.col("frequency") <= high))
    best = F.max_by(F.struct("frequency", "amplitude"), F.struct("amplitude", -F.col("frequency"))).alias("best")
    return rows.groupBy(*by).agg(best).select(*by, F.col("best.frequency").alias("frequency"), (20 * F.log10(F.col("best.amplitude") + 1e-10)).alias("db"))


def _cone(df: DataFrame, volume: str, cell: tuple[str, str], dt: float, dx: float, dy: float, v_min: float, v_max: float, taper: float = 0.1, mode: str = "reject", pad: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """dsp.fkk_filter by transposition."""
    cone = cones.Cone(v_min, v_max, mode, taper, pad_ms=(pad[2] * dt * 1000,) * 2, edges="repeat", pad_traces=pad[:2], exact=True)
    return volumes.fkk(df, cone, dt, dx, dy, volume, cell)


def _denoised(df: DataFrame, volume: str, cell: tuple[str, str], hx: int = 1, hy: int = 1, side: int | None = None, **p) -> DataFrame:
    """dsp.denoise_cube in tiles."""
    return volumes.tiled(df, lambda cube: dsp.denoise_cube(cube, hx, hy, **p), (hx, hy), volume, cell, side=side)


#: Operators by name: how they see traces (trace, offset, gather, cube, or volume, whose kernel takes the table), how far they look, and the kernel, which takes the named parameters.
REGISTRY: dict[str, tuple[str, Callable[[dict], int | None], Callable[..., Any]]] = {}


def register(name: str, sees: str, kernel: Callable[..., Any], reach: Callable[[dict], int | None] = lambda p: None) -> None:
    """Adds an operator under a name; sees: trace, offset, gather, cube or volume."""
    if sees not in ("trace", "offset", "gather", "cube", "volume"):
        raise ValueError(f"an operator sees a trace, offset, gather, cube or volume, not {sees}")
    REGISTRY[name] = (sees, reach, kernel)


def _half(p: dict) -> int:
    return p.get("half", 3)


def _decon(trace: np.ndarray, offset: float, dt_ms: float, length: int = 40, gap: int = 0, top_ms: float = 0.0, bottom_ms: float = 1e9, v_top: float = 5500.0, v_bottom: float = 2000.0, prewhitening: float = 0.1, taper_percent: float = 10.0) -> np.ndarray:
    window = dsp.decon_window(offset, top_ms, bottom_ms, v_top, v_bottom, dt_ms, len(trace))
    return dsp.deconvolve(trace, window, length, gap, prewhitening, taper_percent)


register("gain", "trace", lambda x, factor: x * factor)
register("bandpass", "trace", dsp.bandpass)
register("deconvolution", "offset", _decon)
register("dwt_denoise", "trace", dsp.dwt_denoise)
register("swt_denoise", "trace", dsp.swt_denoise)
register("dwt_spatial", "gather", dsp.dwt_spatial, _half)
register("wpt_denoise", "trace", dsp.wpt_denoise)
register("wpt_spatial", "gather", lambda x, half=3, **p: dsp.wpt_denoise(x, half=half, **p), _half)
register("stft_denoise", "gather", dsp.stft_denoise, _half)
register("gabor_denoise", "gather", lambda x, **p: dsp.stft_denoise(x, shape="gaussian", **p), _half)
register("stockwell_denoise", "gather", dsp.stockwell_denoise, _half)
register("tf_denoise", "gather", lambda x, transform="stransform", **p: (dsp.stockwell_denoise if transform == "stransform" else dsp.stft_denoise)(x, **p), _half)
register("sst_denoise", "trace", lambda x, base="stft", **p: (dsp.squeezed_wavelets if base == "cwt" else dsp.squeezed_denoise)(x, **p))
register("emd_denoise", "trace", dsp.emd_denoise)
register("omp_denoise", "trace", dsp.omp_denoise)
register("omp_spatial", "gather", dsp.omp_spatial, lambda p: p.get("half", 2))
register("dip", "gather", dsp.dips, lambda p: p.get("half", 2) + 1)
register("fk_filter", "gather", dsp.fk_filter)
register("fkk_filter", "volume", _cone)
register("denoise_3d", "volume", _denoised)


def apply(df: DataFrame, name: str, parameters: Mapping[str, Any] | None = None, gather: str = "gather", order: tuple[str, ...] = ("trace_index",), offset: str = "offset", cell: tuple[str, str] = ("ix", "iy")) -> DataFrame:
    """An operator of the registry over traces."""
    if name not in REGISTRY:
        raise KeyError(f"{name} is none of {', '.join(sorted(REGISTRY))}")
    sees, reach, kernel = REGISTRY[name]
    p = dict(parameters or {})
    if sees == "trace":
        return per_trace(df, lambda x: kernel(x, **p))
    if sees == "offset":
        return per_trace_with(df, offset, lambda x, v: kernel(x, v, **p))
    if sees == "volume":
        return kernel(df, gather, cell, **p)
    if sees == "cube":
        return per_cube(df, lambda x: kernel(x, **p), gather, *cell)
    return per_gather(df, lambda x: kernel(x, **p), gather, list(order), reach(p))


def pipeline(df: DataFrame, steps: list[tuple[str, Mapping[str, Any]]], **columns) -> DataFrame:
    """Operators one after the other; neighbouring trace operators stay in one stage."""
    for name, parameters in steps:
        df = apply(df, name, parameters, **columns)
    return df
