"""Filters of whole volumes, by transposition.

A 3-D Fourier transform is separable, so no task needs a volume. Traces are transformed along time where
they are; their spectra, cut to blocks of frequencies, are shuffled by volume and block; a task has all
cells of one block, transforms and weighs each frequency's slice along x and y, and sends the cells' parts
back, which a second shuffle puts together to traces. A block holds as many frequencies as SLICE_BYTES
allow, one at least: no task holds more than that, or one slice.

Traces of null cells, or of null or no samples, take no part and stay as they are. Of several traces on a cell the one of the largest
trace_index is the volume's; all get the cell's result, each cut to its own length. Cells without a trace
are zero. Volumes' extents, a row each, are broadcast if they are at most MOST_VOLUMES, else joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions import cones, dsp
from strataflow.functions.geometry import world_to_bin
from strataflow.operators import grids

SLICE_BYTES = 64 << 20
#: Of a tile's own cells, about.
TILE_BYTES = 16 << 20
MOST_VOLUMES = 10_000
#: Traces transformed at once.
CHUNK = 512


class Extent(NamedTuple):
    """A volume's cells and samples, and the sizes that its transforms have."""

    x0: int
    y0: int
    nx: int
    ny: int
    nt: int
    pad_x: int
    pad_y: int
    before: int
    full_x: int
    full_y: int
    full_t: int

    @classmethod
    def of(cls, x0: int, y0: int, nx: int, ny: int, nt: int, cone: cones.Cone, dt: float) -> Extent:
        (px, py), (top, bottom) = cone.traces(nx, ny), cone.samples(dt)
        return cls(x0, y0, nx, ny, nt, px, py, top, cone.length(nx + 2 * px), cone.length(ny + 2 * py), cone.length(nt + top + bottom))


def _extents(rows: DataFrame, by: str) -> DataFrame:
    at = {"x": F.col("_x"), "y": F.col("_y")}
    return rows.groupBy(by).agg(*[f(c).alias(f"_{n}{k}") for k, c in at.items() for n, f in (("low", F.min), ("high", F.max))], F.max(F.size("samples")).alias("_nt"))


def _copies(at: int, n: int, pad: int, taper: bool) -> list[tuple[int, float]]:
    """Where a trace at this place of n goes, with its factor: itself, and its copies beyond the edge."""
    factor = cones.falling(pad) if taper else np.ones(pad)
    out = [(at + pad, 1.0)]
    if at == 0:
        out += [(pad - 1 - i, factor[i]) for i in range(pad)]
    if at == n - 1:
        out += [(pad + n + i, factor[i]) for i in range(pad)]
    return out


def _padded(samples: np.ndarray, e: Extent, bottom: int, taper: bool) -> np.ndarray:
    """Traces (rows) of nt samples with their first and last sample before and after them."""
    n, factor = e.before + e.nt + bottom, cones.falling if taper else np.ones
    out = np.zeros((len(samples), n))
    out[:, e.before : e.before + e.nt] = samples
    out[:, : e.before] = samples[:, :1] * factor(e.before)[::-1]
    out[:, e.before + e.nt :] = samples[:, -1:] * factor(bottom)
    return out


def _batches(batches: Iterator[pa.RecordBatch], cone: cones.Cone, dt: float) -> Iterator[tuple[object, Extent, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """(volume, its extent, x, y, padded traces, rows) of traces of one volume, with the copies beyond the edges, CHUNK traces or a trace with its copies at once."""
    for b in batches:
        t = pa.Table.from_batches([b])
        for volume in pa.compute.unique(t["_volume"]).to_pylist():
            own = t.filter(pa.compute.is_null(t["_volume"]) if volume is None else pa.compute.equal(t["_volume"], volume))
            first = own.slice(0, 1).to_pylist()[0]
            e = Extent.of(first["_lowx"], first["_lowy"], first["_highx"] - first["_lowx"] + 1, first["_highy"] - first["_lowy"] + 1, first["_nt"], cone, dt)
            for start in range(0, own.num_rows, CHUNK):
                rows = own.slice(start, CHUNK)
                column = rows["samples"].combine_chunks()
                samples, sizes = np.zeros((rows.num_rows, e.nt)), np.diff(column.offsets.to_numpy())
                samples[np.arange(e.nt)[None, :] < sizes[:, None]] = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
                x, y = (rows[c].to_numpy() - low for c, low in (("_x", e.x0), ("_y", e.y0)))
                yield volume, e, x, y, _padded(samples, e, cone.samples(dt)[1], cone.edges != "repeat"), rows


def _laid(x: np.ndarray, y: np.ndarray, e: Extent, cone: cones.Cone) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y, factor) of the traces and their copies. With tapered edges the corners stay empty."""
    out = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        xs, ys = _copies(a, e.nx, e.pad_x, cone.edges == "taper"), _copies(b, e.ny, e.pad_y, cone.edges == "taper")
        out += [(k, i, j, u * v) for n, (i, u) in enumerate(xs) for m, (j, v) in enumerate(ys) if cone.edges == "repeat" or not (n and m)]
    row, i, j, factor = zip(*out, strict=True)
    return np.array(row), np.array(i), np.array(j), np.array(factor)


def _gain(x: np.ndarray, cone: cones.Cone, dt: float, floor: float) -> np.ndarray:
    return dsp.agc_scales(x, max(3, int(cone.agc_ms / 1000.0 / dt)) // 2, floor)


def filtered_cells(cells: DataFrame, cone: cones.Cone, dt: float, dx: float, dy: float) -> DataFrame:
    """(_volume, _x, _y, samples) of the same with one trace on a cell: the volumes through the cone."""
    shapes = _extents(cells, "_volume")
    one = shapes.agg(F.count("*"), *[F.max(c) for c in ("_nt",)], F.max(F.col("_highx") - F.col("_lowx")), F.max(F.col("_highy") - F.col("_lowy"))).first()
    if not one[0]:
        return cells
    few = one[0] <= MOST_VOLUMES
    largest = Extent.of(0, 0, one[2] + 1, one[3] + 1, one[1], cone, dt)
    each = max(1, min(largest.full_t // 2 + 1, SLICE_BYTES // (16 * largest.full_x * largest.full_y)))
    same = F.col("_volume").eqNullSafe(F.col("_of"))
    shapes = shapes.withColumnRenamed("_volume", "_of")
    rows = cells.join(F.broadcast(shapes) if few else shapes, same).drop("_of")
    if cone.agc_ms:
        floors = _floors(rows, cone, dt)
        rows = rows.join(F.broadcast(floors) if few else floors, same).drop("_of")
    kind = cells.schema["_volume"].dataType
    sent = T.StructType([T.StructField("_volume", kind), *[T.StructField(c, T.LongType()) for c in ("_block", "_x", "_y", "_nx", "_ny", "_nt")], T.StructField("_part", T.BinaryType())])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for volume, e, x, y, traces, table in _batches(batches, cone, dt):
            row, i, j, factor = _laid(x, y, e, cone)
            for start in range(0, len(row), CHUNK):
                at = slice(start, start + CHUNK)
                laid = traces[row[at]] * factor[at, None]
                if cone.agc_ms:
                    laid = laid * _gain(laid, cone, dt, table["_floor"][0].as_py())
                spectrum = np.fft.rfft(laid, e.full_t, axis=1)
                for block in range(-(-spectrum.shape[1] // each)):
                    part = np.ascontiguousarray(spectrum[:, block * each : (block + 1) * each])
                    n = len(part)
                    same = [np.full(n, v) for v in (block, e.nx, e.ny, e.nt)]
                    columns = [pa.array([volume] * n, table["_volume"].type), pa.array(same[0]), pa.array(i[at]), pa.array(j[at]), *map(pa.array, same[1:]), pa.array([r.tobytes() for r in part], pa.binary())]
                    yield pa.record_batch(columns, names=sent.fieldNames())

    def sliced(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        e = Extent.of(0, 0, first["_nx"], first["_ny"], first["_nt"], cone, dt)
        parts = np.frombuffer(b"".join(table["_part"].to_pylist()), np.complex128).reshape(table.num_rows, -1)
        x, y = table["_x"].to_numpy(), table["_y"].to_numpy()
        own = np.flatnonzero((x >= e.pad_x) & (x < e.pad_x + e.nx) & (y >= e.pad_y) & (y < e.pad_y + e.ny))
        f = np.fft.rfftfreq(e.full_t, dt)[first["_block"] * each :][: parts.shape[1]]
        kx, ky = np.fft.fftfreq(e.full_x, dx), np.fft.fftfreq(e.full_y, dy)
        out = np.empty((len(own), parts.shape[1]), np.complex128)
        for k in range(parts.shape[1]):
            plane = np.zeros((e.full_x, e.full_y), np.complex128)
            plane[x, y] = parts[:, k]
            plane = np.fft.ifft2(np.fft.fft2(plane) * cones.weights(f[k : k + 1], kx, ky, cone)[0])
            out[:, k] = plane[x[own], y[own]]
        kept = table.take(own)
        kept = kept.set_column(kept.schema.get_field_index("_x"), "_x", pa.array(x[own] - e.pad_x)).set_column(kept.schema.get_field_index("_y"), "_y", pa.array(y[own] - e.pad_y))
        return kept.set_column(kept.schema.get_field_index("_part"), "_part", pa.array([r.tobytes() for r in out], pa.binary()))

    slices = rows.mapInArrow(forward, sent).groupBy("_volume", "_block").applyInArrow(sliced, sent)
    sorted_ = slices.repartition("_volume", "_x", "_y").sortWithinPartitions("_volume", "_x", "_y", "_block")
    back = T.StructType([T.StructField("_volume", kind), T.StructField("_x", T.LongType()), T.StructField("_y", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def finish() -> None:
            first = held[0]
            e = Extent.of(0, 0, first["_nx"], first["_ny"], first["_nt"], cone, dt)
            trace = np.fft.irfft(np.frombuffer(b"".join(r["_part"] for r in held), np.complex128), e.full_t)
            out.append((first["_volume"], first["_x"], first["_y"], trace[e.before : e.before + e.nt]))
            held.clear()

        def flushed() -> pa.RecordBatch:
            volumes, x, y, traces = zip(*out, strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in traces])]).astype(np.int32)
            out.clear()
            return pa.record_batch([pa.array(volumes, volume_type), pa.array(x), pa.array(y), pa.ListArray.from_arrays(offsets, np.concatenate(traces))], names=back.fieldNames())

        for b in batches:
            volume_type = b.schema.field("_volume").type
            for r in b.to_pylist():
                if held and any(held[0][c] != r[c] for c in ("_volume", "_x", "_y")):
                    finish()
                held.append(r)
            if len(out) >= CHUNK:
                yield flushed()
        if held:
            finish()
        if out:
            yield flushed()

    found = sorted_.mapInArrow(backward, back).select("_volume", F.col("_x").alias("_i"), F.col("_y").alias("_j"), "samples")
    low = shapes.select("_of", "_lowx", "_lowy")
    found = found.join(F.broadcast(low) if few else low, same).select("_volume", (F.col("_i") + F.col("_lowx")).alias("_x"), (F.col("_j") + F.col("_lowy")).alias("_y"), "samples")
    if not cone.agc_ms:
        return found
    gains = _gains(rows, cone, dt, kind)
    out = found.join(gains, [F.col("_volume").eqNullSafe(F.col("_of")), F.col("_x") == F.col("_gx"), F.col("_y") == F.col("_gy")])
    return out.select("_volume", "_x", "_y", F.zip_with("samples", "_gain", lambda a, g: a / F.when(g > 1e-10, g).otherwise(1.0)).alias("samples"))


def _floors(rows: DataFrame, cone: cones.Cone, dt: float) -> DataFrame:
    """(_of, _floor): a thousandth of the root mean square of each padded volume."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for volume, e, x, y, traces, table in _batches(batches, cone, dt):
            row, _, _, factor = _laid(x, y, e, cone)
            energy = (traces**2).sum(axis=1)[row] @ factor**2
            size = (e.nx + 2 * e.pad_x) * (e.ny + 2 * e.pad_y) * traces.shape[1]
            yield pa.record_batch([pa.array([volume], table["_volume"].type), pa.array([energy]), pa.array([size])], names=["_of", "_energy", "_size"])

    kind = rows.schema["_volume"].dataType.simpleString()
    sums = rows.mapInArrow(run, f"_of {kind}, _energy double, _size long").groupBy("_of").agg(F.sum("_energy").alias("s"), F.max("_size").alias("n"))
    return sums.select("_of", F.greatest(0.001 * F.sqrt(F.col("s") / F.col("n")), F.lit(1e-10)).alias("_floor"))


def _gains(rows: DataFrame, cone: cones.Cone, dt: float, kind: T.DataType) -> DataFrame:
    """(_of, _gx, _gy, _gain): the gain of each cell's trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, e, _, _, traces, table in _batches(batches, cone, dt):
            g = _gain(traces, cone, dt, table["_floor"][0].as_py())[:, e.before : e.before + e.nt]
            yield pa.record_batch([table[c].combine_chunks() for c in ("_volume", "_x", "_y")] + [pa.array(list(g), pa.list_(pa.float64()))], names=["_of", "_gx", "_gy", "_gain"])

    return rows.mapInArrow(run, f"_of {kind.simpleString()}, _gx long, _gy long, _gain array<double>")


def _named(traces: DataFrame, volume: str, cell: tuple[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """traces with _volume, _x and _y, and (_volume, _x, _y, samples) with one trace on a cell."""
    named = traces.select("*", F.col(volume).alias("_volume"), F.col(cell[0]).cast("long").alias("_x"), F.col(cell[1]).cast("long").alias("_y"))
    placed = named.where("samples IS NOT NULL AND size(samples) > 0 AND _x IS NOT NULL AND _y IS NOT NULL")
    return named, placed.groupBy("_volume", "_x", "_y").agg(F.max_by("samples", key).alias("samples"))


def _given_back(traces: DataFrame, named: DataFrame, cells: DataFrame) -> DataFrame:
    """traces with their cells' samples, each cut to its own length."""
    done = cells.select(F.col("_volume").alias("_v"), F.col("_x").alias("_i"), F.col("_y").alias("_j"), F.col("samples").alias("_done"))
    joined = named.join(done, [F.col("_volume").eqNullSafe(F.col("_v")), F.col("_x") == F.col("_i"), F.col("_y") == F.col("_j")], "left")
    out = F.coalesce(F.when(F.size("samples") > 0, F.slice("_done", 1, F.size("samples"))), F.col("samples").cast("array<double>"))
    return joined.select(*[out.alias("samples") if c == "samples" else F.col(c) for c in traces.columns])


def fkk(traces: DataFrame, cone: cones.Cone, dt: float, dx: float, dy: float, volume: str = "gather", cell: tuple[str, str] = ("ix", "iy"), key: str = "trace_index") -> DataFrame:
    """traces(volume, cell, key, samples, more) with samples of the volumes after the cone."""
    named, cells = _named(traces, volume, cell, key)
    return _given_back(traces, named, filtered_cells(cells, cone, dt, dx, dy))


def tiled(traces: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], reach: tuple[int, int], volume: str = "gather", cell: tuple[str, str] = ("ix", "iy"), key: str = "trace_index", side: int | None = None) -> DataFrame:
    """traces with samples of their volumes through a kernel of a cube (x, y, time) that looks so many cells far in x and y, and at all of time.

    Volumes are cut to square tiles of about TILE_BYTES, or of side cells. A cell is sent to each tile that it reaches, so a
    tile has a halo of its neighbours' cells, cut where the volume ends; results don't depend on the tiles.
    """
    named, cells = _named(traces, volume, cell, key)
    shapes = _extents(cells, "_volume").withColumnRenamed("_volume", "_of")
    n_volumes, longest = shapes.agg(F.count("*"), F.max("_nt")).first()
    if not n_volumes:
        return _given_back(traces, named, cells)
    side = side or max(1, int((TILE_BYTES / (8 * longest)) ** 0.5))
    same = F.col("_volume").eqNullSafe(F.col("_of"))
    rows = cells.join(F.broadcast(shapes) if n_volumes <= MOST_VOLUMES else shapes, same).drop("_of")

    def tiles(axis: str, far: int) -> Column:
        at, last = F.col(f"_{axis}") - F.col(f"_low{axis}"), F.floor((F.col(f"_high{axis}") - F.col(f"_low{axis}")) / side)
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((at - far) / side)), F.least(last, F.floor((at + far) / side))))

    sent = rows.withColumn("_tx", tiles("x", reach[0])).withColumn("_ty", tiles("y", reach[1]))
    schema = T.StructType([cells.schema["_volume"], cells.schema["_x"], cells.schema["_y"], T.StructField("samples", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        ends = []
        for axis, far in zip("xy", reach, strict=True):
            low, n, t = first[f"_low{axis}"], first[f"_high{axis}"] - first[f"_low{axis}"] + 1, first[f"_t{axis}"]
            ends.append((low, max(0, t * side - far), min(n, (t + 1) * side + far), t * side, (t + 1) * side))
        (x0, xa, xb, xs, xe), (y0, ya, yb, ys, ye) = ends
        x, y = table["_x"].to_numpy() - x0, table["_y"].to_numpy() - y0
        column = table["samples"].combine_chunks()
        cube = np.zeros((xb - xa, yb - ya, first["_nt"]))
        flat = np.zeros((table.num_rows, first["_nt"]))
        flat[np.arange(first["_nt"])[None, :] < np.diff(column.offsets.to_numpy())[:, None]] = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
        cube[x - xa, y - ya] = flat
        done = kernel(cube)
        own = np.flatnonzero((x >= xs) & (x < xe) & (y >= ys) & (y < ye))
        values = done[x[own] - xa, y[own] - ya]
        lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * values.shape[1], values.ravel())
        kept = table.select(["_volume", "_x", "_y"]).take(own)
        return kept.append_column("samples", lists)

    return _given_back(traces, named, sent.groupBy("_volume", "_tx", "_ty").applyInArrow(run, schema))


def fkk_coordinates(traces: DataFrame, cone: cones.Cone, dt: float, x: Column, y: Column, size: tuple[float, float], **bins) -> DataFrame:
    """by_coordinates() through a cone."""
    return by_coordinates(traces, lambda df, volume: fkk(df, cone, dt, *size, volume=volume), x, y, size, **bins)


def denoise_coordinates(traces: DataFrame, x: Column, y: Column, size: tuple[float, float], hx: int = 1, hy: int = 1, parameters: dict | None = None, **bins) -> DataFrame:
    """by_coordinates() through 3-D denoising (dsp.denoise_cube), in tiles."""
    kernel = lambda cube: dsp.denoise_cube(cube, hx, hy, **(parameters or {}))
    return by_coordinates(traces, lambda df, volume: tiled(df, kernel, (hx, hy), volume), x, y, size, **bins)


def by_coordinates(
    traces: DataFrame, through: Callable[[DataFrame, str], DataFrame], x: Column, y: Column, size: tuple[float, float], origin: tuple[float, float] = (0.0, 0.0), degrees: float = 0.0, representative: str = "median", method: str = "noise_subtract", key: str = "trace_index"
) -> DataFrame:
    """traces(key, samples, more) filtered as a volume of coordinate bins; traces without coordinates stay. through takes (traces(ix, iy, trace_index, samples), the name of their volume's column).

    noise_subtract takes off each trace what the filter removed from its bin's representative, and
    residual_preserve adds the trace's rest to what it kept. multi_pass filters each trace itself: pass p's volume has
    the p-th trace of each bin by distance to its centre, or its last one where it has fewer, and all passes
    are volumes of one job. Design a filter by the first, apply it by the last.
    """
    ix, iy, far = world_to_bin(x, y, origin, size, degrees)
    binned = traces.select("*", ix.alias("ix"), iy.alias("iy"), far.alias("distance"))
    placed = binned.where("ix IS NOT NULL AND iy IS NOT NULL AND samples IS NOT NULL AND size(samples) > 0")
    if method in ("noise_subtract", "residual_preserve"):
        rep = grids.representatives(placed, representative).select("ix", "iy", "samples")
        kept = through(rep.select("ix", "iy", "samples", F.lit(0).alias("trace_index"), F.lit(0).alias("gather")), "gather")
        out = grids.reconstruct(binned, rep, kept, method)
        return out.select(*traces.columns)
    if method != "multi_pass":
        raise ValueError(f"{method} is none of noise_subtract, residual_preserve, multi_pass")
    numbered = grids.passes(placed).withColumn("fold", F.count("*").over(Window.partitionBy("ix", "iy")))
    most = numbered.agg(F.max("pass")).first()[0] or 0
    last = F.col("pass") == F.col("fold") - 1
    spread = numbered.withColumn("_pass", F.explode(F.when(last, F.sequence("pass", F.lit(most).cast("long"))).otherwise(F.array("pass"))))
    done = through(spread.select(F.col(key).alias("trace_index"), "ix", "iy", "samples", "pass", "_pass"), "_pass").where("pass = _pass").select(F.col("trace_index").alias("_key"), F.col("samples").alias("_done"))
    names = [F.coalesce("_done", F.col("samples").cast("array<double>")).alias("samples") if c == "samples" else F.col(c) for c in traces.columns]
    return traces.join(done, F.col(key) == F.col("_key"), "left").select(*names)
