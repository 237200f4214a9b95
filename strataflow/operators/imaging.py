"""Kirchhoff imaging in tiles: each trace goes once to each tile of the image that it reaches and is added into the tile's arrays.

Tiles are square blocks of image points whose arrays have at most CELLS cells, so a task's memory is bounded however
many traces a tile gets. Traces are dealt by ranges of (tile, hash of the trace): a tile that many traces reach spans
several tasks, whose partial images are summed by point and index. A task sees its traces sorted by tile and writes
a tile once the next one begins.

Traces with a null coordinate, offset or samples reach nothing; single null samples are left out.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.rays import Medium
from strataflow.operators.grids import normalised

#: Cells (points x output indices) of a tile, twelve bytes each.
CELLS = 8_000_000
#: Points x samples that a kernel works on at once, and rows of a batch it returns.
AT_ONCE, BATCH = 100_000, 100_000

#: Adds one trace (its coordinates, samples, and which of them are not null) to (image, fold) at the points x, y.
Kernel = Callable[[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]


@dataclasses.dataclass(frozen=True)
class Grid:
    """Image points at origin + (il, xl) * spacing."""

    origin: tuple[float, float]
    spacing: tuple[float, float]
    shape: tuple[int, int]


def survey_grid(traces: DataFrame, spacing: tuple[float, float]) -> Grid:
    """The image grid over the midpoints tx, ty of all traces: its extent is one aggregate, so it grows with the survey."""
    e = traces.agg(F.min("tx").alias("x"), F.min("ty").alias("y"), F.max("tx").alias("x_end"), F.max("ty").alias("y_end")).first()
    if e["x"] is None or e["y"] is None:
        return Grid((0.0, 0.0), spacing, (0, 0))
    shape = (math.ceil((e["x_end"] - e["x"]) / spacing[0]) + 1, math.ceil((e["y_end"] - e["y"]) / spacing[1]) + 1)
    return Grid((e["x"], e["y"]), spacing, shape)


def _tiles(at: str, axis: int, grid: Grid, aperture: float, side: int) -> Column:
    """Numbers of the tiles along an axis that have points within the aperture; empty if none has."""
    c = F.col(at).cast("double") - grid.origin[axis]
    first = F.greatest(F.ceil((c - aperture) / grid.spacing[axis]), F.lit(0))
    last = F.least(F.floor((c + aperture) / grid.spacing[axis]), F.lit(grid.shape[axis] - 1))
    return F.when(first <= last, F.sequence(F.floor(first / side), F.floor(last / side))).otherwise(F.array().cast("array<bigint>"))


def _summed(traces: DataFrame, at: tuple[str, str], columns: list[str], grid: Grid, aperture: float, n_out: int, kernel: Kernel) -> DataFrame:
    """(il, xl, t_index, _image, fold) of what kernel adds at the points within the aperture of each trace's place."""
    side = max(1, math.isqrt(CELLS // n_out))
    known = traces.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("samples").cast("array<double>").alias("samples")).na.drop()
    sent = known.withColumn("_tx", F.explode(_tiles(at[0], 0, grid, aperture, side))).withColumn("_ty", F.explode(_tiles(at[1], 1, grid, aperture, side)))
    tasks = int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartitionByRange(tasks, "_tx", "_ty", F.xxhash64(*columns, "samples")).sortWithinPartitions("_tx", "_ty")

    def points(tile: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.arange(k * side, min((k + 1) * side, n)) for k, n in zip(tile, grid.shape, strict=True))

    def batches(tile: tuple[int, int], image: np.ndarray, fold: np.ndarray) -> Iterator[pa.RecordBatch]:
        xl = points(tile)[1]
        reached = np.flatnonzero(fold)
        for k in range(0, len(reached), BATCH):
            flat = reached[k : k + BATCH]
            point, t = np.divmod(flat, n_out)
            il, cross = np.divmod(point, len(xl))
            columns = [il + tile[0] * side, cross + tile[1] * side, t, image.ravel()[flat], fold.ravel()[flat].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["il", "xl", "t_index", "_image", "fold"])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = image = fold = x = y = None
        for batch in given:
            samples, tiles = batch["samples"], zip(batch["_tx"].to_pylist(), batch["_ty"].to_pylist(), strict=True)
            places = zip(*[batch[c].to_pylist() for c in columns], strict=True)
            for row, (tile, place) in enumerate(zip(tiles, places, strict=True)):
                if tile != held:
                    if held is not None:
                        yield from batches(held, image, fold)
                    held, (il, xl) = tile, points(tile)
                    image, fold = np.zeros((len(il) * len(xl), n_out)), np.zeros((len(il) * len(xl), n_out), np.int32)
                    x, y = np.repeat(il * grid.spacing[0] + grid.origin[0], len(xl)), np.tile(xl * grid.spacing[1] + grid.origin[1], len(il))
                own = samples[row].values
                kernel(place, own.fill_null(0.0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), x, y, image, fold)
        if held is not None:
            yield from batches(held, image, fold)

    parts = dealt.mapInArrow(run, "il long, xl long, t_index long, _image double, fold long")
    return parts.groupBy("il", "xl", "t_index").agg(F.sum("_image").alias("_image"), F.sum("fold").alias("fold"))


def _curve(velocity: float | Sequence[tuple[float, float]], t: np.ndarray) -> np.ndarray:
    """The velocity at times t: constant, or between knots (t, v) of an RMS function, level beyond them."""
    if isinstance(velocity, (int, float)):
        return np.full(len(t), float(velocity))
    times, values = zip(*sorted(velocity), strict=True)
    return np.interp(t, times, values)


def migrate(
    traces: DataFrame,
    grid: Grid,
    velocity: float | Sequence[tuple[float, float]],
    dt_s: float,
    n_out: int,
    aperture: float,
    max_angle: float = 60.0,
    min_fold: int | None = 1,
    mode: str = "spread",
) -> DataFrame:
    """(il, xl, t_index, image, fold) of traces(tx, ty, offset, samples) with midpoints tx, ty, imaged in time.

    With h the distance from midpoint to image point, a sample at t goes to t_out = sqrt(t^2 + 4 (h^2 + (offset / 2)^2) / v^2)
    (spread), or back along that curve, sqrt(t^2 - ...), which focuses diffractions (focus). v is constant or an RMS
    function of (t, v) knots, taken at the input's time. Samples go to the floor of their output index, weighed z / r^3
    with z = v t_out / 2. The image is normalised by the fold (min_fold None: it is the sum); cells that nothing reaches are left out. The aperture
    is also bound by the angle at the output's depth.
    """
    if mode not in ("spread", "focus"):
        raise ValueError(f"mode {mode!r} is neither spread nor focus")
    steep, sign = math.tan(math.radians(max_angle)), 1 if mode == "spread" else -1

    def kernel(place, a, valid, x, y, image, fold):
        tx, ty, offset = place
        t = np.arange(len(a)) * dt_s
        v = _curve(velocity, t)
        h = np.sqrt((x - tx) ** 2 + (y - ty) ** 2)
        near = np.flatnonzero(h < aperture)
        step = max(1, AT_ONCE // max(len(a), n_out))
        for k in range(0, len(near), step):
            p = near[k : k + step]
            hp = h[p, None]
            shift = 4 * (hp * hp + offset * offset / 4) / (v * v)
            t_out = np.sqrt(np.maximum(t * t + sign * shift, 0.0))
            z = v * t_out / 2
            row, i = np.nonzero((t_out / dt_s < n_out - 0.001) & (t_out > 0) & (hp < z * steep) & valid)
            z, d = z[row, i], h[p][row]
            r2 = z * z + d * d
            at = row * n_out + np.floor(t_out[row, i] / dt_s + 1e-6).astype(np.int64)
            image[p] += np.bincount(at, a[i] * z / (np.sqrt(r2) * r2 + 1e-10), len(p) * n_out).reshape(len(p), n_out)
            fold[p] += np.bincount(at, minlength=len(p) * n_out).reshape(len(p), n_out).astype(np.int32)

    sums = _summed(traces, ("tx", "ty"), ["tx", "ty", "offset"], grid, aperture, n_out, kernel)
    image = F.col("_image") if min_fold is None else normalised(F.col("_image"), F.col("fold"), min_fold)
    return sums.select("il", "xl", "t_index", image.alias("image"), "fold")


@dataclasses.dataclass(frozen=True)
class Earth:
    """What rays go through: v0 + gradient * z (straight rays where the gradient is 0), or layers of (z, v) knots, or a
    medium of vertical symmetry with moveout velocity and eta, in which a one-way time goes with the anelliptic moveout.

    Layers' times are from a table of TABLE distances, made by root finding and read between neighbours by a line in the squared time; distances that no ray
    reaches are outside.
    """

    v0: float = 2500.0
    gradient: float = 0.0
    layers: tuple[tuple[float, float], ...] = ()
    vti: tuple[float, float] | None = None

    def velocity(self, z: np.ndarray) -> np.ndarray:
        return Medium(list(self.layers)).velocity(z) if self.layers else self.v0 + self.gradient * z

    def times(self, z: np.ndarray, farthest: float) -> Callable[[np.ndarray], np.ndarray]:
        """One-way times to depths z by squared distances (a column), of at most farthest."""
        if self.layers:
            distances = np.linspace(0, farthest, TABLE)
            table = Medium(list(self.layers)).rays(distances[:, None], z[None, :]).time ** 2
            step, at = farthest / (TABLE - 1), np.arange(len(z))

            def looked_up(h2: np.ndarray) -> np.ndarray:
                k = np.sqrt(h2) / step
                i = np.minimum(k.astype(np.int64), TABLE - 2)
                h0, h1 = distances[i] ** 2, distances[i + 1] ** 2
                return np.sqrt(table[i, at] + (table[i + 1, at] - table[i, at]) * ((h2 - h0) / (h1 - h0)))

            return looked_up
        if self.vti:
            vn, eta = self.vti
            t2, n2 = (z / self.v0) ** 2, vn * vn
            bend = lambda h2: 2 * eta * h2 * h2 / np.maximum(n2 * (t2 * n2 + (1 + 2 * eta) * h2), 1e-30)
            return lambda h2: np.sqrt(np.maximum(t2 + h2 / n2 - bend(h2), 0))
        if abs(self.gradient) < 1e-6:
            return lambda h2: np.sqrt(h2 + z * z) / self.v0
        return lambda h2: np.arccosh(1 + self.gradient**2 * (h2 + z * z) / (2 * self.v0 * (self.v0 + self.gradient * z))) / abs(self.gradient)


#: Distances of a table of times.
TABLE = 4096
WEIGHTS = ("standard", "none", "spreading", "obliquity", "full", "true", "curved")
# The least radius, velocity and cosine that weights divide by.
LEAST_RADIUS, LEAST_VELOCITY, LEAST_COSINE = 1.0, 100.0, 0.1


@dataclasses.dataclass(frozen=True)
class AntiAlias:
    """Weights of samples by the frequency beyond which their dip is aliased at spacing dx, against f_max: triangle or sinc. The dip is that of the traveltime's slope, the mean of both rays' sines."""

    dx: float
    f_max: float
    method: str = "triangle"

    def weight(self, sine: np.ndarray, v: np.ndarray, nyquist: float) -> np.ndarray:
        with np.errstate(divide="ignore"):
            r = np.minimum(v / (2 * self.dx * np.abs(sine)), nyquist) / self.f_max
        r = np.clip(r, 0, 1)
        return r if self.method == "triangle" else np.sin(np.pi / 2 * r) ** 2


def ray_weights(kind: str, z: np.ndarray, hs: np.ndarray, hr: np.ndarray, earth: Earth) -> np.ndarray:
    """Amplitude weights by distances of source and receiver from above the point: both rays' cosines over their lengths (standard), or by the terms' names; true has the 2.5-D Jacobian, curved spreads with the velocities' ratio and has the surface's angles of circular rays."""
    rs, rr = np.hypot(hs, z), np.hypot(hr, z)
    if kind == "standard":
        return (z / (rs + 1e-6)) * (z / (rr + 1e-6)) / (rs * rr + 1e-6)
    v = np.maximum(earth.velocity(z), LEAST_VELOCITY)
    ls, lr = np.maximum(rs, LEAST_RADIUS), np.maximum(rr, LEAST_RADIUS)
    if kind in ("none", "spreading", "obliquity", "full"):
        return {"none": np.ones(np.broadcast_shapes(rs.shape, rr.shape)), "spreading": 1 / (ls * lr * v), "obliquity": (z / ls + z / lr) / 2, "full": (z / ls + z / lr) / 2 / (ls * lr * v)}[kind]
    if kind == "true":
        a, b = np.arctan2(hs, z), np.arctan2(hr, z)
        return np.cos(a) * np.cos(b) / (ls * lr * v) / np.maximum(np.cos((a + b) / 2), LEAST_COSINE)

    def cosine(h: np.ndarray) -> np.ndarray:
        """Of a circular ray's angle at the surface, by its centre above the surface."""
        if abs(earth.gradient) < 1e-6:
            return z / np.maximum(np.hypot(h, z), 1e-10)
        up = earth.v0 / earth.gradient
        centre = (h * h + z * z + 2 * z * up) / (2 * np.maximum(h, 1e-10))
        return np.abs(centre) / np.hypot(centre, up)

    ratio = np.sqrt(v / earth.v0) if abs(earth.gradient) > 1e-6 else 1.0
    return ratio * cosine(hs) * cosine(hr) / (ls * lr)


def migrate_depth(
    traces: DataFrame, grid: Grid, depths: Sequence[float], v0: float, dt_s: float, aperture: float, max_angle: float = 60.0, gradient: float = 0.0, earth: Earth | None = None, weight: str = "standard", antialias: AntiAlias | None = None
) -> DataFrame:
    """(il, xl, z_index, image, fold) of traces(sx, sy, rx, ry, samples) with sources and receivers, imaged at the depths.

    Each depth takes the sample at its two-way traveltime, between neighbours by line, in v0 + gradient * z or what
    earth is, weighed by ray_weights() and antialias. Both rays lie strictly within the aperture and the angle. Times beyond a
    trace take its end. The image is the sum, the fold how many traces took part.
    """
    if weight not in WEIGHTS:
        raise ValueError(f"{weight} is none of {', '.join(WEIGHTS)}")
    z, medium = np.asarray(depths, float), earth or Earth(v0, gradient)
    steepest = math.radians(max_angle)
    time = medium.times(z, aperture)
    velocities = medium.velocity(z)

    def kernel(place, a, valid, x, y, image, fold):
        if not len(a):
            return
        sx, sy, rx, ry = place
        source, receiver = (x - sx) ** 2 + (y - sy) ** 2, (x - rx) ** 2 + (y - ry) ** 2
        near = np.flatnonzero((np.sqrt(source) < aperture) & (np.sqrt(receiver) < aperture))
        step = max(1, AT_ONCE // len(z))
        for k in range(0, len(near), step):
            p = near[k : k + step]
            hs2, hr2 = source[p, None], receiver[p, None]
            hs, hr = np.sqrt(hs2), np.sqrt(hr2)
            two_way = time(hs2) + time(hr2)
            inside = (np.arctan2(hs, z + 1e-6) < steepest) & (np.arctan2(hr, z + 1e-6) < steepest) & ~np.isnan(two_way)
            at = np.clip(np.nan_to_num(two_way) / dt_s, 0, max(len(a) - 1.001, 0))
            i = at.astype(np.int64)
            low, high = a[i], a[np.minimum(i + 1, len(a) - 1)]
            w = ray_weights(weight, z, hs, hr, medium)
            if antialias:
                w = w * antialias.weight((hs / np.hypot(hs, z) + hr / np.hypot(hr, z)) / 2, velocities, 0.5 / dt_s)
            image[p] += np.where(inside, (low + (at - i) * (high - low)) * w, 0.0)
            fold[p] += inside

    sums = _summed(traces, ("sx", "sy"), ["sx", "sy", "rx", "ry"], grid, aperture, len(z), kernel)
    return sums.select("il", "xl", F.col("t_index").alias("z_index"), F.col("_image").alias("image"), "fold")


def scatter_add(rows: DataFrame) -> DataFrame:
    """(il, xl, z, image, fold) of rows(il, xl, z, amplitude, weight, inside, valid)."""
    kept = rows.where("valid AND inside")
    return kept.groupBy("il", "xl", "z").agg(F.sum(F.col("amplitude") * F.col("weight")).alias("image"), F.count("*").alias("fold"))
