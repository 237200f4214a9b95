"""Whole volumes by transposition against plain NumPy over the whole cube."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import cones, dsp
from strataflow.functions.cones import Cone
from strataflow.operators import filters, volumes

DT, DX, DY = 0.004, 25.0, 20.0


def plain(cube, cone):
    """cube (x, y, time) through the cone, with numpy's 3-D transform and loops for the edges."""
    nx, ny, nt = cube.shape
    top, bottom = (int(ms / 1000 / DT + 1e-9) for ms in cone.pad_ms)
    ramp = lambda n, i: 0.5 * (1 + np.cos(np.pi * i / n))
    px, py = cone.traces(nx, ny)
    wide = np.zeros((nx + 2 * px, ny + 2 * py, top + nt + bottom))
    wide[px : px + nx, py : py + ny, top : top + nt] = cube
    for i in range(top):
        wide[:, :, top - 1 - i] = wide[:, :, top] * ramp(top, i)
    for i in range(bottom):
        wide[:, :, top + nt + i] = wide[:, :, top + nt - 1] * ramp(bottom, i)
    for i in range(px):
        wide[px - 1 - i, py : py + ny], wide[px + nx + i, py : py + ny] = wide[px, py : py + ny] * ramp(px, i), wide[px + nx - 1, py : py + ny] * ramp(px, i)
    for i in range(py):
        wide[px : px + nx, py - 1 - i], wide[px : px + nx, py + ny + i] = wide[px : px + nx, py] * ramp(py, i), wide[px : px + nx, py + ny - 1] * ramp(py, i)
    gain = np.ones(wide.shape)
    if cone.agc_ms:
        half = max(3, int(cone.agc_ms / 1000 / DT)) // 2
        floor = 0.001 * np.sqrt((wide**2).mean())
        for k in range(wide.shape[2]):
            at = [j if 0 <= j < wide.shape[2] else -j - 1 if j < 0 else 2 * wide.shape[2] - 1 - j for j in range(k - half, k + half + 1)]
            gain[:, :, k] = 1 / (np.sqrt((wide[:, :, at] ** 2).mean(axis=2)) + floor)
        wide = wide * gain
    full = [1 << (max(n, int(n * cone.factor)) - 1).bit_length() for n in wide.shape]
    spectrum = np.fft.rfftn(wide, full, axes=(0, 1, 2))
    for i, kx in enumerate(np.fft.fftfreq(full[0], DX)):
        for j, ky in enumerate(np.fft.fftfreq(full[1], DY)):
            for k, f in enumerate(np.fft.rfftfreq(full[2], DT)):
                v, inside = f / max(np.hypot(kx, ky), 1e-10), 1.0
                for edge, sign in ((cone.v_min, 1), (cone.v_max, -1)):
                    t = np.clip((v - edge * (1 - cone.taper)) / (2 * cone.taper * edge), 0, 1)
                    inside *= 0.5 * (1 - sign * np.cos(np.pi * t))
                a = np.degrees(np.arctan2(ky, kx)) % 360
                low, high = cone.azimuth_min, cone.azimuth_max
                inside *= low <= a <= high if low <= high else a >= low or a <= high
                w = 1 - inside if cone.mode == "reject" else inside
                if f == 0 or (i == 0 and j == 0) or f < (cone.f_min or 0) or f > (cone.f_max or np.inf):
                    w = 1.0
                spectrum[i, j, k] *= w
    out = np.fft.irfftn(spectrum, full, axes=(0, 1, 2))[: wide.shape[0], : wide.shape[1], : wide.shape[2]]
    return (out / np.where(gain > 1e-10, gain, 1))[px : px + nx, py : py + ny, top : top + nt]


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(3).normal(size=(6, 5, 24))


def frame(spark, cube, volume="a", start=(0, 0)):
    rows = [(volume, i + start[0], j + start[1], i * 100 + j, cube[i, j].tolist()) for i in range(cube.shape[0]) for j in range(cube.shape[1])]
    return spark.createDataFrame(rows, "gather string, ix long, iy long, trace_index long, samples array<double>")


def cells(df):
    return {(r.gather, r.ix, r.iy): np.array(r.samples) for r in df.collect()}


CONES = {
    "plain": Cone(300.0, 2000.0, edges="none"),
    "tapered edges": Cone(300.0, 2000.0, taper=0.3, pad_ms=(12.0, 20.0), mode="pass", f_min=10.0, f_max=80.0),
    "azimuths and gain": Cone(300.0, 2000.0, taper=0.2, azimuth_min=300.0, azimuth_max=200.0, agc_ms=30.0, pad_traces=(2, 3), factor=2.0),
}


@pytest.mark.parametrize("name", CONES)
@pytest.mark.parametrize("slice_bytes", [1, 1 << 25])
def test_transposition_equals_the_whole_cube(spark, monkeypatch, cube, name, slice_bytes):
    """Whatever a block holds: with one byte a task has a single frequency slice."""
    monkeypatch.setattr(volumes, "SLICE_BYTES", slice_bytes)
    both = frame(spark, cube, "a", (4, 7)).unionByName(frame(spark, cube[:3, :4, :20] * 5, None))
    got = cells(volumes.fkk(both, CONES[name], DT, DX, DY))
    for volume, c, (x, y) in (("a", cube, (4, 7)), (None, cube[:3, :4, :20] * 5, (0, 0))):
        want = plain(c, CONES[name])
        assert all(np.allclose(got[volume, i + x, j + y], want[i, j], atol=1e-9) for i in range(c.shape[0]) for j in range(c.shape[1]))


def test_registered_filter_equals_its_kernel(spark, cube):
    p = {"dt": DT, "dx": DX, "dy": DY, "v_min": 300.0, "v_max": 2000.0, "taper": 0.2, "pad": (2, 1, 4)}
    got, want = cells(filters.apply(frame(spark, cube), "fkk_filter", p)), dsp.fkk_filter(cube, **p)
    assert all(np.allclose(got["a", i, j], want[i, j]) for i in range(6) for j in range(5))


def test_missing_cells_ties_nulls_and_lengths(spark, cube):
    part = cube.copy()
    part[1, 1] = 0
    part[2, 2, 10:] = 0
    rows = [("a", i, j, i * 100 + j, part[i, j].tolist()) for i in range(6) for j in range(5) if (i, j) not in ((1, 1), (2, 2))]
    rows += [("a", 2, 2, 999, part[2, 2, :10].tolist()), ("a", 2, 2, 150, [9.0] * 24), ("a", 0, 0, 5000, None), ("a", None, 0, 5001, [1.0, 2.0]), ("a", 3, 3, 5002, [])]
    df = volumes.fkk(spark.createDataFrame(rows, "gather string, ix long, iy long, trace_index long, samples array<double>"), CONES["plain"], DT, DX, DY)
    got, want = {r.trace_index: r.samples for r in df.collect()}, plain(part, CONES["plain"])
    assert len(got) == len(rows)
    assert np.allclose(got[999], want[2, 2, :10])
    assert np.allclose(got[150], want[2, 2])
    assert np.allclose(got[504], want[5, 4])
    assert got[5000] is None and got[5001] == [1.0, 2.0] and got[5002] == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "gather string, ix long, iy long, trace_index long, samples array<double>")
    assert volumes.fkk(empty, CONES["plain"], DT, DX, DY).collect() == []


def test_passes_filter_each_trace(spark, cube):
    """Bins of two traces, of which one bin lacks the second: its last one stands in."""
    second = cube[::-1].copy()
    rows = [(i * 10 + j + 1000 * n, i * DX + 12.5 + n, j * DY + 10.0, c[i, j].tolist()) for n, c in enumerate((cube, second)) for i in range(6) for j in range(5) if (n, i, j) != (1, 2, 2)]
    df = spark.createDataFrame([*rows, (9999, None, 1.0, [1.0, 2.0])], "trace_index long, x double, y double, samples array<double>")
    second[2, 2] = cube[2, 2]
    want = [plain(c, CONES["plain"]) for c in (cube, second)]
    got = {r.trace_index: r.samples for r in volumes.fkk_coordinates(df, CONES["plain"], DT, F.col("x"), F.col("y"), (DX, DY), method="multi_pass").collect()}
    assert len(got) == len(rows) + 1 and got[9999] == [1.0, 2.0]
    assert all(np.allclose(got[t], want[t // 1000][t % 1000 // 10, t % 10]) for t, *_ in rows)
    taken = {r.trace_index: r.samples for r in volumes.fkk_coordinates(df, CONES["plain"], DT, F.col("x"), F.col("y"), (DX, DY), representative="nearest").collect()}
    assert all(np.allclose(taken[t], (cube if t < 1000 else second)[t % 1000 // 10, t % 10] - (cube - want[0])[t % 1000 // 10, t % 10]) for t, *_ in rows)


def test_cones_are_checked_and_read_back():
    c = cones.preset("Ground Roll Rejection", agc_ms=200.0)
    assert Cone.from_json(c.to_json().replace("{", '{"unknown": 1, ', 1)) == c
    for wrong in ({"v_min": 0.0}, {"v_max": 100.0}, {"mode": "x"}, {"taper": 0.6}, {"azimuth_min": -1.0}, {"f_min": 5.0, "f_max": 5.0}, {"agc_ms": 0.0}, {"edges": "x"}, {"factor": 0.5}, {"pad_traces": (-1, 0)}):
        with pytest.raises(ValueError):
            Cone(**wrong)
    with pytest.raises(KeyError):
        cones.preset("unknown")
    assert [cones.automatic(n) for n in (4, 20, 40, 200, 1000)] == [5, 10, 8, 20, 30]


@pytest.mark.parametrize("side", [1, 2, 3, 100])
def test_denoising_in_tiles_of_any_size_equals_the_whole(spark, cube, side):
    spiky = cube.copy()
    spiky[2, 3] += 20
    spiky[4, 1] = 0
    rows = frame(spark, spiky, "a", (3, 2)).where("NOT (ix = 7 AND iy = 3)").unionByName(frame(spark, spiky[:2, :2], "b"))
    got = cells(filters.apply(rows, "denoise_3d", {"hx": 1, "hy": 2, "level": 2, "side": side}))
    assert len(got) == 33
    want = dsp.denoise_cube(spiky, 1, 2, level=2)
    assert all(np.allclose(v, want[i - 3, j - 2]) for (g, i, j), v in got.items() if g == "a")
    small = dsp.denoise_cube(spiky[:2, :2], 1, 2, level=2)
    assert all(np.allclose(v, small[i, j]) for (g, i, j), v in got.items() if g == "b")


def test_denoising_by_coordinates(spark, cube):
    """Of one trace a bin, both ways are the volume's denoising."""
    rows = spark.createDataFrame([(i * 10 + j, i * DX + 12.5, j * DY + 10.0, cube[i, j].tolist()) for i in range(6) for j in range(5)], "trace_index long, x double, y double, samples array<double>")
    want = dsp.denoise_cube(cube, 1, 1, level=2)
    for method in ("noise_subtract", "multi_pass"):
        out = volumes.denoise_coordinates(rows, F.col("x"), F.col("y"), (DX, DY), parameters={"level": 2}, method=method)
        assert all(np.allclose(r.samples, want[r.trace_index // 10, r.trace_index % 10]) for r in out.collect())
