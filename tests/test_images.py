"""Rays, weights and media of depth images, and images of bins that are stopped and resumed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions.rays import Medium
from strataflow.operators import imaging
from strataflow.operators.binning import Bin
from strataflow.operators.image_volumes import ImageVolumes
from strataflow.operators.imaging import AntiAlias, Earth, Grid


def circle(h, z, v0, k):
    """(parameter, turning depth, time) of a circular ray."""
    centre, up = (h * h + z * z + 2 * z * v0 / k) / (2 * h), v0 / k
    p = 1 / (k * np.hypot(centre, up))
    return p, (1 / p - v0) / k, np.arccosh(1 + k * k * (h * h + z * z) / (2 * v0 * (v0 + k * z))) / k


def test_rays_of_a_gradient_are_circles():
    h, z = np.meshgrid([1.0, 50.0, 800.0, 5000.0, 20000.0], [10.0, 400.0, 3000.0])
    r = Medium([(0.0, 1800.0), (1e9, 1800.0 + 0.6e9)]).rays(h, z)
    p, turning, time = circle(h, z, 1800.0, 0.6)
    assert np.allclose(r.parameter, p, rtol=1e-8) and np.allclose(r.turning, turning, rtol=1e-5, atol=1e-3) and np.allclose(r.time, time, rtol=1e-9)
    assert np.allclose(r.angle, np.arcsin(p * 1800.0))
    assert (r.turning > z * (1 - 1e-9)).all()  # a ray gets to its point before it turns, or after, but not below


def test_rays_of_layers_take_least_time_of_their_neighbours():
    """Fermat: between straight pieces through three level layers, the ray's time is the least."""
    layers = Medium([(0.0, 1500.0), (300.0, 1500.0), (300.0001, 2200.0), (700.0, 2200.0), (700.0001, 3000.0)])
    r = layers.rays(np.array([900.0]), np.array([1000.0]))
    grid = np.linspace(0, 900, 601)
    a, b = np.meshgrid(grid, grid)
    times = np.hypot(a, 300) / 1500 + np.hypot(b - a, 400) / 2200 + np.hypot(900 - b, 300) / 3000
    assert times.min() - 1e-4 < r.time[0] <= times.min() + 1e-6


def test_points_that_no_ray_reaches_and_wrong_knots():
    level = Medium([(0.0, 2000.0)])
    r = level.rays(np.array([0.0, 3.0]), np.array([4.0, 4.0]))
    assert np.allclose(r.time, [4 / 2000, 5 / 2000]) and np.isinf(r.turning).all()
    capped = Medium([(0.0, 2000.0), (100.0, 2100.0)]).rays(np.array([1e6]), np.array([50.0]))
    assert np.isnan(capped.parameter).all() and np.isnan(capped.time).all()
    for wrong in ([(1.0, 2000.0)], [(0.0, 2000.0), (0.0, 2100.0)], [(0.0, 2000.0), (10.0, 1900.0)], [(0.0, 0.0)]):
        with pytest.raises(ValueError):
            Medium(wrong)


@pytest.fixture(scope="module")
def shots(spark):
    rng = np.random.default_rng(5)
    rows = [(float(i % 6 * 20 - 15), float(i // 6 * 20), float(i % 6 * 20 + 15), float(i // 6 * 20), rng.normal(size=80).tolist()) for i in range(30)]
    return spark.createDataFrame(rows, "sx double, sy double, rx double, ry double, samples array<double>")


GRID, DEPTHS = Grid((0.0, 0.0), (40.0, 40.0), (3, 3)), [30.0, 90.0, 200.0]


def image(shots, **changes):
    rows = imaging.migrate_depth(shots, GRID, DEPTHS, 2000.0, 0.01, 120.0, 70.0, **changes).collect()
    return {(r.il, r.xl, r.z_index): (r.image, r.fold) for r in rows}


def plain(shots, time, weight):
    """The same by loops; time and weight of (h, z) and (z, hs, hr)."""
    out = {}
    for r in shots.collect():
        for il in range(3):
            for xl in range(3):
                for k, z in enumerate(DEPTHS):
                    hs, hr = (np.hypot(il * 40.0 - x, xl * 40.0 - y) for x, y in ((r.sx, r.sy), (r.rx, r.ry)))
                    if hs < 120 and hr < 120 and max(np.arctan2(hs, z + 1e-6), np.arctan2(hr, z + 1e-6)) < np.radians(70):
                        at = min((time(hs, z) + time(hr, z)) / 0.01, 78.999)
                        i = int(at)
                        a = r.samples[i] + (at - i) * (r.samples[i + 1] - r.samples[i])
                        s, n = out.get((il, xl, k), (0.0, 0))
                        out[il, xl, k] = (s + a * weight(z, hs, hr), n + 1)
    return out


def same(got, want, tolerance=1e-9):
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] for k in want)
    biggest = max(abs(v[0]) for v in want.values())
    assert all(abs(got[k][0] - want[k][0]) <= tolerance * biggest for k in want)


def straight(h, z):
    return np.hypot(h, z) / 2000


def anelliptic(h, z, vn=2100.0, eta=0.12):
    t2 = (z / 2000) ** 2
    return np.sqrt(t2 + h * h / vn**2 - 2 * eta * h**4 / (vn**2 * (t2 * vn**2 + (1 + 2 * eta) * h * h)))


def standard(z, hs, hr):
    rs, rr = np.hypot(hs, z), np.hypot(hr, z)
    return z / (rs + 1e-6) * z / (rr + 1e-6) / (rs * rr + 1e-6)


def weights(kind, v0=2000.0, k=0.0):
    def weight(z, hs, hr):
        rs, rr, v = np.hypot(hs, z), np.hypot(hr, z), v0 + k * z
        a, b = np.arctan2(hs, z), np.arctan2(hr, z)
        sines = [circle(max(h, 1e-9), z, v0, k)[0] * v0 if k else h / np.hypot(h, z) for h in (hs, hr)]
        cosines = [np.sqrt(1 - s * s) for s in sines]
        return {"none": 1.0, "spreading": 1 / (rs * rr * v), "obliquity": (z / rs + z / rr) / 2, "full": (z / rs + z / rr) / 2 / (rs * rr * v), "true": np.cos(a) * np.cos(b) / (rs * rr * v) / max(np.cos((a + b) / 2), 0.1), "curved": np.sqrt(v / v0) * cosines[0] * cosines[1] / (rs * rr)}[kind]

    return weight


def test_media(shots):
    same(image(shots), plain(shots, straight, standard))
    same(image(shots, earth=Earth(2000.0, vti=(2100.0, 0.12))), plain(shots, anelliptic, standard))
    same(image(shots, gradient=0.7), plain(shots, lambda h, z: circle(max(h, 1e-9), z, 2000.0, 0.7)[2], standard))


def test_a_table_of_layers_gives_what_the_formula_gives(shots):
    """Within a part of a million of the largest value."""
    layered = Earth(layers=((0.0, 2000.0), (1e6, 2000.0 + 0.7e6)))
    want = image(shots, gradient=0.7)
    same(image(shots, earth=layered), want, 1e-6)


@pytest.mark.parametrize("kind", imaging.WEIGHTS[1:])
def test_weights(shots, kind):
    k = 0.7 if kind == "curved" else 0.0
    time = (lambda h, z: circle(max(h, 1e-9), z, 2000.0, k)[2]) if k else straight
    same(image(shots, weight=kind, gradient=k), plain(shots, time, weights(kind, k=k)))


def test_antialias(shots):
    def weight(method):
        def f(z, hs, hr):
            sine = (hs / np.hypot(hs, z) + hr / np.hypot(hr, z)) / 2
            r = min(1.0, min(2000 / (2 * 30.0 * sine) if sine else np.inf, 50.0) / 45.0)
            return standard(z, hs, hr) * (r if method == "triangle" else np.sin(np.pi / 2 * r) ** 2)

        return f

    for method in ("triangle", "sinc"):
        same(image(shots, antialias=AntiAlias(30.0, 45.0, method)), plain(shots, straight, weight(method)))
    with pytest.raises(ValueError):
        image(shots, weight="unknown")


BINS = [Bin("near", 0.0, 300.0), Bin("wide", 200.0, 800.0, 90.0, 270.0)]


@pytest.fixture(scope="module")
def survey(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(i % 5 * 20), float(i // 5 * 20), float(i * 37 % 900), float(i * 50 % 360), rng.normal(size=30).tolist()) for i in range(40)]
    return spark.createDataFrame([*rows, (None, 0.0, 0.0, 100.0, 10.0, [1.0] * 30), (41, 0.0, 0.0, None, 10.0, [1.0] * 30)], "trace_index long, tx double, ty double, offset double, azimuth double, samples array<double>")


def migrated(traces):
    return imaging.migrate(traces, GRID, 2000.0, 0.02, 30, 90.0, 60.0, min_fold=None)


def cells(df):
    return {tuple(r[c] for c in df.columns if c not in ("image", "fold")): (r.image, r.fold) for r in df.collect()}


def test_a_stopped_job_resumed_equals_one_run(spark, survey, tmp_path):
    whole, parts = (lambda name: (lambda: ImageVolumes(spark, f"{tmp_path}/{name}", GRID, 30, BINS, 7, {"v": 2000})))("whole"), (lambda name: (lambda: ImageVolumes(spark, f"{tmp_path}/{name}", GRID, 30, BINS, 7, {"v": 2000})))("parts")
    n = whole().run(survey, migrated)
    assert n == len(whole().units(survey)) == len(set(whole().units(survey)))
    assert parts().run(survey, migrated, most=3) == 3
    done = parts().progress(survey)
    assert sum(d for d, _ in done.values()) == 3 and sum(a for _, a in done.values()) == n

    class Lost(Exception):
        pass

    def fails(traces):
        raise Lost

    with pytest.raises(Lost):
        parts().run(survey, fails)
    broken = parts().units(survey)[3]  # cut off while its folder was being written
    folder = tmp_path / "parts" / "units" / f"{broken.range:09d}" / broken.bin_name
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part-00000.parquet").write_bytes(b"half a file")
    assert cells(parts().sums()).keys() <= cells(whole().sums()).keys()
    assert parts().run(survey, migrated) == n - 3 and parts().run(survey, migrated) == 0
    for get in (lambda j: j.sums(), lambda j: j.volumes(2), lambda j: j.stack()):
        same(cells(get(parts())), cells(get(whole())), 1e-12)
    own = survey.where("trace_index IS NOT NULL AND offset >= 0 AND offset < 300")
    want = {("near", *k): v for k, v in cells(imaging.migrate(own, GRID, 2000.0, 0.02, 30, 90.0, 60.0)).items()}
    same({k: v for k, v in cells(whole().volumes()).items() if k[0] == "near"}, want)


def test_jobs_of_other_parameters_are_refused(spark, tmp_path):
    ImageVolumes(spark, f"{tmp_path}/job", GRID, 30, BINS, 7)
    for changes in ({"n_out": 31}, {"each": 8}, {"bins": BINS[:1]}, {"parameters": {"v": 1}}):
        with pytest.raises(ValueError, match="other parameters"):
            ImageVolumes(spark, f"{tmp_path}/job", **({"grid": GRID, "n_out": 30, "bins": BINS, "each": 7} | changes))
    for bins in ([BINS[0], BINS[0]], [Bin("a/b", 0.0, 1.0)]):
        with pytest.raises(ValueError, match="names"):
            ImageVolumes(spark, f"{tmp_path}/other", GRID, 30, bins, 7)


def test_empty_jobs_headers_and_traces(spark, tmp_path):
    job = ImageVolumes(spark, f"{tmp_path}/job", GRID, 4, BINS, 7)
    assert job.sums().collect() == [] and job.progress(spark.createDataFrame([], "trace_index long, offset double, azimuth double")) == {"near": (0, 0), "wide": (0, 0)}
    heads = {(r.bin_name, r.trace_index): r for r in job.headers().collect()}
    assert len(heads) == 18
    r = heads["wide", 5]
    assert (r.inline, r.crossline, r.cdp_x, r.cdp_y, r.offset, r.azimuth) == (2, 3, 40.0, 80.0, 500.0, 180.0)
    image = spark.createDataFrame([(1, 2, 3, 0.5), (1, 2, 0, 1.5)], "il long, xl long, t_index long, image double")
    assert [tuple(r) for r in job.traces(image).collect()] == [(5, 1, 2, [1.5, 0.0, 0.0, 0.5])]
    assert job.headers().where(F.col("bin_name") == "near").first().azimuth == 180.0
