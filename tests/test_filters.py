import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import dsp
from strataflow.operators import filters
from strataflow.operators import traces as X
from strataflow.plans.signal import STEPS, signal_traces


def matrix(df, order="trace_index"):
    return np.array([r.samples for r in df.orderBy(order).collect()])


def test_wavelets_take_apart_and_put_together():
    rng = np.random.default_rng(0)
    for name in ("haar", "db2", "db4"):
        h = dsp.wavelet(name)
        assert (h * h).sum() == pytest.approx(1) and h.sum() == pytest.approx(2**0.5)
        for n in (64, 65, 101):
            x = rng.standard_normal((3, n))
            assert np.allclose(dsp.waverec(*dsp.wavedec(x, h, 3), h), x)
            for f in (dsp.dwt_denoise, dsp.swt_denoise, dsp.wpt_denoise):
                assert np.allclose(f(x, name, 3, 0.0), x)
            assert np.allclose(dsp.wpt_denoise(x, name, 3, 0.0, best=True), x)


def test_transforms_invert():
    x = np.random.default_rng(1).standard_normal((4, 100))
    for window in (dsp.hann(32), dsp.gaussian(32)):
        assert np.allclose(dsp.istft(dsp.stft(x, window, 16), window, 16, 100), x)
    assert np.allclose(dsp.istockwell(dsp.stockwell(x), 100), x)
    assert np.allclose(sum(dsp.modes(x[0])), x[0])
    assert np.allclose(dsp.squeezed_denoise(x, 500, k=0.0), x)
    assert np.allclose(dsp.omp_denoise(x, 32, tolerance=0.0, sparsity=1.0), x)
    assert np.allclose(dsp.fk_filter(x, 500, 25, None, None), x)


def test_bandpass_keeps_the_band_in_phase():
    t = np.arange(1000) * 0.002
    y = dsp.bandpass(np.array([np.sin(2 * np.pi * 30 * t), np.sin(2 * np.pi * 150 * t), np.ones(1000)]), 500, 10, 60)
    assert np.abs(y[0, 200:800] - np.sin(2 * np.pi * 30 * t)[200:800]).max() < 0.01
    assert np.abs(y[1:, 200:800]).max() < 0.01
    with pytest.raises(ValueError, match="band"):
        dsp.bandpass(y, 500, 60, 10)


def test_deconvolution_sharpens():
    spikes = np.zeros(300)
    spikes[[50, 120, 200]] = 1, -0.7, 0.5
    trace = np.convolve(spikes, np.exp(-np.arange(30) / 5))[:300]
    assert np.abs(dsp.deconvolve(trace, (0, 300), 40) - spikes).max() < 0.02
    assert dsp.deconvolve(trace, (0, 50), 40) is trace


def test_denoising_helps():
    rng = np.random.default_rng(2)
    t = np.arange(512) * 0.002
    clean = np.array([np.sin(2 * np.pi * 25 * t) * np.exp(-((t - 0.5) ** 2) / 0.02) for _ in range(12)])
    noisy = clean + 0.2 * rng.standard_normal(clean.shape)
    error = np.abs(noisy - clean).mean()
    for f in (dsp.dwt_denoise(noisy), dsp.swt_denoise(noisy), dsp.wpt_denoise(noisy), dsp.omp_denoise(noisy, adaptive=True), dsp.stft_denoise(noisy, 500, high=250.0)):
        assert np.abs(f - clean).mean() < error
    spike = clean.copy()
    spike[5] *= 20
    assert np.abs(dsp.stockwell_denoise(spike, 500)[5]).max() < 0.3 * np.abs(spike[5]).max()


def test_dips_and_noise_levels():
    x, t = np.meshgrid(np.arange(30) * 25.0, np.arange(200) * 0.004, indexing="ij")
    found = dsp.dips(np.sin(2 * np.pi * 8 * (t - 0.0004 * x)), 0.004, 25.0)
    assert np.median(found[5:25, 20:180]) == pytest.approx(0.0004, rel=0.05)
    rng = np.random.default_rng(4)
    noisy = np.sin(2 * np.pi * 2 * t) + 0.1 * rng.standard_normal(t.shape)
    assert np.median(dsp.snr_db(noisy)) == pytest.approx(10 * np.log10(0.5 / 0.01), abs=1.5)


def test_neighbours_choose_atoms():
    rng = np.random.default_rng(5)
    clean = np.tile(np.cos(np.pi * 5 * (np.arange(64) + 0.5) / 64), (9, 1))
    noisy = clean + 0.5 * rng.standard_normal(clean.shape)
    assert np.abs(dsp.omp_spatial(noisy, 64, sparsity=0.02, half=4) - clean).mean() < 0.5 * np.abs(noisy - clean).mean()


def test_fkk_removes_a_cone():
    x, y, t = np.meshgrid(np.arange(32) * 25.0, np.arange(16) * 25.0, np.arange(128) * 0.004, indexing="ij")
    slow, fast = np.sin(2 * np.pi * 10 * (t - x / 800)), np.sin(2 * np.pi * 10 * (t - x / 8000))
    out = dsp.fkk_filter(slow + fast, 0.004, 25, 25, 300, 1600)
    assert np.abs(out - fast)[8:24, 4:12, 32:96].mean() < 0.5 * np.abs(slow).mean()


@pytest.mark.parametrize("name", ["dwt_spatial", "stft_denoise", "gabor_denoise", "stockwell_denoise", "dip"])
def test_blocks_with_a_halo_change_nothing(spark, sf, name):
    df = signal_traces(spark, sf).withColumn("gather", F.lit(1))
    p = {"dwt_spatial": {}, "stft_denoise": {"rate": 500.0, "size": 16}, "gabor_denoise": {"rate": 500.0, "size": 16}, "stockwell_denoise": {"rate": 500.0}, "dip": {"dt": 0.002, "dx": 25.0}}[name]
    kernel = filters.REGISTRY[name][2]
    whole = kernel(matrix(df), **p)
    blocks = filters.per_gather(df, lambda x: kernel(x, **p), "gather", ["trace_index"], filters.REGISTRY[name][1](p), 17)
    inner = slice(None) if name != "dip" else slice(3, -3)
    assert np.allclose(matrix(blocks)[inner], whole[inner])
    assert blocks.count() == df.count()


def test_operators_equal_their_kernels(spark, sf):
    df = signal_traces(spark, sf)
    x = matrix(df)
    for name, p in [STEPS[k] for k in ("dsp_bandpass", "dsp_dwt_denoise", "dsp_swt_denoise", "dsp_omp_denoise", "dsp_emd_denoise")]:
        assert np.allclose(matrix(filters.apply(df, name, p)), filters.REGISTRY[name][2](x, **p))


def test_registry():
    with pytest.raises(ValueError, match="sees"):
        filters.register("x", "nothing", lambda x: x)
    with pytest.raises(KeyError, match="bandpass"):
        filters.apply(None, "missing")


def test_expressions_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6, 40))
    df = spark.createDataFrame([(k, k // 3, float(k * 10), row.tolist()) for k, row in enumerate(x)], "trace_index long, gather long, offset double, samples array<double>")
    assert np.allclose(matrix(df.select("trace_index", X.gain(F.col("samples"), 3.0).alias("samples"))), 3 * x)
    got = matrix(df.select("trace_index", X.autocorrelation(F.col("samples"), 5).alias("samples")))
    assert np.allclose(got, [[(r[: 40 - k] * r[k:]).sum() / 40 for k in range(6)] for r in x])
    agc = matrix(X.agc(df, 3))
    for k, (r, g) in enumerate(zip(x, agc, strict=True)):
        gather = x[k // 3 * 3 :][:3]
        wide = np.pad(r * r, 3, mode="symmetric")
        rms = np.sqrt(np.array([wide[k : k + 7].mean() for k in range(40)]))
        assert np.allclose(g, r / (rms + max(0.001 * np.sqrt((gather * gather).mean()), 1e-10)))
    once = X.mute(F.col("samples"), F.col("offset"), 1000.0, 2.0, top=True, taper=0)
    twice = X.mute(once, F.col("offset"), 1000.0, 2.0, top=True, taper=0)
    assert np.allclose(matrix(df.select("trace_index", once.alias("samples"))), matrix(df.select("trace_index", twice.alias("samples"))))
    with pytest.raises(ValueError, match="mute"):
        X.mute(F.col("samples"), F.col("offset"), 1000.0, 2.0)


def test_ragged_and_null_traces(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0]), (3, None), (4, [])], "trace_index long, samples array<double>")
    assert [r.samples for r in filters.apply(df, "gain", {"factor": 2.0}).orderBy("trace_index").collect()] == [[2, 4, 6], [8], None, []]


def test_emd_refuses_what_it_does_not_know():
    x = np.random.default_rng(1).standard_normal((2, 64))
    for method in ("ceemd", "emd_fast", ""):
        with pytest.raises(ValueError, match="none of"):
            dsp.emd_denoise(x, method)
    for remove in ("middle", "first_x"):
        with pytest.raises(ValueError, match="neither"):
            dsp.emd_denoise(x, remove=remove)
    assert dsp.emd_denoise(x, "eemd", ensemble=2).shape == x.shape
    assert (dsp.emd_denoise(x, "eemd_fast", ensemble=2) == dsp.emd_denoise(x, "eemd", ensemble=2)).all()


def test_tridiagonal_solves_and_splines_are_natural():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50):
        side, middle, right = rng.random(n - 1), 3 + rng.random(n), rng.standard_normal(n)
        full = np.diag(middle) + np.diag(side, 1) + np.diag(side, -1)
        assert np.allclose(dsp.tridiagonal(side, middle, right), np.linalg.solve(full, right))
    x = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    y = rng.standard_normal(5)
    at = np.linspace(0, 7, 2801)
    s = dsp.spline(x, y, at)
    bend = np.diff(s, 2) / (at[1] - at[0]) ** 2
    assert np.allclose(dsp.spline(x, y, x), y) and abs(bend[0]) < 0.05 and abs(bend[-1]) < 0.05
    assert np.abs(np.diff(bend)).max() < 0.1  # the second derivative has no steps


def plain_adaptive(x, ensemble, noise, seed, most):
    """Adaptive noise by its definition, one step after the other."""
    rng = np.random.default_rng([seed, len(x)])
    raw = [rng.standard_normal(len(x)) for _ in range(ensemble)]
    parts = [dsp.modes(w, most) for w in raw]
    out, rest = [], x.copy()
    for k in range(most):
        turns = sum((rest[i] - rest[i - 1] > 0) != (rest[i + 1] - rest[i] > 0) for i in range(1, len(x) - 1))
        if turns < 3:
            break
        total = np.zeros(len(x))
        for w, p in zip(raw, parts, strict=True):
            extra = w if k == 0 else p[k] if k < len(p) - 1 else None
            total += dsp.modes(rest if extra is None else rest + noise * rest.std() * extra / extra.std(), 1)[0]
        out.append(total / ensemble)
        rest = rest - out[-1]
    return [*out, rest]


def test_adaptive_modes():
    t = np.arange(200) / 200
    x = np.sin(2 * np.pi * 40 * t) * (t > 0.5) + np.sin(2 * np.pi * 5 * t) + 2 * t
    got, want = dsp.adaptive_modes(x, 6, 0.2, 7, 5), plain_adaptive(x, 6, 0.2, 7, 5)
    assert len(got) == len(want) and all(np.allclose(a, b) for a, b in zip(got, want, strict=True))
    assert np.allclose(sum(got), x, atol=1e-12)
    assert np.corrcoef(got[0][100:], (np.sin(2 * np.pi * 40 * t))[100:])[0, 1] > 0.9  # the fast part is the first mode's
    assert np.allclose(dsp.emd_denoise(x[None], "ceemdan", "first_2", 6, 0.2, 7, 5)[0], sum(want[2:]))
    assert np.allclose(dsp.emd_denoise(x[None], "ceemdan", "last", 6, 0.2, 7, 5)[0], sum(want[:-1]))
    for flat in (np.zeros(50), np.ones(50), np.arange(50.0)):
        assert np.allclose(dsp.emd_denoise(flat[None], "ceemdan", ())[0], flat)


def test_wavelet_squeezing():
    t = np.arange(512) / 500
    chirp = np.sin(2 * np.pi * (20 * t + 40 * t * t))[None]
    rate = 20 + 80 * t
    for name in dsp.WAVELETS:
        f, w, dw = dsp.cwt(chirp, 500.0, name, 16)
        spectrum = np.fft.rfft(chirp, axis=1)
        weight = dsp.wavelet_bank(512, 500.0, name, 16)[1].sum(axis=0)
        few = weight <= 0.1 * weight.max()  # the mean, and what has few voices at the ends
        assert few[0] and few.sum() <= 3
        spectrum[:, few] = 0
        assert np.allclose(dsp.icwt(w, 500.0, name, 16), np.fft.irfft(spectrum, 512, axis=1), atol=1e-9)
        assert np.allclose(dsp.squeezed_wavelets(chirp, 500.0, name, k=0.0), chirp)
    f, w, dw = dsp.cwt(chirp, 500.0, "morlet", 16)
    target = dsp.reassigned(f, w, dw, 16)
    power = np.zeros(w.shape[1:])
    np.add.at(power, (target[0], np.broadcast_to(np.arange(512), target[0].shape)), np.abs(w[0]) ** 2)
    ridge = f[power[:, 50:-50].argmax(axis=0)]
    assert np.abs(np.log2(ridge / rate[50:-50])).max() < 0.15  # within a tenth of an octave or so of the chirp's frequency
    near = np.abs(np.log2(f[:, None] / rate[None, :])) < 0.15
    share = lambda p: (p * near)[:, 50:-50].sum() / p[:, 50:-50].sum()
    assert share(power) > 0.9 > share(np.abs(w[0]) ** 2)
    noisy = chirp + 0.5 * np.random.default_rng(2).standard_normal(chirp.shape)
    clean = dsp.squeezed_wavelets(noisy, 500.0, "morlet", 16, 3.0)
    assert ((clean - chirp) ** 2).mean() < 0.5 * ((noisy - chirp) ** 2).mean()
    plainly = dsp.squeezed_wavelets(noisy, 500.0, "morlet", 16, 3.0, squeezing=False)
    assert np.isfinite(plainly).all() and not np.allclose(plainly, clean)
    assert np.allclose(dsp.squeezed_wavelets(np.zeros((1, 64)), 500.0), 0)
    with pytest.raises(ValueError, match="none of"):
        dsp.squeezed_wavelets(chirp, 500.0, "haar")


def plain_modes(x, most, sifts=10):
    """Sifting by its definition, trace by trace."""
    out, rest, t = [], x.copy(), np.arange(len(x), dtype=float)
    for _ in range(most):
        mode = rest.copy()
        for _ in range(sifts):
            d = np.diff(mode)
            tops, dips = (np.flatnonzero((s[:-1] > 0) & (s[1:] <= 0)) + 1 for s in (d, -d))
            if len(tops) < 2 or len(dips) < 2:
                break
            upper, lower = (dsp.spline(k.astype(float), mode[k], t) for k in (np.r_[0, e, len(x) - 1] for e in (tops, dips)))
            mode = mode - (upper + lower) / 2
            if (((upper + lower) / 2) ** 2).sum() < 1e-4 * max((mode**2).sum(), 1e-300):
                break
        if np.allclose(mode, rest) and out:
            break
        out.append(mode)
        rest = rest - mode
        if np.abs(rest).max() < 1e-10 * max(np.abs(x).max(), 1e-300):
            break
    return [*out, rest]


def test_modes_of_many_traces_are_those_of_each():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.standard_normal((3, 60)), rng.standard_normal((3, 60)).cumsum(axis=1), rng.integers(-2, 3, (2, 60)), np.zeros((1, 60)), np.arange(60.0)[None]])
    found, count, rest = dsp.modes_of(x, 5)
    for k, trace in enumerate(x):
        want = plain_modes(trace, 5)
        assert count[k] == len(want) - 1 and np.allclose([*[m[k] for m in found[: count[k]]], rest[k]], want)
        for remove in ("first", "first_2", "first_9", "last", (0, -1), (9,)):
            gone = sum((want[j] for j in dsp.removed_modes(remove, len(want))), np.zeros(60))
            assert np.allclose(dsp.emd_denoise(x, "emd", remove, most=5)[k], trace - gone)
    for method in ("eemd", "ceemdan"):
        assert np.allclose(dsp.emd_denoise(x, method, ensemble=3), [dsp.emd_denoise(t[None], method, ensemble=3)[0] for t in x])
    broken = np.r_[x[:1], np.full((1, 60), np.nan)]
    assert np.allclose(dsp.emd_denoise(broken, "eemd", ensemble=3)[0], dsp.emd_denoise(x[:1], "eemd", ensemble=3)[0])


def test_modes_of_many_traces_are_looked_for_together(monkeypatch):
    calls, solve = [], dsp.tridiagonal
    monkeypatch.setattr(dsp, "tridiagonal", lambda *a: calls.append(1) or solve(*a))
    dsp.emd_denoise(np.random.default_rng(5).standard_normal((200, 64)))
    assert len(calls) <= 10  # as often as one trace is sifted at most, not for each trace and mode


def test_traces_of_one_file_are_spread(spark, sf):
    df = signal_traces(spark, sf)
    assert filters.spread(df, "trace_index").rdd.getNumPartitions() == 4 and sorted(filters.spread(df, "trace_index").collect()) == sorted(df.collect())
