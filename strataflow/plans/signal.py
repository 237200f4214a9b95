"""Queries of the array kernels over embeddings as traces. SQL can't express them; tests hold them against plain NumPy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import filters
from strataflow.plans.series import flat, with_offset

RATE = 500.0
STEPS = {
    "dsp_bandpass": ("bandpass", {"rate": RATE, "low": 20.0, "high": 120.0}),
    "dsp_decon_spiking": ("deconvolution", {"dt_ms": 2.0, "length": 10}),
    "dsp_decon_predictive": ("deconvolution", {"dt_ms": 2.0, "length": 10, "gap": 4}),
    "dsp_dwt_denoise": ("dwt_denoise", {}),
    "dsp_swt_denoise": ("swt_denoise", {"level": 3}),
    "dsp_dwt_spatial": ("dwt_spatial", {}),
    "dsp_wpt_denoise": ("wpt_denoise", {"name": "db2", "level": 3}),
    "dsp_wpt_best_basis": ("wpt_denoise", {"name": "db2", "level": 3, "best": True}),
    "dsp_wpt_spatial": ("wpt_spatial", {"name": "db2", "level": 3}),
    "dsp_stft_denoise": ("stft_denoise", {"rate": RATE, "size": 16}),
    "dsp_gabor_denoise": ("gabor_denoise", {"rate": RATE, "size": 16}),
    "dsp_stockwell_denoise": ("stockwell_denoise", {"rate": RATE}),
    "dsp_tf_denoise": ("tf_denoise", {"rate": RATE, "transform": "stft", "size": 16, "mode": "scaled"}),
    "dsp_sst_denoise": ("sst_denoise", {"rate": RATE, "size": 16}),
    "dsp_sst_wavelets": ("sst_denoise", {"base": "cwt", "rate": RATE, "voices": 8}),
    "dsp_emd_denoise": ("emd_denoise", {}),
    "dsp_eemd_denoise": ("emd_denoise", {"method": "eemd", "ensemble": 4}),
    "dsp_ceemdan_denoise": ("emd_denoise", {"method": "ceemdan", "ensemble": 4}),
    "dsp_omp_denoise": ("omp_denoise", {"size": 32}),
    "dsp_omp_adaptive": ("omp_denoise", {"size": 32, "adaptive": True, "kind": "hybrid"}),
    "dsp_omp_spatial": ("omp_spatial", {"size": 32, "kind": "gabor"}),
    "dsp_dip": ("dip", {"dt": 0.002, "dx": 25.0}),
    "dsp_fk_velocity": ("fk_filter", {"rate": RATE, "dx": 25.0, "low": 1500.0, "high": 6000.0}),
    "dsp_fk_dip": ("fk_filter", {"rate": RATE, "dx": 25.0, "low": -0.0002, "high": 0.0002, "taper": 0.00005, "dip": True, "mode": "reject"}),
    "dsp_fkk_filter": ("fkk_filter", {"dt": 0.002, "dx": 25.0, "dy": 25.0, "v_min": 500.0, "v_max": 2500.0, "pad": (2, 2, 8)}),
    "dsp_denoise_3d": ("denoise_3d", {}),
}


def signal_traces(s, d) -> DataFrame:
    t = F.col("trace_index")
    return with_offset(s, d).withColumn("ix", t % 10).withColumn("iy", F.floor(t / 10) % 12)


def _cubes(df: DataFrame) -> DataFrame:
    """One volume per 120 traces, so each cell has one trace."""
    return df.withColumn("gather", F.floor(F.col("trace_index") / 120).cast("int"))


def _query(name: str, parameters: dict):
    cube = filters.REGISTRY[name][0] in ("cube", "volume")
    prepared = _cubes if cube else (lambda df: filters.spread(df, "trace_index")) if name == "emd_denoise" else (lambda df: df)
    return lambda s, d: flat(filters.apply(prepared(signal_traces(s, d)), name, parameters))


def chained(s, d):
    return flat(filters.pipeline(signal_traces(s, d), [("bandpass", {"rate": RATE, "low": 10.0, "high": 150.0}), ("gain", {"factor": 2.0}), ("dwt_denoise", {})]))


def spectrum(s, d):
    return filters.average_spectrum(signal_traces(s, d), RATE, ["gather"]).select("gather", F.round("frequency", 6).alias("frequency"), F.round("amplitude", 6).alias("amplitude"))


def dominant(s, d):
    return filters.dominant_frequency(filters.average_spectrum(signal_traces(s, d), RATE, ["gather"]), ["gather"], 10.0, 200.0).select("gather", F.round("frequency", 6).alias("frequency"), F.round("db", 6).alias("db"))


#: A Fourier sum in SQL: slow, but plain.
SPECTRUM_SQL = """WITH e AS (SELECT vec_id, label AS gather, unnest(range(64)) AS s, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings),
f AS (SELECT range AS k FROM range(33)), x AS (SELECT vec_id, gather, k, sqrt(sum(a * cos(2 * pi() * k * s / 64)) ** 2 + sum(a * sin(2 * pi() * k * s / 64)) ** 2) AS m FROM e, f GROUP BY ALL)
SELECT gather, round(k * 500.0 / 64, 6) AS frequency, round(avg(m), 6) AS amplitude FROM x GROUP BY gather, k"""
DOMINANT_SQL = f"WITH q AS ({SPECTRUM_SQL.replace('round(avg(m), 6)', 'avg(m)')}) SELECT gather, arg_max(frequency, amplitude) AS frequency, round(20 * log10(max(amplitude) + 1e-10), 6) AS db FROM q WHERE frequency BETWEEN 10 AND 200 GROUP BY gather"

#: Pairs' sums and differences; the differences shrunk by three noise levels of their median.
HAAR_SQL = """WITH e AS (SELECT vec_id AS trace_index, unnest(range(64)) AS s, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings),
h AS (SELECT trace_index, s // 2 AS i, sum(a) / sqrt(2) AS low, sum(CASE WHEN s % 2 = 0 THEN a ELSE -a END) / sqrt(2) AS high FROM e GROUP BY ALL),
m AS (SELECT trace_index, 3 * median(abs(high)) / 0.6745 AS most FROM h GROUP BY trace_index),
k AS (SELECT trace_index, i, low, sign(high) * {} AS high FROM h JOIN m USING (trace_index)), b AS (SELECT unnest([0, 1]) AS side)
SELECT trace_index, CAST(2 * i + side AS BIGINT) AS s, round((low + CASE WHEN side = 0 THEN high ELSE -high END) / sqrt(2), 6) + 0.0 AS a FROM k, b"""
HAAR = {"name": "haar", "level": 1}

#: Gathers of the traces' labels, in order of trace_index.
LABELS = "SELECT vec_id AS trace_index, CAST(label AS VARCHAR) AS p, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n, embedding AS e FROM embeddings"


def fourier(source: str, axis: str, length: str, into: str, sign: int, keys: str) -> str:
    """A step of WITH: Fourier sums of source(keys, axis, re, im) along an axis of so many places; sign -1: forwards, 1: back."""
    k = f"2 * pi() * {axis} * k / {length}"
    over = f" / {length}" if sign > 0 else ""
    return f"""{into} AS MATERIALIZED (SELECT {keys}, k AS {axis}, sum(re * cos({k}) - im * {sign} * sin({k})){over} AS re, sum(re * {sign} * sin({k}) + im * cos({k})){over} AS im
  FROM (SELECT *, unnest(range({length})) AS k FROM {source}) GROUP BY {keys}, k),
"""


def wrapped(axis: str, length: str, step: str) -> str:
    """The frequency of a place, negative in the upper half."""
    return f"(CASE WHEN 2 * {axis} < {length} THEN {axis} ELSE {axis} - {length} END / ({length} * {step}::DOUBLE))"


def fk_sql(gathers: str, weight: str) -> str:
    """Two-dimensional Fourier sums of gathers(trace_index, p, i, n, e), weights by f and kx, and the sums back: time by 64 samples, place by the gather's n traces."""
    return f"""WITH t AS MATERIALIZED ({gathers}),
x AS MATERIALIZED (SELECT p, n, i, CAST(unnest(range(64)) AS BIGINT) AS s, CAST(unnest(e) AS DOUBLE) AS re, 0.0::DOUBLE AS im FROM t),
{fourier("x", "s", "64", "f1", -1, "p, n, i")}{fourier("f1", "i", "n", "f2", -1, "p, n, s")}g AS (SELECT *, {wrapped("s", "64", "0.002")} AS f, {wrapped("i", "n", "25")} AS kx FROM f2),
w AS (SELECT p, n, s, i, re, im, CASE WHEN s = 0 AND i = 0 THEN 1 ELSE {weight} END AS w FROM g),
h AS (SELECT p, n, s, i, re * w AS re, im * w AS im FROM w),
{fourier("h", "i", "n", "b1", 1, "p, n, s")}{fourier("b1", "s", "64", "b2", 1, "p, n, i")}r AS (SELECT p, i, s, re FROM b2)
SELECT trace_index, CAST(s AS BIGINT) AS s, round(re, 6) + 0.0 AS a FROM r JOIN t USING (p, i)"""


_RAMP = "(0.5 * (1 - cos(pi() * greatest(0, least(1, {})))))"
_V = "abs(f / nullif(kx, 0))"
VELOCITY_WEIGHT = f"CASE WHEN kx = 0 THEN 0 ELSE {_RAMP.format(f'({_V} - 1300) / 400')} * (1 - {_RAMP.format(f'({_V} - 5800) / 400')}) END"
_DIP = "(kx / nullif(f, 0))"
DIP_WEIGHT = f"CASE WHEN f = 0 THEN 1 ELSE 1 - {_RAMP.format(f'{_DIP} / -0.00015')} * (1 - {_RAMP.format(f'({_DIP} - 0.00015) / 0.0001')}) END"
#: Volumes of 120 traces, ends repeated by 2 traces and 8 samples, and a cone between 500 and 2,500.
_CONE = f"{_RAMP.format('(v - 450) / 100')} * (1 - {_RAMP.format('(v - 2250) / 500')})"
FKK_SQL = f"""WITH t AS MATERIALIZED (SELECT vec_id AS trace_index, vec_id // 120 AS p, vec_id % 10 AS ix, vec_id // 10 % 12 AS iy, embedding AS e FROM embeddings),
m AS (SELECT p, max(ix) + 5 AS nx, max(iy) + 5 AS ny FROM t GROUP BY p),
j AS (SELECT p, nx, ny, unnest(range(nx)) AS ix FROM m), l AS (SELECT *, unnest(range(ny)) AS iy FROM j), q AS (SELECT *, CAST(unnest(range(80)) AS BIGINT) AS s FROM l),
x AS MATERIALIZED (SELECT q.p, nx, ny, q.ix, q.iy, q.s, coalesce(CAST(t.e[greatest(0, least(63, q.s - 8)) + 1] AS DOUBLE), 0) AS re, 0.0::DOUBLE AS im
  FROM q LEFT JOIN t ON t.p = q.p AND t.ix = greatest(0, least(nx - 5, q.ix - 2)) AND t.iy = greatest(0, least(ny - 5, q.iy - 2))),
{fourier("x", "s", "80", "f1", -1, "p, nx, ny, ix, iy")}{fourier("f1", "ix", "nx", "f2", -1, "p, nx, ny, s, iy")}{fourier("f2", "iy", "ny", "f3", -1, "p, nx, ny, s, ix")}
g AS (SELECT *, abs({wrapped("s", "80", "0.002")}) AS f, {wrapped("ix", "nx", "25")} AS kx, {wrapped("iy", "ny", "25")} AS ky FROM f3),
v AS (SELECT *, f / greatest(sqrt(kx * kx + ky * ky), 1e-10) AS v FROM g),
w AS (SELECT *, CASE WHEN f = 0 OR (kx = 0 AND ky = 0) THEN 1 ELSE 1 - {_CONE} END AS w FROM v),
h AS (SELECT p, nx, ny, s, ix, iy, re * w AS re, im * w AS im FROM w),
{fourier("h", "iy", "ny", "b1", 1, "p, nx, ny, s, ix")}{fourier("b1", "ix", "nx", "b2", 1, "p, nx, ny, s, iy")}{fourier("b2", "s", "80", "b3", 1, "p, nx, ny, ix, iy")}
r AS (SELECT p, ix - 2 AS ix, iy - 2 AS iy, s - 8 AS s, re FROM b3 WHERE s BETWEEN 8 AND 71)
SELECT trace_index, CAST(s AS BIGINT) AS s, round(re, 6) + 0.0 AS a FROM r JOIN t USING (p, ix, iy)"""
FK_SQL = {"dsp_fkk_filter": FKK_SQL, "dsp_fk_velocity": fk_sql(LABELS, VELOCITY_WEIGHT), "dsp_fk_dip": fk_sql(LABELS, DIP_WEIGHT)}

QUERIES = {
    "dsp_dwt_haar": (_query("dwt_denoise", HAAR), HAAR_SQL.format("greatest(abs(high) - most, 0)")),
    "dsp_dwt_haar_hard": (_query("dwt_denoise", HAAR | {"mode": "hard"}), HAAR_SQL.format("CASE WHEN abs(high) > most THEN abs(high) ELSE 0 END")),
    **{name: (_query(*step), FK_SQL.get(name)) for name, step in STEPS.items()},
    "dsp_pipeline": (chained, None),
    "dsp_spectrum": (spectrum, SPECTRUM_SQL),
    "dsp_dominant_frequency": (dominant, DOMINANT_SQL),
}
