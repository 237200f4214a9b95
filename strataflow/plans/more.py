"""Queries of moveout by velocity functions, apertures, tables, SQL functions and sub-gathers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import geometry as G
from strataflow.functions import physics as P
from strataflow.functions import sql
from strataflow.operators import filters, moveout, velocity
from strataflow.plans.headers import OFFSET_SQL, headers
from strataflow.plans.headers import SQL as HEADERS
from strataflow.plans.headers import _r as rounded
from strataflow.plans.series import SAMPLES, flat, with_offset
from strataflow.plans.signal import _RAMP, _V, fk_sql, signal_traces


def _knots(s):
    return velocity.linear(s, 15000.0, 40000.0, 0.2, 0.02)


def nmo(s, d):
    return flat(moveout.nmo(with_offset(s, d), _knots(s), 0.002).select("trace_index", "samples"))


_NMO = """, n AS (SELECT e.*, s * 2e-3 AS t0, sqrt(s * 2e-3 * (s * 2e-3) + (o / (15e3 + 4e4 * (s * 2e-3))) * (o / (15e3 + 4e4 * (s * 2e-3)))) AS t FROM e),
m AS (SELECT *, t > 1.5 * CASE WHEN s = 0 THEN t0 ELSE t0 END AS far FROM n),
q AS (SELECT m.*, CASE WHEN s = 0 THEN lead(far) OVER (PARTITION BY trace_index ORDER BY s) ELSE far END AS muted, CAST(floor(t / 2e-3 + 1e-9) AS BIGINT) AS k, t / 2e-3 - floor(t / 2e-3 + 1e-9) AS part FROM m),
f AS (SELECT trace_index, min(s) FILTER (WHERE muted) AS first FROM q GROUP BY trace_index)
SELECT q.trace_index, q.s, round(CASE WHEN muted OR t > 63 * 2e-3 + 1e-12 THEN 0 ELSE (x.a + (coalesce(y.a, x.a) - x.a) * part) * CASE WHEN first > q.s AND q.s >= first - least(10, first) THEN CASE WHEN least(10, first) = 1 THEN 1 ELSE 1 - (q.s - (first - least(10, first))) / (least(10, first) - 1.0) END ELSE 1 END END, 6) + 0.0 AS a
FROM q JOIN f USING (trace_index) LEFT JOIN e x ON q.trace_index = x.trace_index AND x.s = k LEFT JOIN e y ON q.trace_index = y.trace_index AND y.s = k + 1"""


#: The same times, mutes and taper, with a sum of eight samples under a Hann-windowed sinc.
_NMO_SINC = (
    _NMO[: _NMO.index("SELECT q.trace_index")].rstrip()
    + """,
w AS (SELECT trace_index, s, t / 2e-3 AS at, unnest(range(CAST(floor(t / 2e-3) AS BIGINT) - 3, CAST(floor(t / 2e-3) AS BIGINT) + 5)) AS j FROM q),
z AS (SELECT w.trace_index, w.s, sum(e.a * CASE WHEN w.at = j THEN 1 ELSE sin(pi() * (w.at - j)) / (pi() * (w.at - j)) END * 0.5 * (1 + cos(pi() * (w.at - j) / 4))) AS v
  FROM w JOIN e ON e.trace_index = w.trace_index AND e.s = j WHERE w.at BETWEEN 0 AND 63 AND abs(w.at - j) < 4 GROUP BY w.trace_index, w.s)
"""
    + _NMO[_NMO.index("SELECT q.trace_index") : _NMO.index("FROM q JOIN f")].replace("t > 63 * 2e-3 + 1e-12", "z.v IS NULL").replace("(x.a + (coalesce(y.a, x.a) - x.a) * part)", "z.v")
    + "FROM q JOIN f USING (trace_index) LEFT JOIN z ON q.trace_index = z.trace_index AND q.s = z.s"
)


def nmo_there_and_back(s, d):
    return flat(moveout.inverse_nmo(moveout.nmo(with_offset(s, d), _knots(s), 0.002, stretch=100.0, taper=0), _knots(s), 0.002).select("trace_index", "samples"))


def nmo_sinc(s, d):
    return flat(moveout.nmo(with_offset(s, d), _knots(s), 0.002, method="sinc").select("trace_index", "samples"))


def at_times(s, d):
    t = F.col("trace_index") % 70 * 1.9 - 3
    return with_offset(s, d).select("trace_index", rounded(moveout.sample_at(F.col("samples"), t, 2.0), "a"))


TABLE = [[float(i * i + 3 * j) for j in range(6)] for i in range(5)]


def looked_up(s, d):
    return headers(s, d).select("k", "n", "part", rounded(moveout.table_lookup(TABLE, F.col("sx") / 6000, F.col("ry") / 70, (1.0, 1.0)), "v"))


_TABLE = """, c AS (SELECT *, greatest(0, least(3.999999::DOUBLE, sx / 6000)) AS u, greatest(0, least(4.999999::DOUBLE, ry / 70)) AS v FROM h), g AS (SELECT *, floor(u) AS i, floor(v) AS j FROM c)
SELECT k, n, part, round(((i * i + 3 * j) * (1 - (u - i)) + ((i + 1) * (i + 1) + 3 * j) * (u - i)) * (1 - (v - j)) + ((i * i + 3 * (j + 1)) * (1 - (u - i)) + ((i + 1) * (i + 1) + 3 * (j + 1)) * (u - i)) * (v - j), 6) + 0.0 AS v FROM g"""


def anisotropic(s, d):
    h, z, e, dl, v = G.offset(*[F.col(c) for c in ("sx", "sy", "rx", "ry")]), F.col("n") * 300.0, F.col("n") * 0.03, F.col("supp") % 10 * 0.02 - 0.05, F.lit(2500.0)
    return headers(s, d).select("k", "n", "part", "supp", rounded(P.vti_time_exact(h, z, v, e, dl), "exact"), rounded(P.vti_time_weak(h, z, v, e, dl), "weak"))


_VTI = f""", g AS (SELECT *, {OFFSET_SQL} AS o, n * 300.0 AS z, n * 0.03 AS e, supp % 10 * 0.02 - 0.05 AS dl FROM h), q AS (SELECT *, atan2(o, z) AS th FROM g), f AS (SELECT *, 1 + dl * sin(th) ** 2 * cos(th) ** 2 + e * sin(th) ** 4 AS f FROM q)
SELECT k, n, part, supp, round(sqrt(o * o + z * z) / (2500 * f), 6) + 0.0 AS exact, round(sqrt(o * o + z * z) / (2500 * sqrt(greatest(f, 0.1))), 6) + 0.0 AS weak FROM f"""


def apertures(s, d):
    z, hs, hr = F.col("n") * 500.0, F.col("sx") / 8, F.col("ry") * 3
    a, b = F.atan2(hs, z), F.atan2(hr, z)
    w = P.true_amplitude_weight(F.hypot(hs, z), F.hypot(hr, z), a, b, F.lit(2000.0))
    return headers(s, d).select("k", "n", "part", rounded(P.effective_aperture(z, 2000.0, 45.0), "effective"), rounded(P.aperture_weight(hs, hr, z, F.col("rx"), 2500.0, 60.0, (1000.0, 20000.0)), "mask"), F.round(w * 1e12, 4).alias("weight"))


def _taper(x: str, most: float) -> str:
    return f"CASE WHEN {x} <= {most * 0.9}::DOUBLE THEN 1.0 WHEN {x} >= {most}::DOUBLE THEN 0.0 ELSE 0.5 * (1 + cos(pi() * ({x} - {most * 0.9}::DOUBLE) / {most - most * 0.9}::DOUBLE)) END"


_APERTURES = f""", w AS (SELECT *, n * 500.0 AS z, sx / 8 AS hs, ry * 3 AS hr FROM h), a AS (SELECT *, atan2(hs, z) AS a, atan2(hr, z) AS b FROM w)
SELECT k, n, part, round(least(z * tan(radians(45)), 2000.0), 6) + 0.0 AS effective,
round(CASE WHEN rx BETWEEN 1000 AND 20000 THEN 1.0 ELSE 0.0 END * {_taper('hs', 2500.0)} * {_taper('degrees(a)', 60.0)} * {_taper('hr', 2500.0)} * {_taper('degrees(b)', 60.0)}, 6) + 0.0 AS mask,
round(cos(a) * cos(b) / (greatest(sqrt(hs * hs + z * z), 1) * greatest(sqrt(hr * hr + z * z), 1) * 2000) / greatest(cos((a + b) / 2), 0.1) * 1e12, 4) AS weight FROM a"""


def grouped_depths(s, d):
    depths = s.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 100 * 50.0).alias("z")).distinct()
    return moveout.depth_groups(depths, 3000.0, 50.0).select("z", F.round("aperture", 6).alias("aperture"), "depth_group")


_DEPTHS = """WITH p AS (SELECT DISTINCT p_partkey % 100 * 50.0::DOUBLE AS z FROM part), z AS (SELECT z, least(z * tan(radians(50)), 3000.0::DOUBLE) AS a FROM p), e AS (SELECT greatest(100.0, min(a) FILTER (WHERE a > 0)) AS low, max(a) * 1.1::DOUBLE AS high FROM z)
SELECT z, round(a, 6) AS aperture, CAST(least(4, floor(ln(greatest(a, low) / low) / ln(high / low) * 5)) AS BIGINT) AS depth_group FROM z, e"""


def estimates(s, d):
    return moveout.trace_estimates(headers(s, d).select(F.col("rx").alias("tx"), F.col("ry").alias("ty")), 500.0)


def by_sql(s, d) -> DataFrame:
    sql.register(s)
    with_offset(s, d).createOrReplaceTempView("strataflow_traces")
    rows = s.sql("SELECT trace_index, x.sample_index AS s, x.amplitude AS a FROM strataflow_traces, LATERAL explode_samples(samples, 2.0D) x")
    return rows.select("trace_index", F.col("s").cast("long").alias("s"), rounded(F.col("a"), "a"))


def bands(s, d):
    """Each trace in three frequency bands."""
    out = None
    for low, high in ((10.0, 40.0), (40.0, 80.0), (80.0, 160.0)):
        one = filters.apply(with_offset(s, d), "bandpass", {"rate": 500.0, "low": low, "high": high})
        one = flat(one.select("trace_index", "samples")).withColumn("band", F.lit(low))
        out = one if out is None else out.unionByName(one)
    return out


def fk_by_sub_gather(s, d):
    df = signal_traces(s, d).withColumn("sub", F.concat_ws("-", "gather", (F.col("trace_index") / 100).cast("int").cast("string")))
    return flat(filters.apply(df, "fk_filter", {"rate": 500.0, "dx": 25.0, "low": 1500.0, "high": None}, gather="sub"))


_SUBS = "SELECT vec_id AS trace_index, label || '-' || vec_id // 100 AS p, row_number() OVER (PARTITION BY label, vec_id // 100 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label, vec_id // 100) AS n, embedding AS e FROM embeddings"
FK_SUB_SQL = fk_sql(_SUBS, f"CASE WHEN kx = 0 THEN 1 ELSE {_RAMP.format(f'({_V} - 1300) / 400')} END")

QUERIES = {
    "moveout_nmo": (nmo, SAMPLES + _NMO),
    "moveout_nmo_sinc": (nmo_sinc, SAMPLES + _NMO_SINC),
    "moveout_inverse": (nmo_there_and_back, None),
    "moveout_sample_at": (at_times, SAMPLES + ", p AS (SELECT trace_index, greatest(0, least(62.999::DOUBLE, (trace_index % 70 * 19e-1 - 3) / 2)) AS p FROM t) SELECT p.trace_index, round(x.a + (y.a - x.a) * (p - floor(p)), 6) + 0.0 AS a FROM p JOIN e x ON x.trace_index = p.trace_index AND x.s = floor(p) JOIN e y ON y.trace_index = p.trace_index AND y.s = floor(p) + 1"),
    "moveout_table": (looked_up, HEADERS + _TABLE),
    "physics_vti_times": (anisotropic, HEADERS + _VTI),
    "physics_apertures": (apertures, HEADERS + _APERTURES),
    "aperture_depth_groups": (grouped_depths, _DEPTHS),
    "image_trace_estimates": (estimates, HEADERS + " SELECT CAST(floor(rx / 500) AS BIGINT) AS cx, CAST(floor(ry / 500) AS BIGINT) AS cy, count(*) AS n FROM h GROUP BY 1, 2"),
    "sql_explode_samples": (by_sql, "SELECT vec_id AS trace_index, CAST(unnest(range(64)) AS BIGINT) AS s, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS a FROM embeddings"),
    "dsp_bands": (bands, None),
    "dsp_fk_sub_gathers": (fk_by_sub_gather, FK_SUB_SQL),
}
