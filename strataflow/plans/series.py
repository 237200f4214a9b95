"""Queries over embeddings as traces: expressions on samples, stacks, velocity and imaging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import grids, imaging, stacking, velocity
from strataflow.operators import traces as X
from strataflow.plans.stacks import EXPLODED_SQL, traces

#: Offsets follow from the trace number.
OFFSET = "vec_id % 40 * 50"


def with_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).withColumn("offset", (F.col("trace_index") % 40 * 50).cast("double"))


def flat(df: DataFrame) -> DataFrame:
    return df.select("trace_index", F.posexplode("samples").alias("s", "a")).select("trace_index", F.col("s").cast("long").alias("s"), (F.round(F.col("a").cast("double"), 6) + 0.0).alias("a"))


def mapped(f):
    return lambda s, d: flat(with_offset(s, d).select("trace_index", f(F.col("samples"), F.col("offset")).alias("samples")))


SAMPLES = "WITH t AS (SELECT vec_id AS trace_index, label AS gather, CAST(" + OFFSET + " AS DOUBLE) AS o, embedding AS samples FROM embeddings), e AS (SELECT trace_index, gather, o, CAST(unnest(range(len(samples))) AS BIGINT) AS s, CAST(unnest(samples) AS DOUBLE) AS a FROM t)"
OUT = " SELECT trace_index, s, round({}, 6) + 0.0 AS a FROM "
_MUTE = "CAST(floor(abs(o) / 2.0 / 2.0) AS BIGINT)"
_TOP = f"CASE WHEN s < {_MUTE} THEN 0 WHEN s < {_MUTE} + 8 THEN 0.5 * (1 - cos(pi() * (s - {_MUTE}) / 7)) ELSE 1 END"
_BOTTOM = f"CASE WHEN s >= {_MUTE} THEN 0 WHEN s >= {_MUTE} - 8 THEN 0.5 * (1 - cos(pi() * ({_MUTE} - 1 - s) / 7)) ELSE 1 END"
_AGC = f""", m AS (SELECT gather, greatest(0.001 * sqrt(avg(a * a)), 1e-10) AS steady FROM e GROUP BY gather),
x AS (SELECT e.trace_index, e.s, CASE WHEN k < 0 THEN -k - 1 WHEN k > 63 THEN 127 - k ELSE k END AS k FROM (SELECT trace_index, s, unnest(range(s - 5, s + 6)) AS k FROM e) e),
w AS (SELECT x.trace_index, x.s, sum(y.a * y.a) / 11 AS p FROM x JOIN e y ON x.trace_index = y.trace_index AND x.k = y.s GROUP BY ALL)"""
_NMO = """, n AS (SELECT e.*, s * 0.002 AS t0, sqrt(s * 0.002 * (s * 0.002) + (o / 20000.0) * (o / 20000.0)) AS t FROM e), q AS (SELECT *, CAST(floor(t / 0.002) AS BIGINT) AS k, t / 0.002 - floor(t / 0.002) AS part FROM n)
SELECT q.trace_index, q.s, round(CASE WHEN k > 63 OR (k = 63 AND part > 0) OR (CASE WHEN t0 > 0 THEN t / t0 > 1.5 ELSE q.o <> 0 END) THEN 0 ELSE x.a + (coalesce(y.a, 0) - x.a) * part END, 6) + 0.0 AS a
FROM q LEFT JOIN e x ON q.trace_index = x.trace_index AND x.s = k LEFT JOIN e y ON q.trace_index = y.trace_index AND y.s = k + 1"""


def measures(s, d):
    a = F.col("samples")
    return traces(s, d).select("trace_index", F.round(X.energy(a), 6).alias("energy"), F.round(X.rms(a), 6).alias("rms"), X.live_count(a).cast("long").alias("n_live"))


def _stacked(df: DataFrame) -> DataFrame:
    return df.select("gather", F.col("sample_index").cast("long").alias("sample_index"), (F.round("stack", 6) + 0.0).alias("stack"), "fold")


def gained(s, d):
    return traces(s, d).select("trace_index", "gather", F.transform("samples", lambda x: x * 0.5).alias("samples"))


def noise(s, d):
    out = stacking.stack_noise(traces(s, d), gained(s, d), "gather")
    return out.select("gather", F.col("sample_index").cast("long").alias("sample_index"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("before", "after", "noise", "difference")])


def knots(s: SparkSession, d: str) -> DataFrame:
    """A velocity function for each customer's nation: t from the key, v rising with it."""
    k = F.col("c_custkey")
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("id"), (k / 100).alias("t"), (1500 + k % 97 * 10 + k / 2).alias("v"))


_KNOTS = "WITH k AS (SELECT CAST(c_nationkey AS BIGINT) AS id, c_custkey / 100.0 AS t, 1500 + c_custkey % 97 * 10 + c_custkey / 2.0 AS v FROM customer)"


def points(s, d):
    k = F.col("s_suppkey")
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").cast("long").alias("id"), (k / 7).alias("t"), F.col("s_suppkey").alias("point"))


def asof(s, d):
    return velocity.interpolate(points(s, d), knots(s, d)).select("id", "point", F.round("v", 6).alias("v"))


_ASOF = _KNOTS + """, p AS (SELECT CAST(s_nationkey AS BIGINT) AS id, s_suppkey / 7.0 AS t, s_suppkey AS point FROM supplier),
x AS (SELECT p.*, (SELECT max(k.t) FROM k WHERE k.id = p.id AND k.t <= p.t) AS t1, (SELECT min(k.t) FROM k WHERE k.id = p.id AND k.t >= p.t) AS t2 FROM p)
SELECT x.id, point, round(coalesce(a.v + (b.v - a.v) * coalesce((x.t - t1) / nullif(t2 - t1, 0), 0), a.v, b.v), 6) AS v FROM x LEFT JOIN k a ON a.id = x.id AND a.t = t1 LEFT JOIN k b ON b.id = x.id AND b.t = t2"""


def survey(s, d):
    t = F.col("trace_index")
    return traces(s, d).select((t % 20 * 25.0).alias("tx"), (F.floor(t / 20) * 25.0).alias("ty"), (t % 40 * 50.0).alias("offset"), "samples")


#: An RMS velocity function: knots of time in seconds and velocity.
RMS = ((0.0, 1800.0), (0.64, 2400.0))
SPACING = (50.0, 50.0)
DEPTHS = [40.0 * k for k in range(1, 17)]


def image(s, d):
    """A fixed image area, as in its SQL: only traces within its aperture reach it. image_survey images the whole survey."""
    return imaged(survey(s, d), imaging.Grid((0.0, 0.0), SPACING, (10, 8)), 2000.0)


def image_survey(velocity):
    """The whole survey: the image area is that of its midpoints."""

    def query(s, d):
        t = survey(s, d)
        return imaged(t, imaging.survey_grid(t, SPACING), velocity)

    return query


def imaged(traces: DataFrame, grid: imaging.Grid, velocity) -> DataFrame:
    out = imaging.migrate(traces, grid, velocity, 0.02, 64, 120.0, 45.0)
    return out.select("il", "xl", "t_index", (F.round(F.col("image") * 1e6, 3) + 0.0).alias("image"), "fold")


def shots(s, d):
    """The survey with sources and receivers up to 150 m apart."""
    half = F.col("trace_index") % 4 * 25.0
    t = traces(s, d).select("trace_index", *[c.alias(n) for n, c in (("tx", F.col("trace_index") % 20 * 25.0), ("ty", F.floor(F.col("trace_index") / 20) * 25.0))], "samples")
    return t.select("tx", "ty", (F.col("tx") - half).alias("sx"), F.col("ty").alias("sy"), (F.col("tx") + half).alias("rx"), F.col("ty").alias("ry"), "samples")


def image_depth(gradient):
    def query(s, d):
        t = shots(s, d)
        out = imaging.migrate_depth(t, imaging.survey_grid(t, SPACING), DEPTHS, 2000.0, 0.02, 160.0, 60.0, gradient)
        return out.select("il", "xl", "z_index", (F.round(F.col("image") * 1e4, 3) + 0.0).alias("image"), "fold")

    return query


_TRACES = "WITH t AS (SELECT vec_id % 20 * 25.0 AS tx, floor(vec_id / 20.0) * 25.0 AS ty, vec_id % 40 * 50.0 AS o, vec_id % 4 * 25.0 AS half, embedding AS samples FROM embeddings),"
_FIXED = "g AS (SELECT range // 8 AS il, range % 8 AS xl, range // 8 * 50.0 AS x, range % 8 * 50.0 AS y FROM range(80)),"
_WHOLE = """b AS (SELECT min(tx) AS x0, min(ty) AS y0, CAST(ceil((max(tx) - min(tx)) / 50) AS BIGINT) + 1 AS nx, CAST(ceil((max(ty) - min(ty)) / 50) AS BIGINT) + 1 AS ny FROM t),
i AS (SELECT x0, y0, ny, unnest(range(nx)) AS il FROM b),
j AS (SELECT x0, y0, il, unnest(range(ny)) AS xl FROM i),
g AS (SELECT il, xl, il * 50.0 + x0 AS x, xl * 50.0 + y0 AS y FROM j),"""
_TIME = """
p AS (SELECT il, xl, sqrt((x - tx) ** 2 + (y - ty) ** 2) AS d, o, samples FROM g JOIN t ON tx BETWEEN x - 120 AND x + 120 AND (x - tx) ** 2 + (y - ty) ** 2 <= 14400),
e AS (SELECT il, xl, d, o, unnest(range(len(samples))) AS i, CAST(unnest(samples) AS DOUBLE) AS a FROM p),
f AS (SELECT *, {} AS v FROM e),
q AS (SELECT *, sqrt(i * 2e-2 * (i * 2e-2) + 4 * (d * d + o * o / 4) / (v * v)) AS t FROM f),
w AS (SELECT *, v * t / 2 AS z FROM q)
SELECT il, xl, CAST(floor(t / 2e-2 + 1e-6) AS BIGINT) AS t_index,
  round(sum(a * z / (sqrt(z * z + d * d) * (z * z + d * d) + 1e-10)) / count(*) * 1e6, 3) + 0.0 AS image, count(*) AS fold
FROM w WHERE t / 2e-2 < 64 - 0.001 AND t > 0 AND d < 120 AND d < z * tan(radians(45)) GROUP BY il, xl, floor(t / 2e-2 + 1e-6)"""
_RMS = "1800 + least(i * 2e-2, 0.64) * (600 / 0.64)"
_DEPTH = """
p AS (SELECT il, xl, (x - tx + half) ** 2 + (y - ty) ** 2 AS hs, (x - tx - half) ** 2 + (y - ty) ** 2 AS hr, samples FROM g JOIN t ON ty BETWEEN y - 160 AND y + 160),
n AS (SELECT *, unnest(range(16)) AS z_index FROM p WHERE sqrt(hs) < 160 AND sqrt(hr) < 160),
r AS (SELECT *, (z_index + 1) * 40.0 AS z, sqrt(hs + z * z) AS rs, sqrt(hr + z * z) AS rr FROM n),
q AS (SELECT *, greatest(0, least(({}) / 2e-2, len(samples) - 1.001)) AS k FROM r WHERE atan2(sqrt(hs), z + 1e-6) < radians(60) AND atan2(sqrt(hr), z + 1e-6) < radians(60)),
a AS (SELECT *, CAST(samples[CAST(floor(k) AS BIGINT) + 1] AS DOUBLE) AS low, CAST(samples[CAST(floor(k) AS BIGINT) + 2] AS DOUBLE) AS high FROM q)
SELECT il, xl, z_index, round(sum((low + (k - floor(k)) * (high - low)) * (z / (rs + 1e-6)) * (z / (rr + 1e-6)) / (rs * rr + 1e-6)) * 1e4, 3) + 0.0 AS image, count(*) AS fold
FROM a GROUP BY il, xl, z_index"""
_STRAIGHT = "(rs + rr) / 2000.0"
_CURVED = "(acosh(1 + 0.25 * rs * rs / (4000.0 * (2000 + 0.5 * z))) + acosh(1 + 0.25 * rr * rr / (4000.0 * (2000 + 0.5 * z)))) / 0.5"


def nmo_stacked(s, d):
    t = with_offset(s, d)
    return _stacked(stacking.stack(t.select("gather", X.nmo(F.col("samples"), F.col("offset"), 20000.0, 0.002).alias("samples")), "gather"))


_LIVE = "FILTER (WHERE abs(a) > 1e-30)"
_STACK = "SELECT gather, s AS sample_index, round(coalesce({}, 0), 6) + 0.0 AS stack, count(*) FILTER (WHERE abs(a) > 1e-30) AS fold FROM {} GROUP BY gather, s"

QUERIES = {
    "trace_gain": (mapped(lambda a, o: X.gain(a, 2.5)), SAMPLES + OUT.format("a * 2.5") + "e"),
    "trace_mute_top": (mapped(lambda a, o: X.mute(a, o, 2000.0, 2.0, top=True, taper=8)), SAMPLES + OUT.format(f"a * {_TOP}") + "e"),
    "trace_mute_bottom": (mapped(lambda a, o: X.mute(a, o, 2000.0, 2.0, bottom=True, taper=8)), SAMPLES + OUT.format(f"a * {_BOTTOM}") + "e"),
    "trace_mute_both": (mapped(lambda a, o: X.mute(a, o, 2000.0, 2.0, top=True, bottom=True, taper=8)), SAMPLES + OUT.format(f"a * {_TOP} * {_BOTTOM}") + "e"),
    "trace_agc": (lambda s, d: flat(X.agc(traces(s, d), 5)), SAMPLES + _AGC + " SELECT e.trace_index, e.s, round(a / (sqrt(p) + steady), 6) + 0.0 AS a FROM e JOIN w USING (trace_index, s) JOIN m USING (gather)"),
    "trace_remove_agc": (mapped(lambda a, o: X.remove_agc(X.doubles(a), F.transform(X.doubles(a), lambda x: x * x + 1))), SAMPLES + OUT.format("a / (a * a + 1 + 1e-10)") + "e"),
    "trace_autocorrelation": (mapped(lambda a, o: X.autocorrelation(a, 10)), SAMPLES + " SELECT x.trace_index, y.s - x.s AS s, round(sum(x.a * y.a) / 64, 6) + 0.0 AS a FROM e x JOIN e y ON x.trace_index = y.trace_index AND y.s - x.s BETWEEN 0 AND 10 GROUP BY 1, 2"),
    "trace_nmo": (mapped(lambda a, o: X.nmo(a, o, 20000.0, 0.002)), SAMPLES + _NMO),
    "trace_measures": (measures, SAMPLES + " SELECT trace_index, round(sum(a * a), 6) AS energy, round(sqrt(avg(a * a)), 6) AS rms, count(*) FILTER (WHERE abs(a) > 1e-30) AS n_live FROM e GROUP BY trace_index"),
    "trace_difference": (lambda s, d: flat(grids.difference(traces(s, d), gained(s, d))), SAMPLES + OUT.format("a - CAST(CAST(a AS FLOAT) * 0.5 AS DOUBLE)") + "e"),
    "stack_weighted": (lambda s, d: _stacked(stacking.weighted_stack(with_offset(s, d), "gather")), SAMPLES + ", f AS (SELECT e.*, 1 - 0.5 * o / nullif(max(o) OVER (PARTITION BY gather), 0) AS w FROM e) " + _STACK.format(f"sum(w * a) {_LIVE} / sum(w) {_LIVE}", "f")),
    "stack_min_fold": (lambda s, d: _stacked(stacking.stack(traces(s, d), "gather", min_fold=50)), EXPLODED_SQL + f" SELECT gather, sample_index, round(CASE WHEN count(*) {_LIVE} < 50 THEN 0 ELSE avg(a) {_LIVE} END, 6) + 0.0 AS stack, count(*) {_LIVE} AS fold FROM s GROUP BY ALL"),
    "stack_nmo": (nmo_stacked, SAMPLES + _NMO.replace("SELECT q.trace_index, q.s,", ", z AS (SELECT q.gather, q.s,").replace("round(CASE", "CASE").replace("END, 6) + 0.0 AS a", "END AS a") + ") " + _STACK.format(f"avg(a) {_LIVE}", "z")),
    "stack_summary": (lambda s, d: stacking.stack_summary(with_offset(s, d), "gather").select("gather", "n_traces", F.round("mean_offset", 6).alias("mean_offset"), F.round("rms", 6).alias("rms")), SAMPLES + f", m AS (SELECT gather, s, coalesce(avg(a) {_LIVE}, 0) AS m FROM e GROUP BY ALL), r AS (SELECT gather, sqrt(avg(m * m)) AS rms FROM m GROUP BY gather) SELECT gather, count(*) AS n_traces, round(avg(o), 6) AS mean_offset, round(any_value(rms), 6) AS rms FROM t JOIN r USING (gather) GROUP BY gather"),
    "stack_noise": (noise, SAMPLES + f", p AS (SELECT gather, s, coalesce(avg(a) {_LIVE}, 0) AS b, coalesce(avg(CAST(CAST(a AS FLOAT) * 0.5 AS DOUBLE)) {_LIVE}, 0) AS f FROM e GROUP BY ALL) SELECT gather, s AS sample_index, round(b, 6) + 0.0 AS before, round(f, 6) + 0.0 AS after, round(b - f, 6) + 0.0 AS noise, round(f - b, 6) + 0.0 AS difference FROM p"),
    "velocity_rms_to_interval": (lambda s, d: velocity.rms_to_interval(knots(s, d)).select("id", "t", F.round("v_interval", 6).alias("v_interval")), _KNOTS + ", q AS (SELECT *, (v * v * t - lag(v * v * t) OVER w) / (t - lag(t) OVER w) AS q FROM k WINDOW w AS (PARTITION BY id ORDER BY t)) SELECT id, t, round(CASE WHEN q > 0 THEN sqrt(q) ELSE v END, 6) AS v_interval FROM q"),
    "velocity_interval_to_rms": (lambda s, d: velocity.interval_to_rms(knots(s, d)).select("id", "t", F.round("v_rms", 6).alias("v_rms")), _KNOTS + ", q AS (SELECT *, v * v * (t - coalesce(lag(t) OVER (PARTITION BY id ORDER BY t), 0)) AS p FROM k) SELECT id, t, round(coalesce(sqrt(sum(p) OVER (PARTITION BY id ORDER BY t) / nullif(t, 0)), v), 6) AS v_rms FROM q"),
    "velocity_interpolate": (asof, _ASOF),
    "velocity_effective": (lambda s, d: velocity.effective(knots(s, d)).select("id", "z", F.round("v", 6).alias("v")), _KNOTS + ", q AS (SELECT *, (t - lag(t) OVER w) * (1 / v + 1 / lag(v) OVER w) / 2 AS p FROM k WINDOW w AS (PARTITION BY id ORDER BY t)) SELECT id, t AS z, round(coalesce(t / nullif(sum(p) OVER (PARTITION BY id ORDER BY t), 0), v), 6) AS v FROM q"),
    "image_migrate": (image, _TRACES + _FIXED + _TIME.format("2e3")),
    "image_survey": (image_survey(2000.0), _TRACES + _WHOLE + _TIME.format("2e3")),
    "image_survey_rms": (image_survey(RMS), _TRACES + _WHOLE + _TIME.format(_RMS)),
    "image_depth": (image_depth(0.0), _TRACES + _WHOLE + _DEPTH.format(_STRAIGHT)),
    "image_depth_gradient": (image_depth(0.5), _TRACES + _WHOLE + _DEPTH.format(_CURVED)),
}
