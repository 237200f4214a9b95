"""Queries over lineitem as trace headers: coordinates, offsets, scalars and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import geometry as G
from strataflow.functions import headers as H
from strataflow.functions import physics as P

#: Integer-derived coordinates; the same text serves both engines.
_COLUMNS = {
    "k": "l_orderkey",
    "n": "l_linenumber",
    "part": "l_partkey",
    "supp": "l_suppkey",
    "sx": "CAST(l_orderkey % 1000 AS DOUBLE) * 25.0",
    "sy": "CAST(l_suppkey % 100 AS DOUBLE) * 12.5",
    "rx": "CAST(l_partkey % 1000 AS DOUBLE) * 25.0 + 3.0",
    "ry": "CAST(l_linenumber AS DOUBLE) * 50.0",
    "scalar": "CASE l_linenumber % 3 WHEN 0 THEN -10 WHEN 1 THEN 4 ELSE 0 END",
}
SQL = "WITH h AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM lineitem)"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} AS {n}" for n, e in _COLUMNS.items()])


def _four():
    return F.col("sx"), F.col("sy"), F.col("rx"), F.col("ry")


def _r(c, name: str):
    return (F.round(c, 6) + 0.0).alias(name)


def scalars(s, d):
    return headers(s, d).select("k", "n", "part", _r(G.apply_scalar(F.col("sx"), F.col("scalar")), "x"))


def offsets(s, d):
    return headers(s, d).select("k", "n", "part", _r(G.offset(*_four()), "offset"), _r(G.azimuth(*_four()), "azimuth"), _r(G.signed_offset(*_four(), 30.0), "signed_offset"))


OFFSET_SQL = "sqrt((rx - sx) * (rx - sx) + (ry - sy) * (ry - sy))"
AZIMUTH_SQL = "CASE WHEN degrees(atan2(rx - sx, ry - sy)) < 0 THEN degrees(atan2(rx - sx, ry - sy)) + 360 ELSE degrees(atan2(rx - sx, ry - sy)) END"


def lines(s, d):
    x, y = G.midpoint(F.col("sx"), F.col("rx")), G.midpoint(F.col("sy"), F.col("ry"))
    il, xl = G.inline_xline(x, y, (100.0, 50.0), (30.0, 20.0), 30.0, (10, 5))
    bx, by = G.cdp_of(F.col("il"), F.col("xl"), (100.0, 50.0), (30.0, 20.0), 30.0, (10, 5))
    return headers(s, d).select("k", "n", "part", _r(x, "cdp_x"), _r(y, "cdp_y"), il.alias("il"), xl.alias("xl")).select("*", _r(bx, "back_x"), _r(by, "back_y"))


_LINES_SQL = """, m AS (SELECT *, (sx + rx) / 2 AS cx, (sy + ry) / 2 AS cy FROM h),
l AS (SELECT *, CAST(round_even(((cx - 100) * sin(radians(30)) + (cy - 50) * cos(radians(30))) / 30, 0) AS BIGINT) + 10 AS il, CAST(round_even(((cx - 100) * cos(radians(30)) - (cy - 50) * sin(radians(30))) / 20, 0) AS BIGINT) + 5 AS xl FROM m)
SELECT k, n, part, round(cx, 6) + 0.0 AS cdp_x, round(cy, 6) + 0.0 AS cdp_y, il, xl, round((il - 10) * 30.0 * sin(radians(30)) + (xl - 5) * 20.0 * cos(radians(30)) + 100, 6) + 0.0 AS back_x, round((il - 10) * 30.0 * cos(radians(30)) - (xl - 5) * 20.0 * sin(radians(30)) + 50, 6) + 0.0 AS back_y FROM l"""


def distances(s, d):
    sx, sy, rx, ry = _four()
    z = F.col("n") * 10.0
    return headers(s, d).select("k", "n", "part", _r(G.distance_3d(sx, sy, F.lit(0.0), rx, ry, z), "distance"), _r(G.angle_from_vertical(G.offset(sx, sy, rx, ry), z), "angle"))


def turned(s, d):
    x, y = G.rotate(F.col("sx"), F.col("sy"), 25.0, (10.0, 20.0))
    u, v = G.scale(F.col("sx"), F.col("sy"), 0.5, (10.0, 20.0))
    return headers(s, d).select("k", "n", "part", _r(x, "x"), _r(y, "y"), _r(u, "u"), _r(v, "v"))


def bins(s, d):
    ix, iy, far = G.world_to_bin(F.col("rx"), F.col("ry"), (5.0, 7.0), (110.0, 35.0), 20.0)
    x, y = G.bin_to_world(F.col("ix"), F.col("iy"), (5.0, 7.0), (110.0, 35.0), 20.0)
    return headers(s, d).select("k", "n", "part", ix.alias("ix"), iy.alias("iy"), _r(far, "far")).select("*", _r(x, "x"), _r(y, "y"))


_BINS_SQL = """, u AS (SELECT *, (rx - 5) * cos(radians(20)) + (ry - 7) * sin(radians(20)) AS u, (ry - 7) * cos(radians(20)) - (rx - 5) * sin(radians(20)) AS v FROM h),
b AS (SELECT *, CAST(floor(u / 110) AS BIGINT) AS ix, CAST(floor(v / 35) AS BIGINT) AS iy FROM u)
SELECT k, n, part, ix, iy, round(sqrt((u - (ix + 0.5) * 110) ** 2 + (v - (iy + 0.5) * 35) ** 2), 6) + 0.0 AS far,
round((ix + 0.5) * 110 * cos(radians(20)) - (iy + 0.5) * 35 * sin(radians(20)) + 5, 6) + 0.0 AS x, round((ix + 0.5) * 110 * sin(radians(20)) + (iy + 0.5) * 35 * cos(radians(20)) + 7, 6) + 0.0 AS y FROM b"""


def grid(s, d):
    il, xl, valid = G.grid_index(F.col("rx"), F.col("ry"), (50.0, 20.0), (30.0, 300.0), (200, 60), 90.0)
    return headers(s, d).select("k", "n", "part", il.alias("il"), xl.alias("xl"), valid.alias("valid"))


_GRID_SQL = """, g AS (SELECT *, CAST(round_even(((rx - 50) * sin(radians(90)) + (ry - 20) * cos(radians(90))) / 30, 0) AS BIGINT) AS i, CAST(round_even(((rx - 50) * cos(radians(90)) - (ry - 20) * sin(radians(90))) / 300, 0) AS BIGINT) AS x FROM h)
SELECT k, n, part, greatest(0, least(199, i)) AS il, greatest(0, least(59, x)) AS xl, i BETWEEN 0 AND 199 AND x BETWEEN 0 AND 59 AS valid FROM g"""


def units(s, d):
    x = F.col("sx")
    return headers(s, d).select("k", "n", "part", _r(G.to_feet(x), "feet"), _r(G.to_metres(x), "metres"), _r(G.wavenumber_to_feet(x), "wavenumber"), _r(G.decibels(x), "db"))


def mapped(s, d):
    mapping = {"a": ("sx", "scale:0.5"), "b": ("sy", "offset:-3"), "c": ("scalar", "negate"), "d": ("scalar", "abs"), "e": ("rx", "unknown"), "f": ("nothing", None), "k": ("k", None), "n": ("n", None), "part": ("part", None)}
    return H.apply_mapping(headers(s, d), mapping)


def computed(s, d):
    expressions = {"late": "early * 2 + n", "early": "(sx - rx) / (n - 2)", "odd": "sqrt(sx - 500) + atan2(sy, ry)", "half": "round(n / 2)", "low": "min(sx, rx, 900)", "rest": "k % 7 - floor(part / 3)"}
    df = H.computed(headers(s, d), expressions, {"half": "i"})
    return df.select("k", "n", "part", *[_r(F.col(c), c) for c in ("early", "late", "odd", "low", "rest")], "half")


_COMPUTED_SQL = """, e AS (SELECT *, coalesce((sx - rx) / nullif(CAST(n - 2 AS DOUBLE), 0), 0.0) AS early FROM h)
SELECT k, n, part, round(early, 6) + 0.0 AS early, round(early * 2 + n, 6) + 0.0 AS late, round(CASE WHEN sx >= 500 THEN sqrt(sx - 500) + atan2(sy, ry) ELSE 0 END, 6) + 0.0 AS odd,
round(least(sx, rx, 900), 6) + 0.0 AS low, round(k % 7 - floor(part / 3.0), 6) + 0.0 AS rest, CAST(round_even(n / 2.0, 0) AS BIGINT) AS half FROM e"""


def matched(s, d):
    df = headers(s, d).select(F.col("sx").alias("SourceX"), F.col("rx").alias("GX"), F.col("k").alias("ENSEMBLE"))
    return H.select_matched(df, ["source_x", "receiver_x", "cdp"])


def checked(s, d):
    sx, sy, rx, ry = _four()
    o = G.offset(sx, sy, rx, ry)
    return headers(s, d).agg(F.count("*").alias("n_traces"), F.round(F.max(o), 6).alias("max_offset"), F.count_if(o > 20000).alias("n_far"), F.count_if((sx == 0) & (sy == 0)).alias("n_zero_source"), F.min("sx").alias("min_sx"), F.max("rx").alias("max_rx"))


def first_scalar(s, d):
    order = F.struct("k", "n", "part", "supp")
    one = headers(s, d).where("scalar != 0").agg(F.min_by("scalar", order).alias("scalar"))
    return headers(s, d).crossJoin(F.broadcast(one.withColumnRenamed("scalar", "of_all"))).select("k", "n", "part", _r(G.apply_scalar(F.col("sx"), F.col("of_all")), "x"))


def moveout(s, d):
    t0, x, v = F.col("n") * 0.2, F.col("sx") / 10, F.lit(2000.0) + F.col("supp") % 10 * 100
    return headers(s, d).select("k", "n", "part", "supp", _r(P.nmo_time(t0, x, v), "t"), _r(P.stretch(t0, x, v), "stretch"))


def anisotropy(s, d):
    e, dl, v, th = F.col("n") * 0.03, F.col("supp") % 10 * 0.02 - 0.05, F.lit(2500.0), F.radians(F.col("sx") % 90)
    return headers(s, d).select("k", "n", "part", "supp", _r(P.vti_phase_velocity(v, th, e, dl), "phase"), _r(P.vti_nmo_velocity(v, dl), "nmo"), _r(P.vti_horizontal_velocity(v, e), "horizontal"), _r(P.eta(e, dl), "eta"))


def traveltimes(s, d):
    h, z = G.offset(*_four()), F.col("n") * 100.0
    return headers(s, d).select("k", "n", "part", "supp", _r(P.straight_time(F.hypot(h, z), F.lit(2200.0)), "straight"), _r(P.curved_time(h, z, 1800.0, 0.5), "curved"), _r(P.vti_time(h, z / 1000, F.lit(2200.0), F.lit(0.1)), "vti"))


def weights(s, d):
    z, hs, hr = F.col("n") * 500.0, F.col("sx") / 8, F.col("ry")
    rs, rr = F.hypot(hs, z), F.hypot(hr, z)
    return headers(s, d).select("k", "n", "part", F.round(P.image_weight(rs, rr, z, hs, hr, 2000.0, 50.0) * 1e9, 4).alias("kernel"), F.round(P.amplitude_weight("full", rs, rr, z, F.lit(2000.0)) * 1e12, 4).alias("full"), _r(P.amplitude_weight("obliquity", rs, rr, z, F.lit(2000.0)), "obliquity"), _r(P.taper(hs, 2500.0, 0.2), "taper"))


_ANGLE = "tan(radians(50))"
_WEIGHTS_SQL = f""", w AS (SELECT *, n * 500.0 AS z, sx / 8 AS hs, ry AS hr FROM h), r AS (SELECT *, sqrt(hs * hs + z * z) AS rs, sqrt(hr * hr + z * z) AS rr FROM w)
SELECT k, n, part, round(CASE WHEN hs < 2000 AND hr < 2000 AND hs < z * {_ANGLE} AND hr < z * {_ANGLE} THEN z / rs * z / rr / (rs * rr + 1e-6) ELSE 0 END * 1e9, 4) AS kernel,
round(1 / (rs * rr * 2000) * (z / rs + z / rr) / 2 * 1e12, 4) AS "full", round((z / rs + z / rr) / 2, 6) AS obliquity,
round(CASE WHEN hs <= 2000 THEN 1.0 WHEN hs >= 2500 THEN 0.0 ELSE 0.5 * (1 + cos(pi() * (hs - 2000) / 500)) END, 6) AS taper FROM r"""


def antialias(s, d):
    fa = P.alias_frequency(F.lit(2000.0) + F.col("supp") % 10 * 100, F.radians(F.col("sx") % 90), 25.0, 125.0)
    return headers(s, d).select("k", "n", "part", "supp", _r(fa, "fa"), *[_r(P.antialias_weight(m, fa, 80.0), m) for m in ("triangle", "sinc", "grayzone")])


_ANTIALIAS_SQL = """, f AS (SELECT *, least(coalesce((2000.0 + supp % 10 * 100) / nullif(2 * 25.0 * abs(sin(radians(sx % 90))), 0), 125.0), 125.0) AS fa FROM h)
SELECT k, n, part, supp, round(fa, 6) AS fa, round(greatest(0, least(1, fa / 80)), 6) AS triangle, round(sin(pi() / 2 * least(fa / 80, 1)) ** 2, 6) AS sinc,
round(CASE WHEN fa <= 72 THEN 0.0 WHEN fa >= 88 THEN 1.0 ELSE 0.5 * (1 - cos(pi() * (fa - 72) / 16)) END, 6) AS grayzone FROM f"""

QUERIES = {
    "header_scalar": (scalars, SQL + " SELECT k, n, part, round(CASE WHEN scalar < 0 THEN sx / abs(scalar) WHEN scalar > 0 THEN sx * scalar ELSE sx END, 6) + 0.0 AS x FROM h"),
    "header_first_scalar": (first_scalar, SQL + ", s AS (SELECT scalar AS f FROM h WHERE scalar <> 0 ORDER BY k, n, part, supp LIMIT 1) SELECT k, n, part, round(CASE WHEN f < 0 THEN sx / abs(f) ELSE sx * f END, 6) + 0.0 AS x FROM h, s"),
    "header_offset_azimuth": (offsets, SQL + f" SELECT k, n, part, round({OFFSET_SQL}, 6) + 0.0 AS \"offset\", round({AZIMUTH_SQL}, 6) + 0.0 AS azimuth, round(CASE WHEN (rx - sx) * sin(radians(30)) + (ry - sy) * cos(radians(30)) < 0 THEN -1 ELSE 1 END * {OFFSET_SQL}, 6) + 0.0 AS signed_offset FROM h"),
    "header_lines": (lines, SQL + _LINES_SQL),
    "header_distance_angle": (distances, SQL + f" SELECT k, n, part, round(sqrt((rx - sx) ** 2 + (ry - sy) ** 2 + (n * 10.0) ** 2), 6) + 0.0 AS distance, round(degrees(atan2({OFFSET_SQL}, n * 10.0)), 6) + 0.0 AS angle FROM h"),
    "header_rotate_scale": (turned, SQL + " SELECT k, n, part, round((sx - 10) * cos(radians(25)) - (sy - 20) * sin(radians(25)) + 10, 6) + 0.0 AS x, round((sx - 10) * sin(radians(25)) + (sy - 20) * cos(radians(25)) + 20, 6) + 0.0 AS y, round((sx - 10) * 0.5 + 10, 6) + 0.0 AS u, round((sy - 20) * 0.5 + 20, 6) + 0.0 AS v FROM h"),
    "header_world_bin": (bins, SQL + _BINS_SQL),
    "header_grid_index": (grid, SQL + _GRID_SQL),
    "header_units": (units, SQL + " SELECT k, n, part, round(sx * 3.28084, 6) + 0.0 AS feet, round(sx / 3.28084, 6) + 0.0 AS metres, round(sx / 3.28084, 6) + 0.0 AS wavenumber, round(20 * log10(sx + 1e-10), 6) + 0.0 AS db FROM h"),
    "header_mapping": (mapped, SQL + " SELECT k, n, part, sx * 0.5 AS a, sy - 3.0 AS b, -scalar AS c, abs(scalar) AS d, rx AS e FROM h"),
    "header_computed": (computed, SQL + _COMPUTED_SQL),
    "header_alias_match": (matched, SQL + " SELECT sx AS source_x, rx AS receiver_x, k AS cdp FROM h"),
    "header_validate": (checked, SQL + f" SELECT count(*) AS n_traces, round(max({OFFSET_SQL}), 6) AS max_offset, count(*) FILTER (WHERE {OFFSET_SQL} > 20000) AS n_far, count(*) FILTER (WHERE sx = 0 AND sy = 0) AS n_zero_source, min(sx) AS min_sx, max(rx) AS max_rx FROM h"),
    "physics_nmo_stretch": (moveout, SQL + ", m AS (SELECT *, n * 0.2 AS t0, sx / 10 AS x, 2000.0 + supp % 10 * 100 AS v FROM h) SELECT k, n, part, supp, round(sqrt(t0 * t0 + (x / v) * (x / v)), 6) + 0.0 AS t, round(sqrt(t0 * t0 + (x / v) * (x / v)) / nullif(t0, 0), 6) + 0.0 AS stretch FROM m"),
    "physics_anisotropy": (anisotropy, SQL + ", a AS (SELECT *, n * 0.03 AS e, supp % 10 * 0.02 - 0.05 AS dl, radians(sx % 90) AS th FROM h) SELECT k, n, part, supp, round(2500 * (1 + dl * sin(th) ** 2 * cos(th) ** 2 + e * sin(th) ** 4), 6) + 0.0 AS phase, round(2500 * sqrt(greatest(1 + 2 * dl, 0.01)), 6) + 0.0 AS nmo, round(2500 * sqrt(greatest(1 + 2 * e, 0.01)), 6) + 0.0 AS horizontal, round((e - dl) / greatest(1 + 2 * dl, 0.01), 6) + 0.0 AS eta FROM a"),
    "physics_traveltimes": (traveltimes, SQL + f", g AS (SELECT *, {OFFSET_SQL} AS o, n * 100.0 AS z FROM h), q AS (SELECT *, z / 1000 AS t0 FROM g) SELECT k, n, part, supp, round(sqrt(o * o + z * z) / 2200, 6) + 0.0 AS straight, round(acosh(1 + 0.25 * (o * o + z * z) / (2 * 1800.0 * (1800.0 + 0.5 * z))) / 0.5, 6) + 0.0 AS curved, round(sqrt(greatest(t0 * t0 + o * o / 4840000.0 - coalesce(0.2 * o ** 4 / nullif(4840000.0 * (t0 * t0 * 4840000.0 + 1.2 * o * o), 0), 0), 0)), 6) + 0.0 AS vti FROM q"),
    "physics_weights": (weights, SQL + _WEIGHTS_SQL),
    "physics_antialias": (antialias, SQL + _ANTIALIAS_SQL),
}
