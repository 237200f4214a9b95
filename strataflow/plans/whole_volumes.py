"""Queries of whole volumes: velocity cones over volumes of coordinate bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.cones import Cone
from strataflow.operators import volumes
from strataflow.plans.series import flat
from strataflow.plans.stacks import traces

BIN = (50.0, 50.0)
CONE = Cone(v_min=2000.0, v_max=9000.0, taper=0.2, edges="none", f_min=20.0, azimuth_min=300.0, azimuth_max=240.0)


def surveyed(s, d) -> DataFrame:
    t = F.col("trace_index")
    return traces(s, d).select("trace_index", (t % 20 * 25.0).alias("x"), (F.floor(t / 20) * 25.0).alias("y"), "samples")


def coordinates(method: str, representative: str = "mean"):
    def query(s, d):
        rows = surveyed(s, d)
        return flat(volumes.fkk_coordinates(rows, CONE, 0.002, F.col("x"), F.col("y"), BIN, representative=representative, method=method))

    return query


def _transform(source: str, axis: str, length: str, into: str, sign: int, keys: str) -> str:
    """SQL of a Fourier sum of source(keys, axis, re, im) along one axis, as a step of WITH."""
    k = f"2 * pi() * {axis} * k.range / {length}"
    over = f" / any_value({length})" if sign > 0 else ""
    return f"""
{into} AS MATERIALIZED (SELECT {keys}, k.range AS {axis}, sum(re * cos({k}) - im * {sign} * sin({k})){over} AS re, sum(re * {sign} * sin({k}) + im * cos({k})){over} AS im
  FROM {source}, n, range((SELECT {length} FROM n)) k GROUP BY {keys}, k.range),"""


def _cone_sql(cubes: str, out: str, volume: str = "0") -> str:
    """SQL of the cone over cells c(p, ix, iy, s, re, im): three Fourier sums, weights, and the sums back, by one axis after the other."""
    wrapped = lambda axis, length, step: f"(CASE WHEN {axis} * 2 < {length} THEN {axis} ELSE {axis} - {length} END / ({length} * {step}))"
    mirrored = lambda axis, length: f"(CASE WHEN 2 * s > nt THEN ({length} - {axis}) % {length} ELSE {axis} END)"  # noqa: E731  the conjugate half has the weights of its mirror
    f, kx, ky = wrapped("s", "nt", 0.002), wrapped(mirrored("ix", "nx"), "nx", "50.0"), wrapped(mirrored("iy", "ny"), "ny", "50.0")
    ramp = lambda edge: f"(0.5 * (1 - cos(pi() * greatest(0, least(1, (v - {edge} * {1 - CONE.taper}) / ({2 * CONE.taper} * {edge}))))))"
    return f"""{cubes}
n AS MATERIALIZED (SELECT 64 AS nt, CAST(pow(2, ceil(log2(max(ix) + 1))) AS BIGINT) AS nx, CAST(pow(2, ceil(log2(max(iy) + 1))) AS BIGINT) AS ny FROM c),{_transform("c", "s", "nt", "f1", -1, "p, ix, iy")}{_transform("f1", "ix", "nx", "f2", -1, "p, s, iy")}{_transform("f2", "iy", "ny", "f3", -1, "p, s, ix")}
g AS (SELECT p, s, ix, iy, re, im, abs({f}) AS f, {kx} AS kx, {ky} AS ky FROM f3, n),
v AS (SELECT *, f / greatest(sqrt(kx * kx + ky * ky), 1e-10) AS v, CASE WHEN kx = 0 AND ky = 0 THEN 0 ELSE (degrees(atan2(ky, kx)) + 360) % 360 END AS az FROM g),
w AS (SELECT *, CASE WHEN f < {CONE.f_min} OR (kx = 0 AND ky = 0) OR NOT (az >= {CONE.azimuth_min} OR az <= {CONE.azimuth_max}) THEN 1 ELSE 1 - {ramp(CONE.v_min)} * (1 - {ramp(CONE.v_max)}) END AS weight FROM v),
h AS (SELECT p, s, ix, iy, re * weight AS re, im * weight AS im FROM w),{_transform("h", "iy", "ny", "b1", 1, "p, s, ix")}{_transform("b1", "ix", "nx", "b2", 1, "p, s, iy")}{_transform("b2", "s", "nt", "b3", 1, "p, ix, iy")}
{out}"""


_TRACES = """WITH t AS MATERIALIZED (SELECT vec_id AS trace_index, CAST(floor(vec_id % 20 * 25.0 / 50) AS BIGINT) AS ix, CAST(floor(vec_id // 20 * 25.0 / 50) AS BIGINT) AS iy,
  sqrt(pow(vec_id % 20 * 25.0 - (floor(vec_id % 20 * 25.0 / 50) + 0.5) * 50, 2) + pow(vec_id // 20 * 25.0 - (floor(vec_id // 20 * 25.0 / 50) + 0.5) * 50, 2)) AS far, embedding AS e FROM embeddings),
a AS MATERIALIZED (SELECT trace_index, ix, iy, CAST(unnest(range(64)) AS BIGINT) AS s, CAST(unnest(e) AS DOUBLE) AS v FROM t),"""
SUBTRACT_SQL = _cone_sql(
    _TRACES + "\nc AS MATERIALIZED (SELECT 0 AS p, ix, iy, s, avg(v) AS re, 0.0 AS im FROM a GROUP BY ix, iy, s),",
    "q AS (SELECT b3.ix, b3.iy, b3.s, c.re - b3.re AS noise FROM b3 JOIN c USING (ix, iy, s))\nSELECT trace_index, s, round(v - noise, 6) + 0.0 AS a FROM a JOIN q USING (ix, iy, s)",
)
PASSES_SQL = _cone_sql(
    _TRACES
    + """
r AS MATERIALIZED (SELECT trace_index, ix, iy, row_number() OVER (PARTITION BY ix, iy ORDER BY round(far, 9), trace_index) - 1 AS pass, count(*) OVER (PARTITION BY ix, iy) AS fold FROM t),
m AS (SELECT trace_index, ix, iy, pass, k.range AS p FROM r, range((SELECT max(fold) FROM r)) k WHERE k.range = least(k.range, greatest(k.range, pass)) AND (k.range = pass OR (pass = fold - 1 AND k.range > pass))),
c AS MATERIALIZED (SELECT m.p, m.ix, m.iy, a.s, a.v AS re, 0.0 AS im FROM m JOIN a USING (trace_index)),""",
    "SELECT r.trace_index, b3.s, round(b3.re, 6) + 0.0 AS a FROM b3 JOIN r ON b3.p = r.pass AND b3.ix = r.ix AND b3.iy = r.iy",
)

QUERIES = {
    "fkk_coordinates": (coordinates("noise_subtract"), SUBTRACT_SQL),
    "fkk_coordinates_residual": (coordinates("residual_preserve"), SUBTRACT_SQL),
    "fkk_coordinates_passes": (coordinates("multi_pass"), PASSES_SQL),
}
