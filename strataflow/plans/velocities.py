"""Queries of velocities in two and three dimensions, and of picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import velocity


def nodes(s: SparkSession, d: str, three: bool) -> DataFrame:
    """A grid over nations and regions, in three dimensions also over a part of the suppliers."""
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    rows = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey").join(s.read.parquet(f"{d}/region.parquet").select("r_regionkey"))
    rows = rows.select((n * 0.2).alias("z"), (r * 500.0).alias("x"), (1500 + n * 40.0 + r * 30.0 + (n * 7 + r * 13) % 11 * 10.0).alias("v"))
    if not three:
        return rows
    y = s.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") % 4 * 300.0).alias("y")).distinct()
    return rows.join(y).select("z", "x", "y", (F.col("v") + F.col("y") / 10 * F.col("z")).alias("v"))


def points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", (k % 600 / 100.0 - 0.5).alias("z"), (k * 7 % 3000 - 400.0).alias("x"), (k * 11 % 1300 - 200.0).alias("y"))


def at_points(axes: tuple[str, ...]):
    def query(s, d):
        return velocity.at_points(points(s, d), nodes(s, d, len(axes) == 3), axes).select("c_custkey", F.round("v", 6).alias("v"))

    return query


def _sql(three: bool) -> str:
    """Each axis' cell by its numbers, as the axes are regular here; corners by joins."""
    y_node = ", y AS (SELECT DISTINCT s_suppkey % 4 AS k FROM supplier)" if three else ""
    plus = " + k * 30.0 * (n_nationkey * 0.2)" if three else ""
    axes = [("z", 0.2, 23), ("x", 500.0, 3)] + ([("y", 300.0, 2)] if three else [])
    cell = ", ".join(f"CAST(greatest(0, least({last}, floor({a} / {step} + 1e-9))) AS BIGINT) AS i{a}" for a, step, last in axes)
    share = ", ".join(f"{a} / {step} - i{a} AS s{a}" for a, step, _ in axes)
    weight = " * ".join(f"CASE WHEN c{a} = 1 THEN s{a} ELSE 1 - s{a} END" for a, _, _ in axes)
    corner = ", ".join(f"range(2) t{a}(c{a})" for a, _, _ in axes)
    meets = " AND ".join(f"g.{a} = q.i{a} + c{a}" for a, _, _ in axes)
    return f"""WITH p AS (SELECT c_custkey, c_custkey % 600 / 100.0::DOUBLE - 0.5 AS z, c_custkey * 7 % 3000 - 400.0::DOUBLE AS x, c_custkey * 11 % 1300 - 200.0::DOUBLE AS y FROM customer){y_node},
g AS (SELECT n_nationkey AS z, r_regionkey AS x{", k AS y" if three else ""}, 1500 + n_nationkey * 40.0::DOUBLE + r_regionkey * 30.0 + (n_nationkey * 7 + r_regionkey * 13) % 11 * 10.0{plus} AS v FROM nation, region{", y" if three else ""}),
c AS (SELECT *, {cell} FROM p), q AS (SELECT *, {share} FROM c)
SELECT c_custkey, round(sum({weight} * g.v), 6) AS v FROM q, {corner}, g WHERE {meets} GROUP BY c_custkey"""


def picks(s, d) -> DataFrame:
    k = F.col("s_suppkey")
    return s.read.parquet(f"{d}/supplier.parquet").select((F.col("s_nationkey") * 10).cast("long").alias("cdp"), (k / 50).alias("t"), (1500 + k % 89 * 10 + k * 2.0).alias("v"))


def picked(s, d):
    times = s.read.parquet(f"{d}/region.parquet").select((F.col("r_regionkey") * 0.4 + 0.1).alias("t"))
    cdps = s.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 260 - 5).cast("long").alias("cdp")).distinct()
    return velocity.from_picks(picks(s, d), times, cdps).select("cdp", F.round("t", 6).alias("t"), F.round("v", 6).alias("v"))


_PICKS = "WITH k AS (SELECT CAST(s_nationkey * 10 AS BIGINT) AS cdp, s_suppkey / 50.0::DOUBLE AS t, 1500 + s_suppkey % 89 * 10 + s_suppkey * 2.0::DOUBLE AS v FROM supplier)"
PICKS_SQL = (
    _PICKS
    + """, w AS (SELECT r_regionkey * 0.4::DOUBLE + 0.1 AS t FROM region), l AS (SELECT DISTINCT cdp FROM k),
p AS (SELECT l.cdp, w.t, (SELECT max(k.t) FROM k WHERE k.cdp = l.cdp AND k.t <= w.t) AS a, (SELECT min(k.t) FROM k WHERE k.cdp = l.cdp AND k.t >= w.t) AS b FROM l, w),
f AS (SELECT p.cdp, p.t, coalesce(x.v + (y.v - x.v) * coalesce((p.t - a) / nullif(b - a, 0), 0), x.v, y.v) AS v FROM p LEFT JOIN k x ON x.cdp = p.cdp AND x.t = a LEFT JOIN k y ON y.cdp = p.cdp AND y.t = b),
c AS (SELECT DISTINCT CAST(c_custkey % 260 - 5 AS BIGINT) AS cdp FROM customer),
q AS (SELECT c.cdp, w.t, (SELECT max(cdp) FROM l WHERE l.cdp <= c.cdp) AS a, (SELECT min(cdp) FROM l WHERE l.cdp >= c.cdp) AS b FROM c, w)
SELECT q.cdp, round(q.t, 6) AS t, round(coalesce(x.v + (y.v - x.v) * coalesce((q.cdp - a) / nullif(b - a, 0)::DOUBLE, 0), x.v, y.v), 6) AS v FROM q LEFT JOIN f x ON x.cdp = a AND x.t = q.t LEFT JOIN f y ON y.cdp = b AND y.t = q.t"""
)


def summed(s, d):
    out = velocity.summary(picks(s, d), ["cdp"])
    return out.select("cdp", "n", *[F.round(c, 5).alias(c) for c in out.columns[2:]])


SUMMARY_SQL = _PICKS + " SELECT cdp, count(*) AS n, round(min(t), 5) AS t_min, round(max(t), 5) AS t_max, round(min(v), 5) AS v_min, round(max(v), 5) AS v_max, round(avg(v), 5) AS v_mean, CASE WHEN count(*) > 1 THEN round(regr_slope(v, t), 5) END AS gradient FROM k GROUP BY cdp"
QUERIES = {
    "velocity_2d": (at_points(("z", "x")), _sql(False)),
    "velocity_3d": (at_points(("z", "x", "y")), _sql(True)),
    "velocity_from_picks": (picked, PICKS_SQL),
    "velocity_summary": (summed, SUMMARY_SQL),
}
