"""Velocity functions of time or depth as knots (id, t, v): conversions and interpolation.

A function's knots are few beside traces, and in one group by its id; ids are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rms_to_interval(knots: DataFrame, key: str = "id") -> DataFrame:
    """Dix: sqrt of the change of v squared t over that of t; the RMS velocity itself where that is not positive, and at the first knot."""
    w = Window.partitionBy(key).orderBy("t")
    e = F.col("v") * F.col("v") * F.col("t")
    square = F.try_divide(e - F.lag(e).over(w), F.col("t") - F.lag("t").over(w))
    return knots.select(key, "t", "v", F.when(square > 0, F.sqrt(square)).otherwise(F.col("v")).alias("v_interval"))


def interval_to_rms(knots: DataFrame, key: str = "id") -> DataFrame:
    """sqrt of the running sum of v squared dt over t; the interval velocity where t is 0."""
    w = Window.partitionBy(key).orderBy("t")
    part = F.col("v") * F.col("v") * (F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0.0)))
    rows = knots.withColumn("_part", part)
    total = F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, "t", "v", F.coalesce(F.sqrt(F.try_divide(total, "t")), F.col("v")).alias("v_rms"))


def interpolate(points: DataFrame, knots: DataFrame, key: str = "id") -> DataFrame:
    """points(key, t, ...) with v, linear between the knots about t and constant beyond the ends: an as-of join both ways, by one union and a window per key."""
    own = [c for c in points.columns if c not in (key, "t")]
    rows = points.select(key, "t", F.struct(*own).alias("_own") if own else F.lit(None).cast("struct<x:int>").alias("_own"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("_point"))
    both = rows.unionByName(knots.select(key, "t", "v").withColumn("_own", F.lit(None).cast(rows.schema["_own"].dataType)).withColumn("_point", F.lit(0)))
    knot = F.when(F.col("_point") == 0, F.struct("t", "v"))
    back = Window.partitionBy(key).orderBy("t", "_point").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("t"), "_point").rowsBetween(Window.unboundedPreceding, 0)  # a frame to the end would be read anew for each row
    rows = both.withColumn("_a", F.last(knot, True).over(back)).withColumn("_b", F.last(knot, True).over(ahead)).where("_point = 1")
    share = F.try_divide(F.col("t") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    v = F.coalesce(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.coalesce(share, F.lit(0.0)), F.col("_a.v"), F.col("_b.v"))
    return rows.select(key, "t", *[F.col(f"_own.{c}").alias(c) for c in own], v.alias("v"))


def linear(spark, v0: float, gradient: float, end: float, step: float) -> DataFrame:
    """Knots of v0 + gradient t from 0 to end."""
    t = F.col("id") * step
    return spark.range(int(end / step) + 1).select(F.lit(0).alias("id"), t.alias("t"), (v0 + gradient * t).alias("v"))


def layered(spark, layers: list[tuple[float, float]]) -> DataFrame:
    """Knots at the tops and just above the ends of layers (top, v), so that interpolation keeps steps."""
    rows = []
    for (top, v), after in zip(layers, [*layers[1:], None], strict=True):
        rows.append((0, float(top), float(v)))
        if after:
            rows.append((0, float(after[0]) - 1e-6, float(v)))
    return spark.createDataFrame(rows, "id int, t double, v double")


def effective(knots: DataFrame, key: str = "id") -> DataFrame:
    """(key, z, v): z over the traveltime to z, by trapezoids of 1 / v between knots in depth (t is depth here)."""
    w = Window.partitionBy(key).orderBy("t")
    dt = (F.col("t") - F.lag("t").over(w)) * (1 / F.col("v") + 1 / F.lag("v").over(w)) / 2
    rows = knots.withColumn("_dt", dt)
    total = F.sum("_dt").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, F.col("t").alias("z"), F.coalesce(F.try_divide("t", total), F.col("v")).alias("v"))


#: Values of an axis that are sent to workers; more are refused.
MOST_VALUES = 1_000_000


def at_points(points: DataFrame, nodes: DataFrame, axes: tuple[str, ...] = ("z", "x", "y")) -> DataFrame:
    """points(axes, more) with v: linear between the nodes(axes, v) of a grid in up to three dimensions, and beyond its edges as in the last cell.

    Axes are the nodes' distinct values. A node goes to the cells about it, up to eight, whose corners then are one
    row each; a point finds its cell by the axes' values, and meets it by a join of the cells' numbers. A point in a
    cell that lacks a corner has null v, unless its share there is zero, and so has one with a null coordinate. Equal nodes count by their mean. An axis
    of one value is level.
    """
    clean = nodes.select(*[F.col(a).cast("double").alias(a) for a in axes], F.col("v").cast("double").alias("v")).na.drop()
    values = {}
    for a in axes:
        distinct = clean.select(a).distinct()
        if distinct.limit(MOST_VALUES + 1).count() > MOST_VALUES:
            raise ValueError(f"axis {a} has more than {MOST_VALUES} values")
        values[a] = np.sort(distinct.toArrow()[a].to_numpy())
    if not all(len(v) for v in values.values()):
        return points.withColumn("v", F.lit(None).cast("double"))
    index, share = [f"_i{a}" for a in axes], [f"_s{a}" for a in axes]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, v in values.items():
                p = b[f"_{a}"].to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(p)
                i = np.clip(np.searchsorted(v, np.where(known, p, v[0]), side="right") - 1, 0, max(len(v) - 2, 0))
                width = v[np.minimum(i + 1, len(v) - 1)] - v[i]
                s = np.where(width > 0, (p - v[i]) / np.where(width > 0, width, 1), 0.0)
                b = b.append_column(f"_i{a}", pa.array(i, mask=~known)).append_column(f"_s{a}", pa.array(s, mask=~known))
            yield b

    def numbered(df: DataFrame) -> DataFrame:
        rows = df.select("*", *[F.col(a).cast("double").alias(f"_{a}") for a in axes])
        more = [T.StructField(n, kind) for a in axes for n, kind in ((f"_i{a}", T.LongType()), (f"_s{a}", T.DoubleType()))]
        return rows.mapInArrow(placed, T.StructType([*rows.schema.fields, *more])).drop(*[f"_{a}" for a in axes])

    corners = list(product((0, 1), repeat=len(axes)))
    own = numbered(clean.groupBy(*axes).agg(F.avg("v").alias("v")))
    # a node's own number: the last of an axis lies at the end of the cell before it
    own = own.select("v", *[(F.col(i) + F.round(F.col(s)).cast("long")).alias(i) for i, s in zip(index, share, strict=True)])
    sent = own.withColumn("_c", F.explode(F.array(*[F.array(*map(F.lit, c)) for c in corners])))
    sent = sent.select("v", "_c", *[(F.col(i) - F.col("_c")[k]).alias(i) for k, i in enumerate(index)])
    inside = [F.col(i).between(0, max(len(values[a]) - 2, 0)) for a, i in zip(axes, index, strict=True)]
    names = ["_v" + "".join(map(str, c)) for c in corners]
    is_corner = lambda c: F.col("_c") == F.array(*map(F.lit, c))
    cells = sent.where(reduce(lambda x, y: x & y, inside)).groupBy(*index).agg(*[F.max(F.when(is_corner(c), F.col("v"))).alias(n) for c, n in zip(corners, names, strict=True)])
    weight = lambda c: reduce(lambda x, y: x * y, [F.col(s) if k else 1 - F.col(s) for k, s in zip(c, share, strict=True)])
    terms = [F.when(weight(c) == 0, 0.0).otherwise(weight(c) * F.col(n)) for c, n in zip(corners, names, strict=True)]
    return numbered(points).join(cells, index, "left").select(*points.columns, reduce(lambda x, y: x + y, terms).alias("v"))


def constant(spark, v: float) -> DataFrame:
    """One knot: the velocity everywhere."""
    return spark.createDataFrame([(0, 0.0, float(v))], "id int, t double, v double")


def gradient_grid(spark, v0: float, gradients: dict[str, float], ends: dict[str, float], steps: dict[str, float]) -> DataFrame:
    """Nodes of v0 plus gradients along each axis, from 0 to its end by its step."""
    out = spark.range(1).select(F.lit(float(v0)).alias("v"))
    for a, g in gradients.items():
        n = int(ends[a] / steps[a]) + 1
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(a, F.col(a) * float(steps[a])).withColumn("v", F.col("v") + g * F.col(a))
    return out


def from_picks(picks: DataFrame, times: DataFrame, cdps: DataFrame) -> DataFrame:
    """(cdp, t, v) at all cdps(cdp) and times(t) of picks(cdp, t, v): along each picked location linear in time, between locations linear in cdp, level beyond the ends of both."""
    located = picks.select("cdp").distinct()
    at_times = interpolate(located.join(F.broadcast(times.select("t"))).select("cdp", "t"), picks, "cdp")
    along = at_times.select(F.col("t").alias("id"), F.col("cdp").cast("double").alias("t"), "v")
    wanted = cdps.select("cdp").join(F.broadcast(times.select(F.col("t").alias("id")))).select("id", F.col("cdp").cast("double").alias("t"), F.col("cdp").alias("own"))
    return interpolate(wanted, along).select(F.col("own").alias("cdp"), F.col("id").alias("t"), "v")


def summary(knots: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, t_min, t_max, v_min, v_max, v_mean, gradient) of velocity functions: gradient is that of the least-squares line."""
    t, v = F.col("t"), F.col("v")
    return knots.groupBy(*by).agg(F.count("*").alias("n"), F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.regr_slope(v, t).alias("gradient"))
