"""Traces on regular grids: fold, representatives, volumes, reconstruction and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(binned: DataFrame) -> DataFrame:
    """(ix, iy, fold) of binned(ix, iy)."""
    return binned.groupBy("ix", "iy").agg(F.count("*").alias("fold"))


def fold_statistics(binned: DataFrame, nx: int, ny: int) -> DataFrame:
    return fold(binned).agg(F.max("fold").alias("max_fold"), F.avg("fold").alias("mean_fold"), F.count("*").alias("populated"), (F.count("*") / (nx * ny)).alias("populated_share"))


def representatives(binned: DataFrame, method: str = "median", min_fold: int = 1) -> DataFrame:
    """(ix, iy, fold, samples) of binned(ix, iy, distance, trace_index, samples): by sample the median or mean, or the first or nearest trace. Bins below min_fold are left out."""
    if method in ("first", "nearest"):
        key = F.struct("trace_index") if method == "first" else F.struct("distance", "trace_index")
        return binned.groupBy("ix", "iy").agg(F.count("*").alias("fold"), F.min_by(F.transform("samples", lambda x: x.cast("double")), key).alias("samples")).where(F.col("fold") >= min_fold)
    rows = binned.select("ix", "iy", F.posexplode("samples").alias("s", "a"))
    value = F.percentile("a", F.lit(0.5)) if method == "median" else F.avg(F.col("a").cast("double"))
    by_sample = rows.groupBy("ix", "iy", "s").agg(value.alias("a"), F.count("*").alias("fold"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("s", "a"))), lambda x: x["a"])
    return by_sample.groupBy("ix", "iy").agg(F.max("fold").alias("fold"), ordered.alias("samples")).where(F.col("fold") >= min_fold)


def volume(traces: DataFrame, il: str, xl: str) -> DataFrame:
    """(il, xl, samples): of traces on one cell the one of the largest trace_index."""
    return traces.groupBy(il, xl).agg(F.max_by("samples", "trace_index").alias("samples"))


def from_volume(headers: DataFrame, cube: DataFrame, il: str, xl: str) -> DataFrame:
    """headers with the samples of their cells; null where the cube has none."""
    return headers.join(cube, [il, xl], "left")


def reconstruct(binned: DataFrame, representative: DataFrame, filtered: DataFrame, method: str = "noise_subtract") -> DataFrame:
    """Traces after a filter saw only their bin's representative: noise_subtract takes off what it removed, residual_preserve adds the trace's own rest to what it kept (the same sum in another order)."""
    both = representative.select("ix", "iy", F.col("samples").alias("_rep")).join(filtered.select("ix", "iy", F.col("samples").alias("_kept")), ["ix", "iy"])
    rows = binned.join(both, ["ix", "iy"], "left")
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    if method == "noise_subtract":
        out = minus(F.col("samples"), minus(F.col("_rep"), F.col("_kept")))
    else:
        out = F.zip_with("_kept", minus(F.col("samples"), F.col("_rep")), lambda x, y: x + y)
    return rows.withColumn("samples", F.coalesce(out, F.transform("samples", lambda x: x.cast("double")))).drop("_rep", "_kept")


def passes(binned: DataFrame) -> DataFrame:
    """binned with pass, a trace's place in its bin by distance: traces of one pass fill each bin once."""
    return binned.withColumn("pass", (F.row_number().over(Window.partitionBy("ix", "iy").orderBy("distance", "trace_index")) - 1).cast("long"))


def spatial_distances(headers: DataFrame, il: str, xl: str, x: str, y: str) -> DataFrame:
    """(dx, dy): median distances of neighbours (over 0.01) along the first crossline and the first inline; 25 where there are none."""

    def along(line: str, other: str) -> DataFrame:
        one = headers.join(F.broadcast(headers.agg(F.min(line).alias("_line"))), F.col(line) == F.col("_line"))
        points = one.groupBy(other).agg(F.min(F.struct(x, y)).alias("p")).select(other, F.col("p")[x].alias("px"), F.col("p")[y].alias("py"))
        w = Window.orderBy(other)
        step = F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w))
        return points.select(step.alias("d")).where("d > 0.01").agg(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(25.0)).alias("d"))

    return along(xl, il).withColumnRenamed("d", "dx").crossJoin(along(il, xl).withColumnRenamed("d", "dy"))


def volume_size(headers: DataFrame, il: str, xl: str, n_samples: int) -> DataFrame:
    one = headers.agg(F.count_distinct(il).alias("n_il"), F.count_distinct(xl).alias("n_xl"))
    return one.withColumn("n_bytes", F.col("n_il") * F.col("n_xl") * n_samples * 4)


def within(points: DataFrame, traces: DataFrame, radius: float, x: str = "x", y: str = "y", tx: str = "tx", ty: str = "ty") -> DataFrame:
    """Pairs of points and traces at most radius apart, with distance.

    Both are dealt to square cells of the radius; points go to their nine neighbours, so pairs meet by
    an equality of cells, which a shuffle serves, and the distance is asked of these only.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = points.withColumn("_d", F.explode(around)).withColumn("_cx", cell(x) + F.col("_d.i")).withColumn("_cy", cell(y) + F.col("_d.j")).drop("_d")
    own = traces.withColumn("_cx", cell(tx)).withColumn("_cy", cell(ty))
    dx, dy = F.col(x) - F.col(tx), F.col(y) - F.col(ty)
    distance = F.sqrt(dx * dx + dy * dy)
    return near.join(own, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("distance", distance).where(F.col("distance") <= radius)


def difference(before: DataFrame, after: DataFrame, key: str = "trace_index") -> DataFrame:
    """(key, samples): after taken from before, by trace."""
    return before.select(key, F.col("samples").alias("_a")).join(after.select(key, F.col("samples").alias("_b")), key).select(key, F.zip_with("_a", "_b", lambda a, b: a - b).alias("samples"))


def normalised(image: Column, fold_: Column, min_fold: int = 1) -> Column:
    """image over fold; 0 below min_fold."""
    return F.when(fold_ >= max(1, min_fold), image / fold_).otherwise(0.0)
