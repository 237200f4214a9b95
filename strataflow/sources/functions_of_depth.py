"""Velocity and anisotropy files: columns of text, or JSON. Knots are rows, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {2: ("t", "v"), 3: ("cdp", "t", "v"), 4: ("il", "xl", "t", "v")}


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Numeric fields of the lines, which commas, spaces or tabs part; lines begun by # or // and blank ones are left out."""
    line = F.trim(F.col("value"))
    rows = spark.read.text(path).select(line.alias("value")).where((line != "") & ~line.startswith("#") & ~line.startswith("//"))
    numbers = F.transform(F.split("value", r"[,\s]+"), lambda x: x.try_cast("double"))
    return rows.select(F.filter(numbers, lambda x: x.isNotNull()).alias("f")).where(F.size("f") > 0)


def detect(spark: SparkSession, path: str) -> str:
    """json, segy, npy, tv, cdp_tv or il_xl_tv, by extension, then by the first line's numbers."""
    for end, kind in ((".json", "json"), (".sgy", "segy"), (".segy", "segy"), (".npy", "npy"), (".npz", "npy")):
        if path.lower().endswith(end):
            return kind
    first = _fields(spark, path).first()
    n = len(first["f"]) if first else 0
    if n < 2:
        raise ValueError(f"{path}: a line needs two numbers or more")
    return {2: "tv", 3: "cdp_tv"}.get(n, "il_xl_tv")


def read_velocity(spark: SparkSession, path: str, time_unit: str = "ms", velocity_unit: str = "m/s") -> DataFrame:
    """Knots (t in seconds, v in m/s, and cdp, or il and xl, where the file has them)."""
    kind = detect(spark, path)
    if kind == "json":
        rows = spark.read.json(path, multiLine=True)
    elif kind in ("tv", "cdp_tv", "il_xl_tv"):
        names = KINDS[{"tv": 2, "cdp_tv": 3, "il_xl_tv": 4}[kind]]
        rows = _fields(spark, path).where(F.size("f") >= len(names)).select(*[F.col("f")[k].alias(n) for k, n in enumerate(names)])
    else:
        raise ValueError(f"{kind} holds samples, not knots; read it by the segy source")
    scale = {"ms": 1e-3, "s": 1.0, "us": 1e-6}[time_unit]
    v = F.col("v") * (0.3048 if velocity_unit == "ft/s" else 1.0)
    return rows.withColumns({"t": F.col("t") * scale, "v": v, **{c: F.col(c).cast("long") for c in ("cdp", "il", "xl") if c in rows.columns}})


def write_velocity(knots: DataFrame, path: str, time_unit: str = "ms", delimiter: str = "\t") -> None:
    """A folder of text, in order of the keys and t."""
    names = [c for c in ("cdp", "il", "xl", "t", "v") if c in knots.columns]
    scale = {"ms": 1e3, "s": 1.0, "us": 1e6}[time_unit]
    rows = knots.withColumn("t", F.col("t") * scale).select(*names).orderBy(*names[:-1])
    rows.select(F.concat_ws(delimiter, *[F.col(c).cast("string") for c in names]).alias("value")).write.mode("overwrite").text(path)


def preview(spark: SparkSession, path: str) -> DataFrame:
    """One row: the number of knots, and the extremes of t and v."""
    return read_velocity(spark, path).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("t", "v") for n, f in (("min", F.min), ("max", F.max))])


def convert(spark: SparkSession, source: str, target: str, to: str = "interval") -> None:
    """A velocity file read, converted between RMS and interval, and written."""
    from strataflow.operators.velocity import interval_to_rms, rms_to_interval

    knots = read_velocity(spark, source)
    key = next((k for k in ("cdp", "il") if k in knots.columns), None)
    rows = knots if key else knots.withColumn("id", F.lit(0))
    done = rms_to_interval(rows, key or "id") if to == "interval" else interval_to_rms(rows, key or "id")
    done = done.withColumn("v", F.col("v_interval" if to == "interval" else "v_rms"))
    write_velocity(done if key else done.drop("id"), target)


def read_anisotropy(spark: SparkSession, path: str) -> DataFrame:
    """Knots (z, epsilon, delta)."""
    if path.lower().endswith(".json"):
        return spark.read.json(path, multiLine=True).select("z", "epsilon", "delta")
    return _fields(spark, path).where(F.size("f") >= 3).select(*[F.col("f")[k].alias(n) for k, n in enumerate(("z", "epsilon", "delta"))])


def anisotropy_from_wells(wells: DataFrame, method: str = "average") -> DataFrame:
    """(z, epsilon, delta) by depth over wells(z, epsilon, delta): average or median."""
    f = F.avg if method == "average" else lambda c: F.percentile(c, F.lit(0.5))
    return wells.groupBy("z").agg(f("epsilon").alias("epsilon"), f("delta").alias("delta"))
