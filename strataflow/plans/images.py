"""Queries of rays, depth images with weights and media, and images of bins made in ranges and resumed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.rays import Medium
from strataflow.operators import binning, imaging
from strataflow.operators.image_volumes import ImageVolumes
from strataflow.plans.series import _DEPTH, _STRAIGHT, _TIME, _TRACES, _WHOLE, DEPTHS, SPACING, shots
from strataflow.plans.stacks import traces
from strataflow.sources.scratch import folder

V0, GRADIENT, DEEPEST = 2000.0, 0.5, 1e9


def curved_rays(s: SparkSession, d: str) -> DataFrame:
    """Rays to a point of each order, by root finding in a medium of one layer; the SQL has its closed form, circles."""
    rows = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 997 * 5 + 1).cast("double").alias("h"), (F.col("o_custkey") % 311 * 10 + 10).cast("double").alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        medium = Medium([(0.0, V0), (DEEPEST, V0 + GRADIENT * DEEPEST)])
        for b in batches:
            r = medium.rays(b["h"].to_numpy(), b["z"].to_numpy())
            yield pa.record_batch({"o_orderkey": b["o_orderkey"], **{k: pa.array(v) for k, v in r._asdict().items()}})

    found = rows.mapInArrow(run, f"o_orderkey {rows.schema['o_orderkey'].dataType.simpleString()}, parameter double, angle double, turning double, time double, spreading double")
    scales = {"parameter": (1e6, 3), "angle": (1.0, 5), "turning": (1e-3, 2), "time": (1.0, 5), "spreading": (1e-3, 5)}
    return found.select("o_orderkey", *[F.round(F.col(k) * x, n).alias(k) for k, (x, n) in scales.items()])


RAYS_SQL = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 997 * 5 + 1 AS DOUBLE) AS h, CAST(o_custkey % 311 * 10 + 10 AS DOUBLE) AS z FROM orders),
c AS (SELECT *, (h * h + z * z + 2 * z * {V0} / {GRADIENT}) / (2 * h) AS centre, {V0} / {GRADIENT} AS up FROM o),
r AS (SELECT *, 1 / ({GRADIENT} * sqrt(centre * centre + up * up)) AS p FROM c)
SELECT o_orderkey, round(p * 1e6, 3) AS parameter, round(asin(p * {V0}), 5) AS angle, round((1 / p - {V0}) / {GRADIENT} * 1e-3, 2) AS turning,
  round(acosh(1 + {GRADIENT} * {GRADIENT} * (h * h + z * z) / (2 * {V0} * ({V0} + {GRADIENT} * z))) / {GRADIENT}, 5) AS time,
  round(sqrt(h * h + z * z) * sqrt(1 + {GRADIENT} * z / {V0}) / greatest(cos(asin(p * {V0})), 0.1) * 1e-3, 5) AS spreading FROM r"""


def depth(digits: int = 3, scale: float = 1e4, **changes):
    def query(s, d):
        t = shots(s, d)
        out = imaging.migrate_depth(t, imaging.survey_grid(t, SPACING), DEPTHS, V0, 0.02, 160.0, 60.0, **changes)
        return out.select("il", "xl", "z_index", (F.round(F.col("image") * scale, digits) + 0.0).alias("image"), "fold")

    return query


VTI = (2100.0, 0.1)
_VTI = "sqrt(greatest(0, z * z / 4e6 + {h} / 4.41e6 - 0.2 * {h} * {h} / (4.41e6 * (z * z / 4e6 * 4.41e6 + 1.2 * {h}))))"
VTI_SQL = _TRACES + _WHOLE + _DEPTH.format(f"{_VTI.format(h='hs')} + {_VTI.format(h='hr')}")
_STANDARD = "(z / (rs + 1e-6)) * (z / (rr + 1e-6)) / (rs * rr + 1e-6)"
_TRUE = "cos(atan2(sqrt(hs), z)) * cos(atan2(sqrt(hr), z)) / (rs * rr * 2e3) / greatest(cos((atan2(sqrt(hs), z) + atan2(sqrt(hr), z)) / 2), 0.1)"
_ALIAS = "least(1, least(coalesce(2e3 / nullif(2 * 40 * abs((sqrt(hs) / rs + sqrt(hr) / rr) / 2), 0), 25), 25) / 24)"
TRUE_SQL = (_TRACES + _WHOLE + _DEPTH.format(_STRAIGHT)).replace(_STANDARD, f"{_TRUE} * {_ALIAS}").replace("* 1e4, 3)", "* 1e7, 3)")

#: Offset bins of the survey, whose offsets end at 1,950.
BINS = [binning.Bin("near", 0.0, 600.0), binning.Bin("middle", 400.0, 1200.0), binning.Bin("far", 1200.0, 2000.0)]


def surveyed(s, d) -> DataFrame:
    t = F.col("trace_index")
    return traces(s, d).select("trace_index", (t % 20 * 25.0).alias("tx"), (F.floor(t / 20) * 25.0).alias("ty"), (t % 40 * 50.0).alias("offset"), (t % 36 * 10.0).alias("azimuth"), "samples")


def job(s, d) -> tuple[ImageVolumes, DataFrame]:
    """A job that was stopped after four units and resumed."""
    rows = surveyed(s, d)
    grid, path, each = imaging.survey_grid(rows, SPACING), folder(s), max(1, (rows.count() + 3) // 4)
    image = lambda t: imaging.migrate(t, grid, V0, 0.02, 64, 120.0, 45.0, min_fold=None)
    ImageVolumes(s, path, grid, 64, BINS, each).run(rows, image, most=4)
    out = ImageVolumes(s, path, grid, 64, BINS, each)
    out.run(rows, image)
    return out, rows


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "il", "xl", "t_index", (F.round(F.col("image") * 1e6, 3) + 0.0).alias("image"), "fold")


_BINNED = _TRACES.replace("WITH t AS (SELECT", "WITH u AS (SELECT")
_NAMED = """
k AS (SELECT * FROM (VALUES ('near', 0, 600), ('middle', 400, 1200), ('far', 1200, 2000)) k(bin_name, low, high)),
t AS (SELECT k.bin_name, u.* FROM u JOIN k ON o >= low AND o < high),"""
_BY_BIN = _TIME.format("2e3").replace("SELECT il, xl, sqrt", "SELECT bin_name, il, xl, sqrt").replace("SELECT il, xl, d, o,", "SELECT bin_name, il, xl, d, o,")
VOLUMES_SQL = _BINNED + _NAMED + _WHOLE.replace("FROM t)", "FROM u)") + _BY_BIN.replace("SELECT il, xl, CAST(floor", "SELECT bin_name, il, xl, CAST(floor").replace("GROUP BY il, xl,", "GROUP BY bin_name, il, xl,")
STACK_SQL = _BINNED + _NAMED + _WHOLE.replace("FROM t)", "FROM u)") + _TIME.format("2e3")

QUERIES = {
    "physics_curved_rays": (curved_rays, RAYS_SQL),
    "image_depth_vti": (depth(earth=imaging.Earth(V0, vti=VTI)), VTI_SQL),
    "image_depth_true_amplitude": (depth(scale=1e7, weight="true", antialias=imaging.AntiAlias(40.0, 24.0)), TRUE_SQL),
    "image_volumes": (lambda s, d: rounded(job(s, d)[0].volumes(), "bin_name"), VOLUMES_SQL),
    "image_volumes_stack": (lambda s, d: rounded(job(s, d)[0].stack()), STACK_SQL),
}
