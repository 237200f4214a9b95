"""Queries of whole datasets that go to SEG-Y and come back: import of several files, sorted, muted and noise exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.plans.series import OFFSET, flat, with_offset
from strataflow.sources import bundle, export, segy
from strataflow.sources.scratch import folder

MUTE = export.Mute(2000.0, 2.0, top=True, taper=8)


def headed(s: SparkSession, d: str) -> DataFrame:
    return with_offset(s, d).withColumn("cdp", F.col("gather").cast("int")).withColumn("offset", F.col("offset").cast("int"))


def imported(s: SparkSession, d: str) -> bundle.Bundle:
    """Two files, of even and of odd traces, to one bundle."""
    at = folder(s)
    for k, name in enumerate("ab"):
        segy.write(headed(s, d).where(F.col("trace_index") % 2 == k), f"{at}/{name}.sgy", 2000)
    return bundle.import_segy(s, f"{at}/*.sgy", f"{at}/bundle", ["cdp"], block=F.floor(F.col("trace_index") / 64))


def import_bundle(s, d):
    return imported(s, d).ensembles.select("ensemble_id", F.col("cdp").cast("long").alias("cdp"), *[F.col(c).cast("long").alias(c) for c in ("start_trace", "end_trace", "n_traces")])


def import_ensembles(s, d):
    rows = imported(s, d).with_ensembles(["trace_index", "offset", "samples"], each=100)
    return rows.select("trace_index", "ensemble_id", F.col("at").cast("long").alias("at"), F.col("offset").cast("long").alias("offset"), (F.round(F.element_at("samples", 3).cast("double"), 6) + 0.0).alias("third"))


def export_sorted(s, d):
    at = f"{folder(s)}/sorted.sgy"
    export.export(headed(s, d), at, 2000, by=["cdp", "offset"], mute=MUTE)
    back = segy.read(s, at, columns=["trace_index", "cdp", "offset", "samples"])
    return back.select("trace_index", F.col("cdp").cast("long").alias("cdp"), F.col("offset").cast("long").alias("offset"), F.posexplode("samples").alias("s", "a")).select(
        "trace_index", "cdp", "offset", F.col("s").cast("long").alias("s"), (F.round(F.col("a").cast("double"), 6) + 0.0).alias("a")
    )


def export_noise(s, d):
    """A folder of files, which is read as one."""
    at = folder(s)
    processed = headed(s, d).withColumn("samples", F.transform("samples", lambda x: x * 0.25))
    export.export(processed, at, 2000, original=headed(s, d), what="noise", mute=MUTE, muted="original", folder_of_files=True)
    return flat(segy.read(s, at, columns=["trace_index", "samples"]))


def sorted_output(s, d):
    rows = export.sorted_traces(headed(s, d), ["cdp", "offset"], folder(s))
    return rows.select("trace_index", "original_trace_index", (F.round(F.element_at("samples", 1).cast("double"), 6) + 0.0).alias("first"))


_RUNS = """WITH r AS (SELECT row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS t, label, vec_id, embedding FROM embeddings),
n AS (SELECT *, CASE WHEN lag(label) OVER (ORDER BY t) = label THEN 0 ELSE 1 END AS new FROM r), g AS (SELECT *, CAST(sum(new) OVER (ORDER BY t) - 1 AS BIGINT) AS e FROM n)
"""
_E = f"e AS (SELECT vec_id, label, CAST({OFFSET} AS BIGINT) AS o, CAST(unnest(range(64)) AS BIGINT) AS s, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_AT = "CAST(floor(o / 2.0 / 2.0) AS BIGINT)"
_WEIGHT = f"CASE WHEN s < {_AT} THEN 0 WHEN s < {_AT} + 8 THEN 0.5 * (1 - cos(pi() * (s - {_AT}) / 7)) ELSE 1 END"
_SORTED = f"row_number() OVER (ORDER BY label, {OFFSET}, vec_id) - 1"
QUERIES = {
    "import_bundle": (import_bundle, _RUNS + "SELECT e AS ensemble_id, CAST(any_value(label) AS BIGINT) AS cdp, min(t) AS start_trace, max(t) AS end_trace, count(*) AS n_traces FROM g GROUP BY e"),
    "import_ensembles": (
        import_ensembles,
        _RUNS + f"SELECT t AS trace_index, e AS ensemble_id, t - min(t) OVER (PARTITION BY e) AS at, CAST({OFFSET} AS BIGINT) AS offset, round(CAST(embedding[3] AS DOUBLE), 6) + 0.0 AS third FROM g",
    ),
    "export_sorted": (
        export_sorted,
        f"WITH {_E}, p AS (SELECT vec_id, {_SORTED} AS place FROM embeddings) SELECT place AS trace_index, CAST(label AS BIGINT) AS cdp, o AS offset, s, round(CAST(CAST(v * {_WEIGHT} AS FLOAT) AS DOUBLE), 6) + 0.0 AS a FROM e JOIN p USING (vec_id)",
    ),
    "export_noise": (export_noise, f"WITH {_E} SELECT vec_id AS trace_index, s, round(CAST(CAST(v * {_WEIGHT} - v * 0.25 AS FLOAT) AS DOUBLE), 6) + 0.0 AS a FROM e"),
    "sorted_output": (sorted_output, f"SELECT {_SORTED} AS trace_index, vec_id AS original_trace_index, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM embeddings"),
}
