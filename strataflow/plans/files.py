"""Queries through files and streams: traces written in a format of the library's and read again, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import filters
from strataflow.plans.job_history import jobs
from strataflow.plans.series import flat
from strataflow.plans.stacks import traces
from strataflow.sources import bundle, functions_of_depth, segy, synthetic
from strataflow.sources.scratch import folder
from strataflow.streaming import jobs as streams


def segy_read_back(code: int):
    def query(s: SparkSession, d: str) -> DataFrame:
        at = folder(s)
        segy.store(at)[0].create_dir(segy.store(at)[1])
        segy.write(traces(s, d).withColumn("cdp", F.col("gather")), f"{at}/a.sgy", 2000, code)
        return flat(segy.read(s, f"{at}/a.sgy"))

    return query


def segy_headers(s, d):
    at = folder(s)
    segy.store(at)[0].create_dir(segy.store(at)[1])
    segy.write(traces(s, d).withColumn("cdp", F.col("gather")), f"{at}/a.sgy", 2000)
    return segy.read(s, f"{at}/a.sgy", {"cdp": (21, "i"), "sample_count": (115, "h")}, samples=False).select("trace_index", F.col("cdp").cast("long").alias("cdp"), F.col("sample_count").cast("long").alias("sample_count"))


def bundle_ensembles(s, d):
    at = folder(s)
    bundle.save(traces(s, d), at, 2.0, ["gather"], F.floor(F.col("trace_index") / 64))
    return bundle.Bundle(s, at).ensembles.select("ensemble_id", F.col("gather").cast("long").alias("gather"), F.col("start_trace").cast("long").alias("start_trace"), F.col("end_trace").cast("long").alias("end_trace"), "n_traces")


def bundle_window(s, d):
    at = folder(s)
    bundle.save(traces(s, d), at, 2.0)
    return flat(bundle.Bundle(s, at).window(20, 60, 10, 60))


def synthetic_gather(s, d):
    """Events without noise on a trace for each customer."""
    rows = s.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 400).cast("long").alias("trace_index"), F.col("c_custkey").alias("customer"))
    out = synthetic.events(filters.spread(rows, "customer"), 60, 0.01, 12.0, noise=0.0)
    return out.select("customer", F.posexplode("samples").alias("s", "a")).select("customer", F.col("s").cast("long").alias("s"), (F.round(F.col("a").cast("double"), 5) + 0.0).alias("a"))


def _ricker_sql(t: str) -> str:
    return f"(1 - 2 * pow(pi() * 12 * ({t}), 2)) * exp(-pow(pi() * 12 * ({t}), 2))"


_EVENTS_SQL = f"""WITH e AS (SELECT c_custkey AS customer, c_custkey % 400 AS i, unnest(range(60)) AS s FROM customer), t AS (SELECT *, s * 0.01::DOUBLE AS t FROM e)
SELECT customer, s, round(CAST(CAST({_ricker_sql("t - 0.2")} + 0.7 * {_ricker_sql("t - 0.4 - 0.001 * i")} + 0.5 * {_ricker_sql("t - sqrt(0.36 + pow(i * 25.0 / 2000, 2))")} AS FLOAT) AS DOUBLE), 5) + 0.0 AS a FROM t"""


def velocity_read_back(s, d):
    at = folder(s)
    rows = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cdp"), (F.col("s_nationkey") / 8).alias("t"), (F.col("s_suppkey") * 2.0 + 1500).alias("v"))
    functions_of_depth.write_velocity(rows, at)
    return functions_of_depth.read_velocity(s, at).select("cdp", F.round("t", 6).alias("t"), "v")


def with_ends(jobs: DataFrame) -> DataFrame:
    """jobs and a row without an id for each worker, which marks its stream's end."""
    return jobs.unionByName(jobs.select("worker").distinct(), allowMissingColumns=True)


def streamed(f, name: str, more=lambda jobs: jobs):
    """The rows of a stream over the events' files, as far as they go. However many files there are, one batch has all, as none limits it; so nothing comes late or out of order."""

    def query(s: SparkSession, d: str) -> DataFrame:
        at = folder(s)
        more(jobs(s, d)).write.parquet(f"{at}/in")
        source = s.readStream.schema(s.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
        q = f(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return s.read.schema(f(source).schema).parquet(f"{at}/out")

    return query


_FLAT = "SELECT vec_id AS trace_index, CAST(unnest(range(64)) AS BIGINT) AS s, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS a FROM embeddings"
_EVENTS = "WITH j AS (SELECT event_id AS id, user_id AS worker, ts AS created_at, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'RUNNING' ELSE CASE WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END END AS state FROM events)"
#: Each value to six hexadecimal digits after the point, as IBM floats hold them.
_IBM = """WITH v AS (SELECT vec_id AS trace_index, CAST(unnest(range(64)) AS BIGINT) AS s, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
p AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v)) / 4) + 1 END AS p FROM v)
SELECT trace_index, s, round(CAST(CAST(sign(v) * round_even(abs(v) * pow(2, -4 * p) * 16777216, 0) / 16777216 * pow(2, 4 * p) AS FLOAT) AS DOUBLE), 6) + 0.0 AS a FROM p"""
QUERIES = {
    "segy_ieee": (segy_read_back(5), _FLAT),
    "segy_ibm": (segy_read_back(1), _IBM),
    "segy_headers": (segy_headers, "SELECT vec_id AS trace_index, CAST(label AS BIGINT) AS cdp, CAST(64 AS BIGINT) AS sample_count FROM embeddings"),
    "bundle_ensembles": (bundle_ensembles, "WITH r AS (SELECT vec_id, label, CASE WHEN lag(label) OVER (ORDER BY vec_id) = label THEN 0 ELSE 1 END AS new FROM embeddings), g AS (SELECT *, sum(new) OVER (ORDER BY vec_id) - 1 AS e FROM r) SELECT CAST(e AS BIGINT) AS ensemble_id, CAST(any_value(label) AS BIGINT) AS gather, min(vec_id) AS start_trace, max(vec_id) AS end_trace, count(*) AS n_traces FROM g GROUP BY e"),
    "bundle_window": (bundle_window, "SELECT vec_id AS trace_index, CAST(unnest(range(20)) AS BIGINT) AS s, round(CAST(unnest(embedding[11:30]) AS DOUBLE), 6) + 0.0 AS a FROM embeddings WHERE vec_id BETWEEN 10 AND 59"),
    "velocity_file": (velocity_read_back, "SELECT s_suppkey AS cdp, round(s_nationkey / 8.0, 6) AS t, s_suppkey * 2.0::DOUBLE + 1500 AS v FROM supplier"),
    "synthetic_gather": (synthetic_gather, _EVENTS_SQL),
    "synthetic_marine": (
        lambda s, d: synthetic.towed(s.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey").cast("long") - 1).alias("shot")), 8),
        "WITH s AS (SELECT s_suppkey - 1 AS shot, unnest(range(8)) AS r FROM supplier) SELECT shot * 8 + r AS trace_index, shot, shot * 100.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, shot * 100.0::DOUBLE + 100 + r * 25.0::DOUBLE AS rx, 0.0::DOUBLE AS ry FROM s",
    ),
    "stream_failure_alerts": (streamed(lambda j: streams.consecutive_failure_alerts(j, "worker", 2), "runs"), _EVENTS + ", b AS (SELECT *, sum(CASE WHEN state = 'FAILED' THEN 0 ELSE 1 END) OVER (PARTITION BY worker ORDER BY created_at, id) AS b FROM j), f AS (SELECT *, row_number() OVER (PARTITION BY worker, b ORDER BY created_at, id) AS n FROM b WHERE state = 'FAILED') SELECT CAST(worker AS VARCHAR) AS key, created_at AS at, n FROM f WHERE n = 2"),
    "stream_gathers": (streamed(lambda j: streams.gathers(j.withColumn("trace_index", F.col("id")), "state", "worker"), "gathers", with_ends), _EVENTS + ", r AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS new FROM j WINDOW w AS (PARTITION BY worker ORDER BY id)), g AS (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY id) AS e FROM r), c AS (SELECT worker, e, any_value(state) AS value, min(id) AS a, max(id) AS b FROM g GROUP BY worker, e) SELECT CAST(worker AS VARCHAR) AS stream, value, a AS start_trace, b AS end_trace, b - a + 1 AS n_traces FROM c"),
}
