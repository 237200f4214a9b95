"""Stack queries over embeddings: a trace per row, label as gather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import stacking


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("trace_index"), F.col("label").alias("gather"), F.col("embedding").alias("samples"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("gather", F.col("sample_index").cast("long").alias("sample_index"), F.round("stack", 6).alias("stack"), F.col("fold").cast("long").alias("fold"))


EXPLODED_SQL = "WITH s AS (SELECT label AS gather, CAST(unnest(range(len(embedding))) AS BIGINT) AS sample_index, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings)"


def _sql(value: str) -> str:
    live = "FILTER (WHERE abs(a) > 1e-30)"
    return f"{EXPLODED_SQL} SELECT gather, sample_index, round(coalesce({value.format(live=live)}, 0), 6) AS stack, count(*) {live} AS fold FROM s GROUP BY ALL"


INLINES = [0, 2, 5]


def inlines(s: SparkSession, d: str) -> DataFrame:
    """Labels as inlines, with a gather for each remainder of the trace's index."""
    rows = stacking.stack_inlines(traces(s, d).select(F.col("gather").alias("inline"), (F.col("trace_index") % 7).alias("gather"), "samples"), INLINES, gather="gather")
    return _rounded(rows.withColumn("gather", F.struct("inline", "gather"))).select("gather.*", "sample_index", "stack", "fold")


_INLINES_SQL = """
WITH s AS (
    SELECT label AS inline, vec_id % 7 AS gather, CAST(unnest(range(len(embedding))) AS BIGINT) AS sample_index, CAST(unnest(embedding) AS DOUBLE) AS a
    FROM embeddings
    WHERE label IN (0, 2, 5)
)
SELECT inline, gather, sample_index, round(coalesce(avg(a) FILTER (WHERE abs(a) > 1e-30), 0), 6) AS stack, count(*) FILTER (WHERE abs(a) > 1e-30) AS fold
FROM s
GROUP BY ALL
"""

QUERIES = {
    "stack_inlines": (inlines, _INLINES_SQL),
    "stack_mean": (lambda s, d: _rounded(stacking.stack(traces(s, d), "gather")), _sql("avg(a) {live}")),
    "stack_sum": (lambda s, d: _rounded(stacking.stack(traces(s, d), "gather", normalize=False)), _sql("sum(a) {live}")),
    "stack_median": (lambda s, d: _rounded(stacking.stack(traces(s, d), "gather", "median")), _sql("quantile_cont(a, 0.5) {live}")),
}
