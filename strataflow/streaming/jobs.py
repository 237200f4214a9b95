"""Streams: job alerts with event time and state, gathers from arriving headers, and ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def error_rate_alerts(jobs: DataFrame, minutes: int = 60, slide: int | None = None, late: str = "10 minutes", least: int = 5, rate: float = 0.2) -> DataFrame:
    """(window_start, n, failed, error_rate) of windows whose share of failed jobs is an alert. jobs(created_at, state); rows later than the watermark don't count."""
    w = F.window("created_at", f"{minutes} minutes", f"{slide} minutes" if slide else None)
    counts = jobs.withWatermark("created_at", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("state") == "FAILED", 1).otherwise(0)).alias("failed"))
    found = counts.select(F.col("w.start").alias("window_start"), "n", "failed", (F.col("failed") / F.col("n")).alias("error_rate"))
    return found.where((F.col("n") >= least) & (F.col("error_rate") >= rate))


def consecutive_failure_alerts(jobs: DataFrame, by: str = "worker", threshold: int = 3) -> DataFrame:
    """(by, at, n) when a key's failures without another state between reach the threshold. State: a count for each key; a batch's rows go in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
        out = []
        for s, at in zip(rows["state"], rows["created_at"], strict=True):
            n = n + 1 if s == "FAILED" else 0
            if n == threshold:
                out.append((key[0], at, n))
        state.update((n,))
        yield pd.DataFrame(out, columns=["key", "at", "n"])

    keyed = jobs.withColumn("key", F.col(by).cast("string"))
    return keyed.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, n long", "n long", "append", GroupStateTimeout.NoTimeout)


def gathers(headers: DataFrame, key: str, stream: str = "file") -> DataFrame:
    """(stream, value, start_trace, end_trace, n_traces) of closed runs of the key in each stream's traces, which arrive in order of trace_index between batches.

    A row of null trace_index marks its stream's end: the open run is closed then too, and its state is
    removed. State: the open run.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("trace_index")
        out = []
        ended = False
        for value, at, ends in zip(rows["value"], rows["trace_index"], rows["ends"], strict=True):
            if ends:
                ended = True
            elif held is not None and held[0] == value:
                held = (value, held[1], int(at))
            else:
                if held is not None:
                    out.append((name[0], held[0], held[1], held[2], held[2] - held[1] + 1))
                held = (value, int(at), int(at))
        if ended and held is not None:
            out.append((name[0], held[0], held[1], held[2], held[2] - held[1] + 1))
        if not ended and held is not None:
            state.update(held)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream", "value", "start_trace", "end_trace", "n_traces"])

    rows = headers.select(F.col(stream).cast("string").alias("stream"), F.col(key).cast("string").alias("value"), F.coalesce(F.col("trace_index").cast("long"), F.lit(2**63 - 1)).alias("trace_index"), F.col("trace_index").isNull().alias("ends"))
    out = "stream string, value string, start_trace long, end_trace long, n_traces long"
    return rows.groupBy("stream").applyInPandasWithState(run, out, "value string, start long, last long", "append", GroupStateTimeout.NoTimeout)


def ingest(traces: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A query that puts each batch of a stream of traces, transformed, into Parquet by batch; a batch that runs again overwrites itself."""

    def put(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return traces.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
