"""A dataset as Parquet: traces with their headers, ensemble index, and metadata as JSON.

Traces and headers are columns of one table, in files of trace_index ranges: whoever asks for headers
reads no sample, and a range of traces is a few row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators.ensembles import ensemble_index
from strataflow.sources import segy
from strataflow.sources.scratch import delete


def _finish(spark: SparkSession, path: str, sample_rate_ms: float, ensemble_keys: list[str] | None, block: Column | None, more: dict | None = None) -> None:
    """The ensemble index and the metadata of written data. Gathers are found within blocks of traces, and those that go on in the next block are stitched, from the headers' columns alone."""
    data = spark.read.parquet(f"{path}/data")
    if ensemble_keys:
        blocks = F.floor(F.col("trace_index") / 1_000_000).cast("long") if block is None else block
        ensemble_index(data.drop("samples"), ensemble_keys, ["trace_index"], blocks).write.mode("overwrite").parquet(f"{path}/ensemble_index")
    one = more or data.agg(F.count("*").alias("n_traces"), F.max(F.size("samples")).alias("n_samples")).first().asDict()
    meta = {"sample_rate_ms": sample_rate_ms, "n_traces": one["n_traces"], "n_samples": one["n_samples"], "ensemble_keys": ensemble_keys or []}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def save(df: DataFrame, path: str, sample_rate_ms: float, ensemble_keys: list[str] | None = None, block: Column | None = None, compression: str = "zstd") -> None:
    """Writes df(trace_index, headers, samples), sorted by trace_index in ranges. block: see ensemble_index; by default a million traces each."""
    ordered = df.repartitionByRange("trace_index").sortWithinPartitions("trace_index")
    ordered.write.mode("overwrite").option("compression", compression).parquet(f"{path}/data")
    _finish(df.sparkSession, path, sample_rate_ms, ensemble_keys, block)


def import_segy(spark: SparkSession, files: str, path: str, ensemble_keys: list[str] | None = None, mapping: dict[str, tuple[int, str]] | None = None, block: Column | None = None, traces_per_task: int | None = None, compression: str = "zstd") -> Bundle:
    """SEG-Y files (see segy.read) to a bundle, in one pass over their bytes and without a shuffle of traces.

    Each task reads a range of a file and writes it as one file of the bundle, straight from Arrow, so traces
    stay in order without sorting. A file gets its name when it is whole, after its range, so a task that
    runs again leaves the same. The ensemble index is made from the written headers, counts come from the
    files' sizes, and the metadata, without which there is no bundle, are written last. Files must agree in samples and interval.
    """
    options = {"path": files} | ({"mapping": json.dumps(mapping)} if mapping else {}) | ({"tracespertask": str(traces_per_task)} if traces_per_task else {})
    source = segy.SegyDataSource(options)
    reader = segy.SegyReader(options, source.schema())
    layouts = [own for _, own in reader.files]
    if len({(own.n_samples, own.interval_us) for own in layouts}) > 1:
        raise ValueError(f"{files}: files differ in samples or interval")
    for old in ("data", "ensemble_index", "metadata"):
        delete(spark, f"{path}/{old}")
    ranges = reader.partitions()
    data = f"{path}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = segy.store(data)
        fs.create_dir(folder, recursive=True)
        for b in batches:
            for k in b["k"].to_pylist():
                own, writer, n = ranges[k], None, 0
                temporary = f"{folder}/.{uuid.uuid4().hex}"
                for t in reader.read(own):
                    writer = writer or pq.ParquetWriter(temporary, t.schema, filesystem=fs, compression=compression, use_dictionary=False)
                    writer.write_batch(t)
                    n += t.num_rows
                if writer:
                    writer.close()
                    fs.move(temporary, f"{folder}/part-{own.before + own.first:015d}.parquet")
                yield pa.record_batch({"n": pa.array([n], pa.int64())})

    tasks = spark.range(len(ranges), numPartitions=len(ranges)).select(F.col("id").alias("k"))
    written = tasks.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    counts = {"n_traces": sum(own.n_traces for own in layouts), "n_samples": layouts[0].n_samples}
    if written != counts["n_traces"]:
        raise RuntimeError(f"{path}: {written} of {counts['n_traces']} traces were written")
    if not written:
        spark.createDataFrame([], source.schema()).write.mode("append").parquet(data)
    _finish(spark, path, layouts[0].interval_us / 1000.0, ensemble_keys, block, counts)
    return Bundle(spark, path)


class Bundle:
    """A saved dataset; everything is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")

    @property
    def traces(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data").select("trace_index", "samples")

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data").drop("samples")

    @property
    def ensembles(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ensemble_index")

    def trace_range(self, start: int, end: int) -> DataFrame:
        return self.traces.where((F.col("trace_index") >= start) & (F.col("trace_index") < end))

    def window(self, t0_ms: float, t1_ms: float, start: int, end: int) -> DataFrame:
        from strataflow.operators.traces import window

        return self.trace_range(start, max(end, start + 1)).withColumn("samples", window(F.col("samples"), t0_ms, t1_ms, self.metadata["sample_rate_ms"]))

    def ensemble(self, ensemble_id: int) -> DataFrame:
        """Traces and headers of a gather; its range is one row, read first, so that the traces' filter reaches the files."""
        row = self.ensembles.where(F.col("ensemble_id") == ensemble_id).first()
        if row is None:
            return self.rows.limit(0)
        return self.rows.where(F.col("trace_index").between(row["start_trace"], row["end_trace"]))

    def with_ensembles(self, columns: list[str] | None = None, each: int = 1_000_000) -> DataFrame:
        """All traces with ensemble_id and their place within the ensemble. Ensembles meet traces by blocks of so many traces, to which a long one is sent once each, so it is a join by equality and no key has more than a block."""
        block = lambda c: F.floor(F.col(c) / each).cast("long")
        spread = self.ensembles.select("ensemble_id", "start_trace", "end_trace", F.explode(F.sequence(block("start_trace"), block("end_trace"))).alias("_block"))
        rows = self.rows.select(*(columns or self.rows.columns)).withColumn("_block", block("trace_index"))
        met = rows.join(spread, "_block").where("trace_index BETWEEN start_trace AND end_trace")
        return met.withColumn("at", F.col("trace_index") - F.col("start_trace")).drop("_block", "start_trace", "end_trace")

    def query(self, condition: str) -> DataFrame:
        return self.headers.where(condition)

    def statistics(self) -> dict:
        one = self.ensembles.agg(F.count("*").alias("n_ensembles"), F.avg("n_traces").alias("mean_traces")).first() if self.metadata["ensemble_keys"] else None
        return self.metadata | ({"n_ensembles": one["n_ensembles"], "mean_traces": one["mean_traces"]} if one else {})
