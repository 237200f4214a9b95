"""Sorted and muted results as SEG-Y, or as a table in the new order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import grids
from strataflow.operators import traces as X
from strataflow.sources import segy


class Mute(NamedTuple):
    """Linear mutes of traces.mute, in order of offset over velocity."""

    velocity: float
    dt_ms: float
    top: bool = False
    bottom: bool = False
    taper: int = 20
    offset: str = "offset"


def prepared(processed: DataFrame, original: DataFrame | None = None, what: str = "processed", mute: Mute | None = None, muted: str = "output") -> DataFrame:
    """What is to be exported: the processed traces, or the noise, what processing took off the original ones (by trace_index, with the processed headers).

    muted: output mutes what is exported; original and processed mute that input of the noise before.
    """
    if what not in ("processed", "noise") or muted not in ("output", "original", "processed"):
        raise ValueError("what is processed or noise; muted is output, original or processed")
    if what == "noise" and original is None:
        raise ValueError("noise needs the original traces")
    quiet = lambda df: df.withColumn("samples", X.mute(F.col("samples"), F.col(mute.offset), mute.velocity, mute.dt_ms, mute.top, mute.bottom, mute.taper))
    out = quiet(processed) if mute and muted == "processed" else processed
    if what == "noise":
        before = quiet(original) if mute and muted == "original" else original
        noise = grids.difference(before.select("trace_index", "samples"), out.select("trace_index", "samples"))
        out = out.drop("samples").join(noise, "trace_index").select(*out.columns)
    return quiet(out) if mute and muted == "output" else out


def export(processed: DataFrame, path: str, interval_us: int, by: list[str] | None = None, original: DataFrame | None = None, what: str = "processed", mute: Mute | None = None, muted: str = "output", **options) -> int:
    """Writes prepared() traces to a SEG-Y file in the order of by, ties by trace_index; options: those of segy.write. Returns the number of traces."""
    order = [*(c for c in by or [] if c != "trace_index"), "trace_index"]
    return segy.write(prepared(processed, original, what, mute, muted), path, interval_us, by=order, **options)


def sorted_traces(df: DataFrame, by: list[str], path: str) -> DataFrame:
    """df in the order of by, ties by trace_index: trace_index is the new place, original_trace_index the old one. The order is written to path, in ranges."""
    rows, _ = segy.placed(df, [*(c for c in by if c != "trace_index"), "trace_index"], path)
    return rows.withColumn("original_trace_index", F.col("trace_index")).withColumn("trace_index", F.col("_place")).drop("_place", "_range")
