"""Images of bins as volumes, made range by range of traces, kept, and resumed.

An image is a sum, so the partial images of ranges of traces add up. Each unit, a bin and a range, is
written to a folder of its own, which counts only once its job is complete (its _SUCCESS mark); a unit
that was cut off is made again from nothing, and one that is complete is never made twice. So a
run that stops anywhere and goes on gives what one run gives. A job's parameters are kept beside its units, and going on
with others is refused.

Traces of null trace_index, offset or azimuth are in no unit. Bins may overlap: a trace is in each that holds it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import binning
from strataflow.operators.grids import normalised
from strataflow.operators.imaging import Grid


class Unit(NamedTuple):
    bin_name: str
    range: int


class ImageVolumes:
    """A job of images in a shared folder: a grid, bins, and ranges of `each` traces by trace_index."""

    def __init__(self, spark: SparkSession, path: str, grid: Grid, n_out: int, bins: list[binning.Bin], each: int, parameters: dict | None = None):
        names = [b.bin_name for b in bins]
        if len(set(names)) < len(names):
            raise ValueError("bins need names of their own")
        if not all(re.fullmatch(r"[\w.-]+", n) for n in names):
            raise ValueError("bins' names are made of letters, digits and _ . -")
        self.spark, self.path, self.grid, self.n_out, self.bins, self.each = spark, path.rstrip("/"), grid, n_out, bins, each
        job = json.dumps({"grid": [grid.origin, grid.spacing, grid.shape], "n_out": n_out, "bins": [list(b) for b in bins], "each": each, "parameters": parameters or {}}, sort_keys=True)
        found = self._read("job.json")
        if found is None:
            self._write("job.json", job)
        elif found != job:
            raise ValueError(f"{path} has a job of other parameters")

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p, fs = self._file(name)
        return "\n".join(r["value"] for r in self.spark.read.text(str(p)).collect()) if fs.exists(p) else None

    def _write(self, name: str, text: str) -> None:
        p, fs = self._file(name)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _done(self, unit: Unit) -> bool:
        p, fs = self._file(f"units/{unit.range:09d}/{unit.bin_name}/_SUCCESS")
        return fs.exists(p)

    def units(self, traces: DataFrame) -> list[Unit]:
        """All units that traces have, by range and bin: a number for each range and bin."""
        k = F.floor(F.col("trace_index") / self.each).cast("long").alias("k")
        held = [F.max(binning.contains(F.col("offset"), F.col("azimuth"), b).cast("int")).alias(f"b{i}") for i, b in enumerate(self.bins)]
        rows = traces.where("trace_index IS NOT NULL").groupBy(k).agg(*held).orderBy("k").collect()
        return [Unit(b.bin_name, r["k"]) for r in rows for i, b in enumerate(self.bins) if r[f"b{i}"]]

    def progress(self, traces: DataFrame) -> dict[str, tuple[int, int]]:
        """By bin: units done, and all."""
        out = {b.bin_name: (0, 0) for b in self.bins}
        for u in self.units(traces):
            done, all_ = out[u.bin_name]
            out[u.bin_name] = (done + self._done(u), all_ + 1)
        return out

    def run(self, traces: DataFrame, image: Callable[[DataFrame], DataFrame], most: int | None = None) -> int:
        """Makes the units that aren't done, at most so many; returns how many it made. image takes traces to (il, xl, t_index, image, fold), sums that aren't normalised."""
        made, of = 0, {b.bin_name: b for b in self.bins}
        for unit in self.units(traces):
            if made == most:
                break
            if self._done(unit):
                continue
            inside = (F.col("trace_index") >= unit.range * self.each) & (F.col("trace_index") < (unit.range + 1) * self.each)
            own = traces.where(inside & binning.contains(F.col("offset"), F.col("azimuth"), of[unit.bin_name]))
            image(own).select("il", "xl", "t_index", "image", "fold").write.mode("overwrite").parquet(f"{self.path}/units/{unit.range:09d}/{unit.bin_name}")
            made += 1
        return made

    def sums(self) -> DataFrame:
        """(bin_name, il, xl, t_index, image, fold) of all complete units: each bin's sums."""
        p, fs = self._file("units")
        folders = [] if not fs.exists(p) else [str(s.getPath()) for r in fs.listStatus(p) for s in fs.listStatus(r.getPath()) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS"))]
        if not folders:
            return self.spark.createDataFrame([], "bin_name string, il long, xl long, t_index long, image double, fold long")
        rows = self.spark.read.schema("il long, xl long, t_index long, image double, fold long").parquet(*folders)
        rows = rows.withColumn("bin_name", F.regexp_extract(F.input_file_name(), r"/units/\d+/([^/]+)/[^/]+$", 1))
        return rows.groupBy("bin_name", "il", "xl", "t_index").agg(F.sum("image").alias("image"), F.sum("fold").alias("fold"))

    def volumes(self, min_fold: int = 1) -> DataFrame:
        """(bin_name, il, xl, t_index, image, fold): each bin's image, normalised by its fold."""
        return self.sums().withColumn("image", normalised(F.col("image"), F.col("fold"), min_fold))

    def stack(self, min_fold: int = 1) -> DataFrame:
        """(il, xl, t_index, image, fold): the bins' sums together, normalised by their fold."""
        rows = self.sums().groupBy("il", "xl", "t_index").agg(F.sum("image").alias("image"), F.sum("fold").alias("fold"))
        return rows.withColumn("image", normalised(F.col("image"), F.col("fold"), min_fold))

    def headers(self) -> DataFrame:
        """(bin_name, trace_index, inline, crossline, cdp_x, cdp_y, offset, azimuth): a trace of each point and bin, with the bin's centre; a bin around north has its own."""
        nx, ny = self.grid.shape
        centres = [(b.bin_name, (b.offset_min + b.offset_max) / 2, (b.azimuth_min + (b.azimuth_max - b.azimuth_min) % 360 / 2) % 360 if (b.azimuth_max - b.azimuth_min) % 360 else 180.0) for b in self.bins]
        bins = self.spark.createDataFrame(centres, "bin_name string, offset double, azimuth double")
        k = F.col("trace_index")
        points = self.spark.range(nx * ny).select(F.col("id").alias("trace_index")).select("trace_index", F.floor(k / ny).alias("il"), (k % ny).alias("xl"))
        at = lambda i, axis: F.col(i) * self.grid.spacing[axis] + self.grid.origin[axis]
        rows = points.join(F.broadcast(bins))
        return rows.select("bin_name", "trace_index", (F.col("il") + 1).alias("inline"), (F.col("xl") + 1).alias("crossline"), at("il", 0).alias("cdp_x"), at("xl", 1).alias("cdp_y"), "offset", "azimuth")

    def traces(self, image: DataFrame) -> DataFrame:
        """(trace_index, il, xl, samples) of an image(il, xl, t_index, image): points that nothing reached are left out, indices that nothing reached are 0."""
        n, ny = self.n_out, self.grid.shape[1]

        def run(table: pa.Table) -> pa.Table:
            samples = np.zeros(n)
            samples[table["t_index"].to_numpy()] = table["image"].to_numpy()
            il, xl = table["il"][0].as_py(), table["xl"][0].as_py()
            return pa.table({"trace_index": [il * ny + xl], "il": [il], "xl": [xl], "samples": pa.array([samples.tolist()], pa.list_(pa.float64()))})

        return image.select("il", "xl", "t_index", "image").groupBy("il", "xl").applyInArrow(run, "trace_index long, il long, xl long, samples array<double>")
