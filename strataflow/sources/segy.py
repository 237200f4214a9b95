"""SEG-Y as a Spark data source, and its sink.

A file is a 3,200-byte text header, a 400-byte binary header, then records of 240 header bytes and
n samples of one width, so any range of traces is a range of bytes: partitions are such ranges, and each
task reads its own. Without samples, only the headers' bytes are read. A path may be a folder or have
commas or wildcards: files are then one after the other in the order of their names, and trace_index goes on.
Filters on trace_index choose ranges, filters on header fields choose the traces whose samples are read,
where the session lets Python sources see them (spark.sql.python.filterPushdown.enabled).

The sink writes each range of traces at its own place in the file. Places are the trace_index where it counts the
traces without a gap, and nothing is shuffled; else they follow from a table of the ordered traces, written once, and its
partitions' counts. So tasks need not wait for each other and a task that runs again writes the same bytes;
the file gets its name when all have. No trace passes through the driver.

Files are read through pyarrow's file systems, so a path may be local or a URI of any store that pyarrow
reaches; one file that many tasks write must be in a file system that all of them mount, other stores get a
folder of files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from strataflow.functions.headers import STANDARD_HEADERS
from strataflow.sources.scratch import delete, folder, written

FILE_HEADER, TRACE_HEADER = 3600, 240
# Sample format codes by width in bytes and NumPy type (1 is IBM's hexadecimal float).
FORMATS = {1: (4, ">u4"), 2: (4, ">i4"), 3: (2, ">i2"), 5: (4, ">f4"), 8: (1, "i1")}
CODES = {"i": (">i4", T.IntegerType()), "h": (">i2", T.ShortType()), "I": (">u4", T.LongType()), "H": (">u2", T.IntegerType()), "f": (">f4", T.FloatType())}
CHUNK = 4096


class Layout(NamedTuple):
    """What a file's binary header and size tell."""

    n_samples: int
    interval_us: int
    format: int
    n_traces: int

    @property
    def record(self) -> int:
        return TRACE_HEADER + self.n_samples * FORMATS[self.format][0]


def ibm_to_float(words: np.ndarray) -> np.ndarray:
    w = words.astype(np.uint32)
    fraction = (w & 0x00FFFFFF).astype(np.float64) / (1 << 24)
    value = fraction * np.exp2(4.0 * (((w >> 24) & 0x7F).astype(np.int64) - 64))
    return np.where(w >> 31, -value, value).astype(np.float32)


def float_to_ibm(x: np.ndarray) -> np.ndarray:
    """The nearest hexadecimal floats; 0 below their range."""
    a = np.abs(x.astype(np.float64))
    with np.errstate(divide="ignore"):
        power = np.where(a > 0, np.floor(np.log2(np.where(a > 0, a, 1)) / 4) + 1, 0).astype(np.int64)
    fraction = np.rint(a * np.exp2(-4.0 * power) * (1 << 24)).astype(np.int64)
    carry = fraction >> 24 > 0
    fraction, power = np.where(carry, fraction >> 4, fraction), power + carry
    word = ((x < 0).astype(np.int64) << 31) | ((power + 64) << 24) | fraction
    return np.where((a > 0) & (power > -64) & (power < 64), word, 0).astype(np.uint32)


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else f"file://{os.path.abspath(path)}")


def layout(path: str) -> Layout:
    fs, p = store(path)
    with fs.open_input_file(p) as f:
        f.seek(3200)
        b, size = f.read(400), f.size()
    interval, n, code = (int.from_bytes(b[k : k + 2], "big") for k in (16, 20, 24))
    if code not in FORMATS or not n:
        raise ValueError(f"{path}: {n} samples in format {code} can't be read")
    return Layout(n, interval, code, (size - FILE_HEADER) // (TRACE_HEADER + n * FORMATS[code][0]))


def decode_headers(records: np.ndarray, mapping: dict[str, tuple[int, str]]) -> dict[str, np.ndarray]:
    """records: bytes, a row per trace. Fields beyond the header are 0."""
    out = {}
    for name, (byte, code) in mapping.items():
        kind = np.dtype(CODES[code][0])
        raw = records[:, byte - 1 : byte - 1 + kind.itemsize]
        fits = byte >= 1 and byte - 1 + kind.itemsize <= TRACE_HEADER
        out[name] = np.ascontiguousarray(raw).view(kind)[:, 0].astype(kind.newbyteorder("=")) if fits else np.zeros(len(records), kind.newbyteorder("="))
    return out


class _Range(InputPartition):
    """Traces first to last of a file, the file's first having trace_index before."""

    def __init__(self, path: str, before: int, first: int, last: int):
        super().__init__((path, before, first, last))
        self.path, self.before, self.first, self.last = path, before, first, last


def files_of(path: str) -> list[str]:
    """The files of a path: itself, those of a folder or of a pattern of names, by name; several paths by commas, in their order."""
    out: list[str] = []
    for one in path.split(","):
        fs, p = store(one)
        full = lambda x, one=one: f"{one[: one.index('://') + 3]}{x}" if "://" in one else x
        head, _, name = p.rpartition("/")
        if "*" in name or "?" in name:
            from fnmatch import fnmatch

            found = [i for i in fs.get_file_info(pa.fs.FileSelector(head)) if i.is_file and fnmatch(i.base_name, name)]
        elif fs.get_file_info(p).type == pa.fs.FileType.Directory:
            found = [i for i in fs.get_file_info(pa.fs.FileSelector(p)) if i.is_file and not i.base_name.startswith((".", "_"))]
        else:
            out.append(one)
            continue
        out += [full(i.path) for i in sorted(found, key=lambda i: i.base_name)]
    if not out:
        raise FileNotFoundError(f"{path}: no file")
    return out


_TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, In: lambda a, b: np.isin(a, list(b))}


class SegyReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.schema, self.mapping = schema, mapping_of(options)
        self.files = [(path, layout(path)) for path in files_of(options["path"])]
        self.samples = "samples" in schema.fieldNames()
        self.each = int(options.get("tracespertask", 0))
        self.filters: list[tuple[str, type, object]] = []

    def partitions(self) -> list[_Range]:
        out, before = [], 0
        for path, own in self.files:
            each = self.each or max(1, (64 << 20) // own.record)
            out += [_Range(path, before, k, min(own.n_traces, k + each)) for k in range(0, own.n_traces, each) if self._may_hold(before + k, before + min(own.n_traces, k + each) - 1)]
            before += own.n_traces
        return out or [_Range(self.files[0][0], 0, 0, 0)]

    def _may_hold(self, low: int, high: int) -> bool:
        """Whether traces low to high may pass the filters on trace_index."""
        for name, kind, value in self.filters:
            if name == "trace_index":
                ends = np.array([low, high])
                if kind in (EqualTo, In):
                    wanted = np.array([value] if kind is EqualTo else list(value))
                    if not ((wanted >= low) & (wanted <= high)).any():
                        return False
                elif not _TESTS[kind](ends, value).any():
                    return False
        return True

    def _passing(self, headers: dict[str, np.ndarray]) -> np.ndarray:
        keep = np.ones(len(headers["trace_index"]), bool)
        for name, kind, value in self.filters:
            keep &= _TESTS[kind](headers[name], value)
        return keep

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, p = store(partition.path)
        own = layout(partition.path)
        size, (_, kind), names = own.record, FORMATS[own.format], self.schema.fieldNames()
        whole = self.samples and not self.filters
        fields = {n: self.mapping[n] for n in {*names, *(n for n, _, _ in self.filters)} if n in self.mapping}
        with fs.open_input_file(p) as f:
            for k in range(partition.first, partition.last, CHUNK):
                n = min(CHUNK, partition.last - k)
                if whole:
                    f.seek(FILE_HEADER + k * size)
                    records = np.frombuffer(f.read(n * size), np.uint8).reshape(n, size)
                else:
                    heads = b"".join(f.read_at(TRACE_HEADER, FILE_HEADER + i * size) for i in range(k, k + n)) if fields else b""
                    records = np.frombuffer(heads, np.uint8).reshape(n if fields else 0, TRACE_HEADER)
                columns = {"trace_index": np.arange(partition.before + k, partition.before + k + n)} | decode_headers(records, fields)
                kept = np.flatnonzero(self._passing(columns))
                arrays = {name: pa.array(v[kept]) for name, v in columns.items() if name in names}
                if self.samples:
                    if not whole:
                        ends = np.flatnonzero(np.diff(kept) > 1) + 1  # neighbours are read together
                        runs = [(int(r[0]), len(r)) for r in np.split(kept, ends) if len(r)]
                        records = np.concatenate([np.empty((0, size), np.uint8), *(np.frombuffer(f.read_at(m * size, FILE_HEADER + (k + at) * size), np.uint8).reshape(m, size) for at, m in runs)])
                    raw = np.ascontiguousarray(records[:, TRACE_HEADER:]).view(kind)
                    values = ibm_to_float(raw) if own.format == 1 else raw.astype(np.float32)
                    arrays["samples"] = pa.ListArray.from_arrays(np.arange(len(kept) + 1, dtype=np.int32) * own.n_samples, values.ravel())
                yield pa.record_batch([arrays[c] for c in names], names=names)


class FilteringReader(SegyReader):
    """The same where the session pushes filters. Spark still applies them all."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            if name == "trace_index" or name in self.mapping:
                self.filters.append((name, type(f), f.value))
            yield f


def mapping_of(options: dict) -> dict[str, tuple[int, str]]:
    given = options.get("mapping")
    return {k: tuple(v) for k, v in json.loads(given).items()} if given else STANDARD_HEADERS


class SegyDataSource(DataSource):
    """spark.read.format("segy").load(path); options: mapping (JSON of name to [byte, code]), samples (false: headers only), columns (comma-joined), tracesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> T.StructType:
        fields = [T.StructField("trace_index", T.LongType())]
        fields += [T.StructField(n, CODES[code][1]) for n, (_, code) in mapping_of(self.options).items()]
        if self.options.get("samples", "true").lower() != "false":
            fields.append(T.StructField("samples", T.ArrayType(T.FloatType())))
        if wanted := self.options.get("columns"):
            have = {f.name: f for f in fields}
            fields = [have[c] for c in wanted.split(",")]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> SegyReader:
        pushed = self.options.get("pushdown", "false").lower() == "true"
        return (FilteringReader if pushed else SegyReader)(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SegyWriter:
        return SegyWriter(dict(self.options))


def read(spark: SparkSession, path: str, mapping: dict[str, tuple[int, str]] | None = None, samples: bool = True, traces_per_task: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Traces of a file, a folder, a pattern of names, or several by commas. columns: only these are decoded, and no sample's byte is read where samples isn't one of them."""
    spark.dataSource.register(SegyDataSource)
    r = spark.read.format("segy").option("samples", str(samples).lower()).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if mapping:
        r = r.option("mapping", json.dumps(mapping))
    if traces_per_task:
        r = r.option("tracesPerTask", traces_per_task)
    if columns:
        r = r.option("columns", ",".join(columns))
    return r.load(path)


def text_header(path: str) -> list[str]:
    """The 40 lines of a file's text header, EBCDIC or ASCII."""
    fs, p = store(path)
    with fs.open_input_file(p) as f:
        raw = f.read(3200)
    text = raw.decode("ascii" if raw[:1] == b"C" else "cp500", errors="replace")
    return [text[k : k + 80].rstrip() for k in range(0, 3200, 80)]


def _records(table: pa.Table, n: int, interval_us: int, code: int, mapping: dict[str, tuple[int, str]]) -> bytes:
    width, kind = FORMATS[code]
    out = np.zeros((table.num_rows, TRACE_HEADER + n * width), np.uint8)
    for name, (byte, c) in {**mapping, "sample_count": (115, "h"), "sample_interval": (117, "h")}.items():
        k = np.dtype(CODES[c][0])
        value = {"sample_count": n, "sample_interval": interval_us}.get(name)
        column = np.full(table.num_rows, value) if value is not None else table[name].to_numpy() if name in table.column_names else None
        if column is not None:
            out[:, byte - 1 : byte - 1 + k.itemsize] = column.astype(k)[:, None].view(np.uint8).reshape(-1, k.itemsize)
    samples = table["samples"].combine_chunks()
    values = samples.flatten().to_numpy(zero_copy_only=False)
    if len(values) != n * table.num_rows:
        raise ValueError(f"every trace must have {n} samples")
    words = float_to_ibm(values).astype(">u4") if code == 1 else values.astype(kind)
    out[:, TRACE_HEADER:] = words.view(np.uint8).reshape(table.num_rows, -1)
    return out.tobytes()


def file_header(interval_us: int, n: int, code: int, template: str | None = None) -> bytes:
    """The text and binary headers; those of a template where one is given, but for what these traces set."""
    header = bytearray(FILE_HEADER)
    if template:
        fs, p = store(template)
        with fs.open_input_file(p) as f:
            header[:] = f.read(FILE_HEADER)
    else:
        header[:3200] = "C 1 written by strataflow".ljust(3200).encode("cp500")
    for at, value in ((3216, interval_us), (3220, n), (3224, code)):
        header[at : at + 2] = value.to_bytes(2, "big")
    return bytes(header)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: traces, and its file's temporary name where it has its own."""

    traces: int
    temporary: str = ""
    name: str = ""


class SegyWriter(DataSourceArrowWriter):
    """Traces at their places, which column _place tells: in one file, which is laid out before, or in a file for each range (_range) of a folder.

    Files have temporary names until all tasks are done; an aborted job leaves none.
    """

    def __init__(self, options: dict):
        self.path, self.header = options["path"], bytes.fromhex(options["header"])
        self.n, self.interval, self.code, self.total = (int(options[k]) for k in ("n", "interval", "code", "total"))
        self.mapping, self.many = mapping_of(options), options["many"] == "true"
        self.record = TRACE_HEADER + self.n * FORMATS[self.code][0]
        fs, p = store(self.path)
        if self.many:
            fs.create_dir(p, recursive=True)
            return
        if not isinstance(fs, pa.fs.LocalFileSystem):
            raise ValueError(f"{self.path}: many tasks write one file only where all mount it; take a folder of files")
        head, _, name = p.rpartition("/")
        os.makedirs(head, exist_ok=True)
        self.temporary = f"{head}/.{name}-{uuid.uuid4().hex}"
        with open(self.temporary, "wb") as f:
            f.write(self.header)
            f.truncate(FILE_HEADER + self.total * self.record)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._own_files(iterator) if self.many else self._places(iterator)

    def _places(self, batches: Iterator[pa.RecordBatch]) -> Written:
        count, target = 0, os.open(self.temporary, os.O_WRONLY)
        try:
            for b in batches:
                t = pa.Table.from_batches([b])
                if (np.diff(t["_place"].to_numpy()) < 0).any():
                    t = t.sort_by("_place")
                place, data = t["_place"].to_numpy(), memoryview(_records(t, self.n, self.interval, self.code, self.mapping))
                starts = np.flatnonzero(np.r_[True, np.diff(place) != 1]) if len(place) else []
                for first, last in zip(starts, [*starts[1:], len(place)], strict=True):
                    part, at = data[first * self.record : last * self.record], FILE_HEADER + int(place[first]) * self.record
                    while part:
                        done = os.pwrite(target, part, at)
                        part, at = part[done:], at + done
                count += t.num_rows
            os.fsync(target)
        finally:
            os.close(target)
        return Written(count)

    def _own_files(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, p = store(self.path)
        count, out, temporary, name = 0, None, "", ""
        try:
            for b in batches:
                t = pa.Table.from_batches([b])
                if not t.num_rows:
                    continue
                if out is None:
                    name = f"{p}/part-{t['_range'][0].as_py():08d}.sgy"
                    temporary = f"{p}/.part-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                    out.write(self.header)
                out.write(_records(t, self.n, self.interval, self.code, self.mapping))
                count += t.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(count, temporary, name)

    def commit(self, messages: list[Written]) -> None:
        done = [m for m in messages if m]
        if sum(m.traces for m in done) != self.total:
            raise RuntimeError(f"{self.path}: {sum(m.traces for m in done)} of {self.total} traces were written")
        if self.many:
            fs = store(self.path)[0]
            for m in done:
                if m.temporary:
                    fs.move(m.temporary, m.name)
        else:
            os.replace(self.temporary, store(self.path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        if not self.many:
            if os.path.exists(self.temporary):
                os.remove(self.temporary)
            return
        fs = store(self.path)[0]
        for m in messages:
            if m and m.temporary:
                fs.delete_file(m.temporary)


def placed(df: DataFrame, by: list[str], path: str) -> tuple[DataFrame, int]:
    """df with _place, its place in the order of by, and _range, its partition's; and how many rows there are. The order is written to path once; only a number for each partition is seen by the driver."""
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    rows = written(ordered, path)
    part = F.shiftright("_id", 33)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for k, (p, n) in enumerate(counts):
        before.append((p, total, k))
        total += n
    starts = df.sparkSession.createDataFrame(before, "_part long, _before long, _range long")
    out = rows.join(F.broadcast(starts), part == F.col("_part"))
    return out.withColumn("_place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before"), total


def write(df: DataFrame, path: str, interval_us: int, code: int = 5, mapping: dict[str, tuple[int, str]] | None = None, template: str | None = None, by: list[str] | None = None, folder_of_files: bool = False) -> int:
    """Writes df(trace_index, headers, samples) in order of by (trace_index); returns the number of traces.

    As many tasks as the data's ranges write, each at its place. template: a file whose text and binary
    headers are kept. Every trace has as many samples as the first, or the write fails and leaves nothing.
    folder_of_files: a file for each range, in a folder, which read() takes as one; for stores that can't be written at any place.
    """
    spark = df.sparkSession
    spark.dataSource.register(SegyDataSource)
    first = df.select(F.size("samples").alias("n")).first()
    n = first["n"] if first else 0
    table = None
    one = df.agg(F.count("*").alias("n"), F.min("trace_index").alias("low"), F.max("trace_index").alias("high"), F.count_distinct("trace_index").alias("distinct")).first() if (by or ["trace_index"]) == ["trace_index"] else None
    if one and not folder_of_files and one["n"] == one["distinct"] and one["n"] == (one["high"] or 0) - (one["low"] or 0) + (one["n"] > 0):
        # each number once, without a gap: a trace's place follows from it, and no trace is shuffled
        rows, total = df.withColumn("_place", F.col("trace_index") - F.lit(one["low"] or 0)), one["n"]
    else:
        table = folder(spark)
        rows, total = placed(df, by or ["trace_index"], table)
        if folder_of_files and total:
            rows = rows.repartitionByRange("_range").sortWithinPartitions("_range", "_place")
    options = {"header": file_header(interval_us, n, code, template).hex(), "n": n, "interval": interval_us, "code": code, "total": total, "mapping": json.dumps(mapping or STANDARD_HEADERS), "many": str(folder_of_files).lower()}
    try:
        rows.write.format("segy").options(**{k: str(v) for k, v in options.items()}).mode("append").save(path)
    finally:
        if table:
            delete(spark, table)
    return total
