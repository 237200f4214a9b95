"""What the operators share: inputs, the shared folder, Arrow batches and words.

Words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed and
carriage return. bytes.split() splits at these six, so on UTF-8 bytes it gives the same words.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same words for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a Python worker holds at once.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


#: The temporary folder of each application, where the cluster names none, and the scratch paths made and not deleted.
_temporary: dict[str, str] = {}
_made: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where the cluster names none, a temporary one of this machine, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _temporary.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='strataflow-')}"
        _temporary[app] = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which lasts until clear()."""
    _made.append(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def marked() -> int:
    """A mark for clear(): what was made before it stays."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes scratch made since the mark but what keep reads. To be called once results that were read from it are written: DataFrames that an operator returned, and weren't written, can't be read afterwards."""
    files = " ".join(keep.inputFiles()) if keep is not None else ""
    for path in _made[since:]:
        if path.rsplit("/", 1)[1] not in files:
            delete(spark, path)


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores after it until no column has it in any case. Columns of the input keep their names and values."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors lose none of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_evenly(rows: DataFrame, found: DataFrame, key: str, n: str, total: int, parts: int = 1000) -> DataFrame:
    """rows joined to found(key, n, ...), which has each key of rows once and how many of the total rows have it. Keys of more than a part of the total are fewer than parts, so those are broadcast; the rest meet by shuffles."""
    big = F.col(n) * parts > total
    few = F.broadcast(found.where(big))
    rest = rows.join(few.select(key), key, "left_anti").join(found.where(~big), key)
    return rows.join(few, key).unionByName(rest)


def input_bytes(df: DataFrame) -> int:
    """Bytes of all texts, from a native scan; sizes partitions, never results."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards(total_bytes: int, each: int = 24 << 20) -> int:
    """How many parts work on so many bytes is dealt to."""
    return max(8, math.ceil(total_bytes / each))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 128) -> Iterator[None]:
    """Arrow batches of few rows for what is run within, as memory is tight there; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def joined(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Arrow batches put together, or parted, to tables of about so many bytes of the column, a row at least."""
    held, size = [], 0
    for whole in batches:
        at = whole.schema.get_field_index(column)
        rows = max(1, int(whole.num_rows * most / max(1, whole.column(at).nbytes)))
        for start in range(0, whole.num_rows, rows):
            b = whole.slice(start, rows)
            held.append(b)
            size += b.column(at).nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                trim()
    if held:
        yield pa.Table.from_batches(held)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can; a worker otherwise keeps its largest block's."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8(table: pa.Table, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8; null: empty."""
    return [b or b"" for b in table.column(column).cast(pa.binary()).to_pylist()]


#: A worker forgets its words' hashes beyond so many.
MOST_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def hashed_words(texts: Iterable[bytes], sizes: list[int]) -> np.ndarray:
    """64-bit hashes of all words of the texts, one after the other; sizes gets each text's number of words."""
    look, parts = _hashes.__getitem__, [np.empty(0, np.uint64)]
    for text in texts:
        words = text.split()
        sizes.append(len(words))
        parts.append(np.fromiter(map(look, words), np.uint64, len(words)))
    return np.concatenate(parts)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes (uint64) whose every bit depends on all of h's."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """The words of texts, as places in the texts' bytes, each text between two line feeds: each word's first byte and the one after its last, and each text's number of words."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sizes: np.ndarray


def gaps(raw: np.ndarray) -> np.ndarray:
    """Which bytes part words."""
    return (raw == 32) | (raw - np.uint8(9) < 5)


def words_of(texts: list[bytes]) -> Words:
    raw = np.frombuffer(b"\n".join([b"", *texts, b"\n" * 8]), np.uint8)
    inside = ~gaps(raw)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = edges.astype(np.int32) if len(raw) < 1 << 31 else edges
    start, end = edges[::2].copy(), edges[1::2].copy()
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Words(raw, start, end, np.diff(np.searchsorted(start, bounds.astype(start.dtype))))


#: Longer words' hashes are xxhash's; of shorter ones, eight bytes are taken at a time, of all words at once.
LONG_WORD = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eight(raw: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bytes, eight at most, at each place; raw has eight more behind its last word."""
    return np.ndarray(len(raw) - 7, np.uint64, raw, 0, 1)[at] & _FIRST[np.minimum(n, 8)]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; those of up to eight bytes are told apart without fail if they have one length."""
    import xxhash

    n = end - start
    h = mixed(_eight(raw, start, n) ^ n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    left, k = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
    while len(left):
        h[left] = mixed(h[left] ^ _eight(raw, start[left] + k, n[left] - k))
        k += 8
        left = left[n[left] > k]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return h


def equal_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each word of raw has the bytes of its fellow of other."""
    n = end - start
    same = n == to - at
    left, k = np.flatnonzero(same), 0
    while len(left):
        same[left] = _eight(raw, start[left] + k, n[left] - k) == _eight(other, at[left] + k, n[left] - k)
        k += 8
        left = left[same[left] & (n[left] > k) & (n[left] <= LONG_WORD)]
    for i in np.flatnonzero(same & (n > LONG_WORD)).tolist():
        same[i] = raw[start[i] : end[i]].tobytes() == other[at[i] : to[i]].tobytes()
    return same


#: Bytes of text whose words are hashed at once.
PIECE = 2 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after the other, and each text's number of words."""
    hashes, sizes, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= PIECE:
            size += len(texts[to])
            to += 1
        w = words_of(texts[at:to])
        hashes.append(span_hashes(*w[:3]))
        sizes.append(w.sizes)
        at = to
    return np.concatenate(hashes), np.concatenate(sizes)


def order_of(key: np.ndarray) -> np.ndarray:
    """np.argsort(key, kind="stable") for hashes (uint64): they are sorted by value with their places for last bits, then the few that only those bits would tell apart."""
    bits = np.uint64(len(key).bit_length())
    packed = key >> bits
    packed <<= bits
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    own = key[order]
    wrong = np.flatnonzero(own[1:] < own[:-1])
    if len(wrong) * 16 > len(key):
        return np.argsort(key, kind="stable")
    if len(wrong):
        packed >>= bits
        some = np.unique(packed[wrong])
        at = np.concatenate([np.arange(a, b) for a, b in zip(np.searchsorted(packed, some), np.searchsorted(packed, some, "right"), strict=True)])
        order[at] = order[at][np.argsort(key[order[at]], kind="stable")]
    return order


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(key, return_inverse=True) for hashes (uint64)."""
    order = order_of(key)
    own = key[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    back = np.empty(len(own), np.int64)
    back[order] = np.cumsum(new) - 1
    return own[new], back
