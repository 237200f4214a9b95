"""Sorted arrays of 64-bit hashes in the shared folder, dealt to shards by leading bits and memory-mapped by workers.

Tasks write a shard's arrays to one file, under a temporary name, and move it into place, so a task
that runs twice, or again after an executor was lost, leaves the same files. A shared folder of this
machine's file system is mapped where it lies; from any other store, a worker copies what it opens to
an unnamed local file, which ends with the mapping.

A mapping holds no file open, and a worker has at most MOST_MAPS of each arrays' shards mapped, so
what it opens is bounded however many shards there are.
"""

from __future__ import annotations

import json
import mmap
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs

#: Shards of one HashArrays or Counts that a worker has mapped at once. A system allows a process 65,530 mappings; before Python 3.13 each holds a file open, of which often 1,024 are allowed.
MOST_MAPS, _MAPPED = (4096, {"trackfd": False}) if sys.version_info >= (3, 13) else (64, {})


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def save_bytes(uri: str, *content: bytes | np.ndarray) -> None:
    """Writes a file of these parts under a temporary name and moves it into place."""
    fs, path = _store(uri)
    folder, name = path.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        for part in content:
            f.write(part)
    fs.move(temporary, path)


def load_bytes(uri: str) -> bytes:
    fs, path = _store(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def save(uri: str, shard: int, **arrays: np.ndarray) -> None:
    """Writes a shard's arrays to one file, after their names, kinds and lengths; key is sorted uint64, the others go along with it."""
    head = json.dumps([(name, a.dtype.str, len(a)) for name, a in arrays.items()]).encode()
    parts = [head, *(np.ascontiguousarray(a).view(np.uint8) for a in arrays.values())]
    save_bytes(f"{uri}/{shard:06d}", len(head).to_bytes(8, "little"), *(x for p in parts for x in (p, bytes(-len(p) % 8))))


class Shards:
    """The arrays of these names that save() wrote with 2**bits shards, each shard mapped when it is first needed."""

    def __init__(self, uri: str, bits: int, *names: str):
        self.fs, self.path = _store(uri)
        self.bits, self.names, self.shards = bits, names, {}

    def mapped(self, shard: int) -> mmap.mmap:
        path = f"{self.path}/{shard:06d}"
        if isinstance(self.fs, pa.fs.LocalFileSystem):
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_MAPPED)
        with tempfile.TemporaryFile() as f, self.fs.open_input_stream(path) as source:
            while block := source.read(1 << 24):
                f.write(block)
            f.flush()
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_MAPPED)

    def opened(self, shard: int) -> tuple[np.ndarray, ...]:
        if self.fs.get_file_info(f"{self.path}/{shard:06d}").type != pa.fs.FileType.File:
            return tuple(np.empty(0, np.uint64) for _ in self.names)
        raw = self.mapped(shard)
        at = 8 + int.from_bytes(raw[:8], "little")
        found = {}
        for name, kind, n in json.loads(raw[8:at]):
            at += -at % 8
            found[name] = np.frombuffer(raw, kind, n, at)
            at += found[name].nbytes
        return tuple(found[name] for name in self.names)

    def shard(self, k: int) -> tuple[np.ndarray, ...]:
        """A shard's arrays; empty ones where nothing was sent to it, so that no task wrote it. Lookups go through shards in order again and again, so of too many the one mapped last goes."""
        if k not in self.shards:
            while len(self.shards) >= MOST_MAPS:
                self.shards.popitem()
            self.shards[k] = self.opened(k)
        return self.shards[k]


class HashArrays(Shards):
    """Arrays that go along with a key, which is first."""

    def __init__(self, uri: str, bits: int, *names: str):
        super().__init__(uri, bits, "key", *names)

    def find(self, keys: np.ndarray, missing: tuple = (), step: int = 0) -> tuple[np.ndarray, ...]:
        """For each key (uint64): whether it is there, then its values, missing ones where it isn't; of equal keys, those of the entry that step counts from 0. Queries go through a shard in order, so pages are touched once."""
        unique, back = np.unique(keys, return_inverse=True)
        found, *values = self.find_sorted(unique, missing, step)
        return found[back], *(v[back] for v in values)

    def find_sorted(self, unique: np.ndarray, missing: tuple = (), step: int = 0) -> tuple[np.ndarray, ...]:
        """find() for keys that are sorted and different."""
        found = np.zeros(len(unique), bool)
        values = [np.full(len(unique), m) for m in missing]
        edges = np.searchsorted(unique >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for k in range(1 << self.bits):
            a, b = edges[k], edges[k + 1]
            if a == b:
                continue
            key, *more = self.shard(k)
            if not len(key):
                continue
            at = np.minimum(np.searchsorted(key, unique[a:b]) + step, len(key) - 1)
            hit = key[at] == unique[a:b]
            found[a:b] = hit
            for v, m in zip(values, more, strict=True):
                v[a:b] = np.where(hit, m[at], v[a:b])
        return found, *values


def shard_edges(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys, for the shards that have any."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(k, int(edges[k]), int(edges[k + 1])) for k in range(1 << bits) if edges[k] < edges[k + 1]]


def _narrowed(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """40 bits of each key beyond those that tell its shard."""
    rest = keys << np.uint64(bits)
    return (rest >> np.uint64(32)).astype(np.uint32), (rest >> np.uint64(24)).astype(np.uint8)


def _places(stored: tuple[np.ndarray, ...], asked: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys asked, sorted and different, are stored, and where. Keys are one array, or heads that are sorted and tails."""
    at = np.searchsorted(stored[0], asked[0])
    np.minimum(at, len(stored[0]) - 1, out=at)
    same = stored[0][at] == asked[0]
    left = np.flatnonzero(same & (stored[1][at] == asked[1]) if len(stored) > 1 else same)
    found = [(left, at[left])]
    if len(left) < np.count_nonzero(same):  # heads are equal rarely
        same[left] = False
        left = np.flatnonzero(same)
        at = at[left] + 1
        while len(left):
            at, left = at[inside := at < len(stored[0])], left[inside]
            same = stored[0][at] == asked[0][left]
            at, left = at[same], left[same]
            hit = stored[1][at] == asked[1][left]
            found.append((left[hit], at[hit]))
            at, left = at[~hit] + 1, left[~hit]
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def save_counts(uri: str, shard: int, bits: int, key: np.ndarray, fields: np.ndarray, usual: tuple[int, ...] = (), exact: bool = False) -> None:
    """Writes a shard's rows of small numbers, with keys of 64 bits if exact, else of 40 beyond those that tell the shard (a key that isn't there is taken for one that is once in a million shards' entries, about): as bytes where all fit, as bare keys where they are the usual ones, else as long integers."""
    bare = (fields == np.array(usual)).all(axis=1) if usual else np.zeros(len(key), bool)
    large = fields.max(axis=1, initial=0) > 255
    arrays = {}
    for kind, at, form in (("bare", bare, None), ("small", ~bare & ~large, np.uint8), ("large", large & ~bare, np.int64)):
        arrays |= {f"{kind}.{name}": x for name, x in zip(("key", "tail"), (key[at],) if exact else _narrowed(key[at], bits), strict=False)}
        if form:
            arrays |= {f"{kind}.f{k}": fields[at, k].astype(form) for k in range(fields.shape[1])}
    save(uri, shard, **arrays)


class Counts:
    """What save_counts() wrote with 2**bits shards and so many fields."""

    def __init__(self, uri: str, bits: int, n_fields: int, usual: tuple[int, ...] = (), exact: bool = False):
        keys, fields = ("key",) if exact else ("key", "tail"), [f"f{k}" for k in range(n_fields)]
        self.bits, self.n_fields, self.usual, self.n_keys = bits, n_fields, usual, len(keys)
        self.kinds = [*([("bare", keys)] if usual else []), ("small", (*keys, *fields)), ("large", (*keys, *fields))]
        self.arrays = Shards(uri, bits, *(f"{kind}.{name}" for kind, names in self.kinds for name in names))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For each key its numbers, zeros where it isn't there: a matrix."""
        unique, back = np.unique(keys, return_inverse=True)
        return self.find_sorted(unique)[back]

    def find_sorted(self, unique: np.ndarray) -> np.ndarray:
        """find() for keys that are sorted and different; no part sorts them again."""
        out = np.zeros((len(unique), self.n_fields), np.int64)
        whole = (unique,) if self.n_keys == 1 else _narrowed(unique, self.bits)
        for k, a, b in shard_edges(unique, self.bits):
            arrays, asked, rows = self.arrays.shard(k), tuple(x[a:b] for x in whole), None
            for kind, names in self.kinds:
                stored, values, arrays = arrays[: self.n_keys], arrays[self.n_keys : len(names)], arrays[len(names) :]
                if rows is not None and not len(rows):
                    break
                if not len(stored[0]):
                    continue
                hit, at = _places(stored, asked)
                to = hit + a if rows is None else rows[hit]
                for f, v in enumerate(values):
                    out[to, f] = v[at]
                if kind == "bare":
                    out[to] = self.usual
                if kind != "large":
                    rows = np.arange(a, b) if rows is None else rows
                    left = np.ones(len(rows), bool)
                    left[hit] = False
                    asked, rows = tuple(x[left] for x in asked), rows[left]
        return out
