"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. So each
distinct fingerprint stands for its ball, all values within r = 2 bits (2,081 for 64 bits), and
fingerprints whose balls meet are linked; as what meets at a value is within 2r bits of each other,
linking a value's fingerprints to the least of them loses no link and adds none.

Balls aren't shuffled value by value: a ball's values are dealt by their leading bits, to which a
fingerprint is sent once for each way to flip up to r of them (79 for 12 bits, instead of 2,081
rows). A task then forms the rest of the ball within its leading bits, slice by slice, finds values
that occur twice by sorting, and returns links, at most one per fingerprint, never pairs.

Texts are hashed in lower case (A-Z), by shingles of words, repeats included; a text of fewer words
is one shingle, an empty or null one has fingerprint zero and is linked like any other. Rows with a
null doc_id take part; a component's id is its smallest non-null doc_id. Repeated rows give repeated
results; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.components import components
from strataflow.llm.shared import cut, joined, joined_evenly, utf8

SEED = 42
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16
#: Values of balls that a task sorts at once, about.
MOST_VALUES = 1 << 22
#: Leading bits that balls are dealt by, more where a value of them would get more than so many fingerprints on average.
LEADING, MOST_ROWS = 12, 1 << 16


def fingerprint(text: bytes, words_each: int = 4) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return h(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - words_each].tolist(), ends[words_each - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, BLOCK):
        hashes = np.array([h(line[s:e], SEED) for s, e in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, words_each: int = 4, *more: Column) -> DataFrame:
    """(doc_id, more, fp): fp as a signed long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joined(batches):
            fp = np.array([fingerprint(x, words_each) for x in utf8(t)], np.uint64).view(np.int64)
            yield pa.record_batch({**{c: t[c].combine_chunks() for c in kept}, "fp": pa.array(fp)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text")
    kept = rows.columns[:-1]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def flips(bits: int, most: int) -> list[int]:
    """Masks of up to so many of the lowest bits."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def link(labels: np.ndarray, value: np.ndarray, who: np.ndarray) -> None:
    """Joins, in labels (each a place of labels, roots their own), whoever share a value."""
    order = np.argsort(value, kind="stable")
    value, who = value[order], who[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(value)]))
    while True:
        roots = labels[who]
        least = np.minimum.reduceat(roots, first)[group]
        if (roots == least).all():
            return
        np.minimum.at(labels, roots, least)
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = up


def meeting(fps: np.ndarray, leading: int, bits: int, radius: int) -> np.ndarray:
    """For each of the fingerprints (uint64), the place of the least one that it is linked to through values whose leading bits are as given."""
    rest = 64 - bits
    used = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(leading)).astype(np.int64)
    low = fps & np.uint64((1 << rest) - 1)
    labels = np.arange(len(fps))
    masks = {t: np.array(flips(rest, radius - t), np.uint64) for t in range(radius + 1)}
    sliced = sum(int((used == t).sum()) * len(masks[t]) for t in masks) > MOST_VALUES
    width = np.uint64(63 if sliced else 0)
    for part in range(64 if sliced else 1):
        values, whose = [], []
        for t, m in masks.items():
            for own in np.unique(low[used == t] & width):
                who = np.flatnonzero((used == t) & (low & width == own))
                fit = m[(m & width) == (own ^ np.uint64(part))]
                values.append((low[who][:, None] ^ fit[None, :]).ravel())
                whose.append(np.repeat(who, len(fit)))
        value, who = np.concatenate(values), np.concatenate(whose)
        ordered = np.sort(value)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
            hit = twice[at] == value
            link(labels, at[hit], who[hit])
    return labels


def links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(a, b) long: links that join whatever of the n distinct fingerprints differ in at most radius bits. radius is even."""
    half = radius // 2
    bits = LEADING
    while n * len(flips(bits, half)) > MOST_ROWS << bits and bits < 24:
        bits += 2

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = np.sort(group["fp"].to_numpy().view(np.uint64))
        labels = meeting(found, key[0], bits, half)
        moved = np.flatnonzero(labels != np.arange(len(found)))
        return pd.DataFrame({"a": found[moved].view(np.int64), "b": found[labels[moved]].view(np.int64)})

    leading = F.shiftrightunsigned("fp", 64 - bits)
    near = F.array(*[F.lit(m).cast("long") for m in flips(bits, half)])
    dealt = fps.select("fp", F.explode(F.transform(near, lambda m: leading.bitwiseXOR(m))).alias("leading"))
    return dealt.groupBy("leading").applyInPandas(run, "a long, b long").distinct()


def rooted(first: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root) of distinct fingerprints (fp, first): those that links of at most radius bits join share a root."""
    found = cut(links(first.select("fp"), first.count(), radius), "links")
    if found.isEmpty():
        return first.select("fp", "first", F.col("fp").alias("root"))
    return cut(first.join(components(found), first["fp"] == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")


def survivors(docs: DataFrame, words_each: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, text_hash, n): for each component the row of the smallest doc_id, nulls last, among equals of the least hash of its text; and how many rows have both."""
    rows = cut(fingerprints(docs, words_each, F.xxhash64("text").alias("text_hash")), "fingerprints")
    same = rows.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n"))
    first = cut(same.groupBy("fp").agg(least.alias("first")), "distinct")
    return rooted(first, radius).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash", "first.n")


def near_duplicates(docs: DataFrame, words_each: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text): 16 hex digits, and the smallest doc_id that links of at most radius bits lead to."""
    rows = cut(fingerprints(docs, words_each), "fingerprints")
    first = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")), "distinct")
    n_rows, n_first = first.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count("*")).first()
    ids = rooted(first.select("fp", "first"), radius)
    groups = cut(ids.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "groups")
    ids = joined_evenly(ids, groups, "root", "n", n_first).select("fp", "component_id").join(first.select("fp", "n_rows"), "fp")
    out = joined_evenly(rows, cut(ids, "ids"), "fp", "n_rows", n_rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
