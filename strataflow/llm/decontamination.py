"""Benchmark decontamination: training passages as queries to a BM25 index of test items, by block-max WAND.

Items are indexed in segments of at most SEGMENT words. Impacts (BM25 weights of a segment's terms, by
statistics of all items) are divided by the segment's sum, so a passage's score is the share of the
segment's weight that its terms hold. A document's words go in halves of SEGMENT words; a passage is two
neighbouring halves, so each occurrence of a segment lies in one. Every passage is a query, and every
segment that reaches THRESHOLD is retrieved, none is capped:

* Block maxima, of groups of blocks first and of BLOCK segments then, bound a passage's scores from
  above. The bounds of a batch's passages are summed together; blocks that can't reach the threshold
  are never opened.
* In the blocks that are left, the passage's postings are walked in segments' order: terms, sorted by
  the segment they stand at, add their block maxima until the threshold is reached; there is the pivot.
  Lists behind it skip to it, and only a pivot that all of them reach is scored.

An item with a retrieved segment is confirmed if its question (all but the last sentence) and its answer
(the last one) each have OVERLAP of their 5-word shingles in the passage with as many words around it as
the item has.

Items are dealt to parts of INDEX_BYTES of text, about. Each part's index is built by a task, with
statistics of all parts, and written to the shared folder; documents go by all parts in one pass and
aren't shuffled. Results don't depend on how many parts there are.

Words are lower-cased (A-Z), with ASCII punctuation as space. Nulls are empty texts, which are never
contaminated; items without words are left out. Repeated rows are judged each; doc_id may be null.
Items of null item_id are indexed like others: a text that holds any of them has one null at the end
of its ids, which counts as one item. Repeated items are one. Extra columns of docs are kept by
with_items() and clean(), whose own column takes underscores after its name where docs has that name.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.hash_arrays import load_bytes, save_bytes
from strataflow.llm.shared import cut, joined, scratch, unused, utf8

SHINGLE, OVERLAP = 5, 0.8
THRESHOLD, SEGMENT = 0.6, 64
#: Segments of a block, and blocks of a group.
BLOCK, GROUP = 4, 8
K1, B = 1.2, 0.75
INDEX_BYTES = 128 << 10
#: What sums of bounds may lack by rounding.
ROUNDING = 1e-4
_TABLE = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def shingles(words: list[bytes], k: int = SHINGLE) -> set[bytes]:
    """The words' runs of k, or all of them as one if there are fewer."""
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


class Statistics(NamedTuple):
    """Of all items: how many segments there are and how many have a term, and a segment's mean number of words."""

    n: int
    mean: float
    having: dict[bytes, int]


class Item(NamedTuple):
    """An item's id, its number of words, and the shingles of its question and its answer."""

    item_id: int | None
    size: int
    parts: tuple[set[bytes], set[bytes]]


class Index(NamedTuple):
    """owner: the place in items of each segment; terms: numbers of terms; bound, group_bound: by term and block, or group of blocks, the highest impact; postings: by term, its segments in order and its impacts there."""

    items: list[Item]
    owner: list[int]
    terms: dict[bytes, int]
    bound: np.ndarray
    group_bound: np.ndarray
    postings: list[tuple[list[int], list[float]]]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words before the last sentence, and its own; a single sentence is all question."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s", text) if (w := words_of(s.encode()))]
    if len(sentences) < 2:
        return (sentences or [[]])[0], []
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def nulls_last(item_id: int | None) -> tuple[bool, int]:
    return item_id is None, item_id or 0


def segments(words: list[bytes]) -> list[list[bytes]]:
    """The words in as few parts of at most SEGMENT as there can be, of equal sizes."""
    n = math.ceil(len(words) / SEGMENT)
    return [words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n)]


def statistics(texts: list[str]) -> Statistics:
    own = [s for t in texts for s in segments(words_of(t.encode()))]
    return Statistics(len(own), sum(map(len, own)) / max(1, len(own)), Counter(w for s in own for w in set(s)))


def build(items: list[tuple[int | None, str]], of_all: Statistics | None = None) -> Index:
    """An index of distinct (item_id, text), some or all of those that the statistics are of."""
    kept = sorted(((i, t) for i, t in items if words_of((t or "").encode())), key=lambda x: (nulls_last(x[0]), x[1]))
    of_all = of_all or statistics([t for _, t in kept])
    own, owner, bags = [], [], []
    for k, (i, t) in enumerate(kept):
        words = words_of(t.encode())
        own.append(Item(i, len(words), tuple(map(shingles, question_and_answer(t)))))
        for s in segments(words):
            owner.append(k)
            bags.append(Counter(s))
    terms = {w: k for k, w in enumerate({w: 0 for b in bags for w in b})}
    postings: list[tuple[list[int], list[float]]] = [([], []) for _ in terms]
    n_blocks = max(1, math.ceil(len(bags) / BLOCK))
    bound = np.zeros((len(terms) + 1, math.ceil(n_blocks / GROUP) * GROUP), np.float32)
    for k, bag in enumerate(bags):
        long = K1 * (1 - B + B * sum(bag.values()) / of_all.mean)
        impact = {w: math.log(1 + (of_all.n - of_all.having[w] + 0.5) / (of_all.having[w] + 0.5)) * n * (K1 + 1) / (n + long) for w, n in bag.items()}
        whole = math.fsum(impact.values())
        for w, x in impact.items():
            t, b = terms[w], k // BLOCK
            bound[t, b] = max(bound[t, b], x / whole)
            postings[t][0].append(k)
            postings[t][1].append(x / whole)
    return Index(own, owner, terms, bound, bound.reshape(len(terms) + 1, -1, GROUP).max(axis=2), postings)


def retrieved(index: Index, terms: list[int], live: list[int]) -> list[int]:
    """The segments that reach the threshold for a passage of these distinct terms, among those of the live blocks (in order)."""
    lists = [(index.postings[t][0], index.postings[t][1], index.bound[t]) for t in terms]
    at = [0] * len(lists)
    out, d = [], 0
    for block in live:
        d, end = max(d, block * BLOCK), (block + 1) * BLOCK
        while d < end:
            stands = []
            for k, (own, _, _) in enumerate(lists):
                at[k] = bisect_left(own, d, at[k])
                if at[k] < len(own) and own[at[k]] < end:
                    stands.append((own[at[k]], k))
            stands.sort()
            reach, pivot = 0.0, end
            for segment, k in stands:
                reach += lists[k][2][block]
                if reach >= THRESHOLD - ROUNDING:
                    pivot = segment
                    break
            if pivot < end and stands[0][0] == pivot:
                if math.fsum(lists[k][1][at[k]] for segment, k in stands if segment == pivot) >= THRESHOLD - 1e-9:
                    out.append(pivot)
                pivot += 1
            d = pivot
    return out


def confirmed(item: Item, words: list[bytes]) -> bool:
    runs = {k: {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} for k in {SHINGLE, *(len(s.split()) for part in item.parts for s in part)}}
    return all(sum(s in runs[len(s.split())] for s in part) >= OVERLAP * len(part) for part in item.parts)


class Batch:
    """A batch's words: of each text, its number, the halves they make, and what half each word is in."""

    def __init__(self, texts: list[bytes]):
        self.words = list(map(words_of, texts))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        halves = (self.lengths + SEGMENT - 1) // SEGMENT
        self.start = np.cumsum(halves) - halves
        self.n = int(halves.sum())
        at = np.arange(int(self.lengths.sum())) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.half = np.repeat(self.start, self.lengths) + at // SEGMENT
        self.owner = np.repeat(np.arange(len(texts)), halves)
        self.last = np.r_[self.owner[1:] != self.owner[:-1], np.ones(min(1, self.n), bool)]


def _bounds(bound: np.ndarray, half: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """The sums of bounds of each half's distinct terms."""
    out = np.zeros((n + 1, bound.shape[1]), np.float32)
    first = np.flatnonzero(np.r_[np.ones(min(1, len(half)), bool), half[1:] != half[:-1]])
    if len(first):
        out[half[first]] = np.add.reduceat(bound[term], first, axis=0)
    return out


def matches(index: Index, batch: Batch) -> list[set[int | None]]:
    """For each text of the batch, the ids of the items that it holds."""
    look = index.terms.get
    out: list[set[int | None]] = [set() for _ in batch.words]
    ids = np.concatenate([np.empty(0, np.int32), *(np.fromiter(map(look, w, repeat(-1)), np.int32, len(w)) for w in batch.words)])
    known = ids >= 0
    half, term = np.divmod(np.unique(batch.half[known] * np.int64(len(index.terms) + 1) + ids[known]), len(index.terms) + 1)
    if not len(half):
        return out
    single = batch.last[:, None]
    by_group = _bounds(index.group_bound, half, term, batch.n)
    groups = by_group[:-1] + np.where(single, 0, by_group[1:]) >= THRESHOLD - ROUNDING
    passages = np.flatnonzero(groups.any(axis=1))
    used = np.zeros(batch.n + 1, bool)
    used[passages] = used[passages + 1] = True
    within = used[half]
    by_block = _bounds(index.bound, half[within], term[within], batch.n)
    live = by_block[passages] + np.where(single[passages], 0, by_block[passages + 1]) >= THRESHOLD - ROUNDING
    live &= np.repeat(groups[passages], GROUP, axis=1)
    edges = np.searchsorted(half, np.arange(batch.n + 2))
    for row in np.flatnonzero(live.any(axis=1)).tolist():
        h = int(passages[row])
        d = int(batch.owner[h])
        distinct = np.unique(term[edges[h] : edges[h + 1 if batch.last[h] else h + 2]]).tolist()
        for k in sorted({index.owner[s] for s in retrieved(index, distinct, np.flatnonzero(live[row]).tolist())}):
            item = index.items[k]
            if item.item_id in out[d]:
                continue
            begin = (h - int(batch.start[d])) * SEGMENT
            if confirmed(item, batch.words[d][max(0, begin - item.size) : begin + 2 * SEGMENT + item.size]):
                out[d].add(item.item_id)
    return out


def compiled(items: DataFrame) -> tuple[str, list[int]]:
    """Builds the index of items(item_id, text) in the shared folder; returns its path and the parts that have items. The driver sees two totals, no item."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    n_parts = math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / INDEX_BYTES) or 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)).cast("int"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [segments(words_of(t)) for t in utf8(pa.Table.from_batches([b]))]
            terms = [[w for s in x for w in set(s)] for x in own]
            yield pa.record_batch({"part": b.column(b.schema.get_field_index("part")), "terms": pa.array(terms, pa.list_(pa.binary())), "n": pa.array(map(len, own), pa.int64()), "words": pa.array([sum(map(len, x)) for x in own], pa.int64())})

    found = cut(rows.mapInArrow(listed, "part int, terms array<binary>, n long, words long"), "item-terms")
    n, words = (x or 0 for x in found.agg(F.sum("n"), F.sum("words")).first())
    having = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("having"))
    own = found.select("part", F.explode("terms").alias("term")).distinct().join(having, "term").select("part", "term", "having")
    path = scratch(spark, "items")

    def built(table: pa.Table, terms: pa.Table) -> pa.Table:
        of_all = Statistics(n, words / max(1, n), dict(zip(terms["term"].to_pylist(), terms["having"].to_pylist(), strict=True)))
        part = table["part"][0].as_py()
        save_bytes(f"{path}/{part}", pickle.dumps(build(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)), of_all)))
        return pa.table({"part": pa.array([part], pa.int32())})

    parts = [r["part"] for r in rows.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(lambda t, w: built(t, w) if t.num_rows else pa.table({"part": pa.array([], pa.int32())}), "part int").collect()]  # a number for each part
    return path, sorted(parts)


@lru_cache(maxsize=8)
def _opened(path: str) -> Index:
    return pickle.loads(load_bytes(path))


def with_items(docs: DataFrame, items: DataFrame, into: str = "benchmark_items") -> DataFrame:
    """docs with the sorted ids of the items that each text holds, a null last, in a column of that name, or with underscores after it where docs has that name."""
    into = unused(docs.columns, into)
    path, parts = compiled(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joined(batches):
            batch = Batch(utf8(t))
            found: list[set[int | None]] = [set() for _ in range(t.num_rows)]
            for part in parts:
                for have, new in zip(found, matches(_opened(f"{path}/{part}"), batch), strict=True):
                    have |= new
            yield from t.append_column(into, pa.array([sorted(x, key=nulls_last) for x in found], pa.list_(pa.int64()))).to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.LongType()))]))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) for each row of docs(doc_id, text) and items(item_id, text)."""
    out = with_items(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items)
    n = F.size("benchmark_items")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.col("benchmark_items").alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    into = unused(docs.columns, "benchmark_items")
    return with_items(docs, items).where(F.size(into) == 0).drop(into)
