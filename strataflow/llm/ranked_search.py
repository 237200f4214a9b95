"""Ranked lexical search: the best documents for each test item, by sort-based accumulation.

1. Statistics. A pass over all texts counts documents, terms and, for terms of the items only, documents
   that hold each. It writes what the second pass needs: each document's number of terms, and the numbers
   and occurrences of the items' terms in it.
2. Accumulation. A term's impact in a document is computed for a block of documents at once, and matched
   arrays are concatenated: for each occurrence of the term in an item, the item, the document and the
   impact. Item and document are packed to one key of 32 bits, keys are radix sorted by two digits of 16
   bits, and runs of equal keys are summed by numpy's reduceat. All sums of a document for an item are thus
   made where the document is; no impact is shuffled.
3. Selection. A block's best are selected from its scores' heap (numpy's partition, then exactly by document),
   and kept per item while the task goes on. What tasks return is partitioned by ranges of item and group, a
   group being at most GROUP tasks, and each group keeps its best; then the groups' best are ranked. Each step
   holds a bounded number of rows for an item and group, however many documents there are.

Distinct items are dealt to parts of PART_BYTES of text, about, by hash. A part's terms go to all workers,
and each part is a pass over the texts: no worker, nor the driver, holds more than a part, whatever the
number of items. Results don't depend on the parts.

Terms are runs of ASCII letters and digits and all characters beyond ASCII, lower-cased A-Z. Null texts
have no term. Each row of docs is a document of its own, also under a repeated or null doc_id; equal scores
are ordered by doc_id, nulls last. Each row of items is an item of its own, so an item that is there twice
has its rows twice; items without a matching document have none. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.shared import cut, joined, utf8

BEST = 20
PART_BYTES = 4 << 20
#: Impacts and documents that are summed at once; documents are numbered by 16 bits.
MOST_IMPACTS, MOST_DOCS = 1 << 21, 1 << 16
#: Items of a packed key are numbered by 16 bits.
MOST_ITEMS = 1 << 16
#: Tasks whose best are selected together.
GROUP = 256
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Items(NamedTuple):
    """A part's items: their ids, how often each is there, and by term those that hold it: of term k item[start[k]:start[k + 1]], once for each time."""

    ids: list[int | None]
    copies: list[int]
    start: np.ndarray
    item: np.ndarray


def ranges_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of a part's items, each of at most MOST_ITEMS items and PART_BYTES of text, or a single longer one."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and (size + len(text) > PART_BYTES or k - start >= MOST_ITEMS):
            yield start, k
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def numbered(texts: list[bytes]) -> dict[bytes, int]:
    """A number for each term of the texts."""
    numbers: dict[bytes, int] = {}
    for text in texts:
        for term in terms_of(text):
            numbers.setdefault(term, len(numbers))
    return numbers


def inverted(texts: list[bytes], numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """start and item of Items for these texts."""
    term = [numbers[t] for text in texts for t in terms_of(text)]
    owner = np.repeat(np.arange(len(texts)), [len(terms_of(text)) for text in texts])
    order = np.argsort(term, kind="stable")
    return np.searchsorted(np.array(term, np.int64)[order], np.arange(len(numbers) + 1)), owner[order]


def matched(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) for each row: its number of terms, and the numbers and occurrences of those in numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joined(batches):
            n, terms, tfs, ends = [], [], [], [0]
            for text in utf8(t):
                words = terms_of(text)
                own = Counter(numbers[w] for w in words if w in numbers)
                n.append(len(words))
                terms += own.keys()
                tfs += own.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.record_batch({"doc_id": t["doc_id"].combine_chunks(), "n": pa.array(n, pa.int64()), "terms": lists[0], "tfs": lists[1]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weights(n_docs: int, having: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in having.tolist()], np.int64)


def radix_sorted(keys: np.ndarray) -> np.ndarray:
    """The order of keys (uint32), by their lower and then their upper 16 bits; numpy sorts 16 bits by radix."""
    low = np.argsort(keys.astype(np.uint16), kind="stable")
    return low[np.argsort((keys >> np.uint32(16)).astype(np.uint16)[low], kind="stable")]


def accumulated(items: Items, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) of all pairs that share a term, of matches of terms in documents (numbers below MOST_DOCS)."""
    first, times = items.start[term], items.start[term + 1] - items.start[term]
    ends = np.cumsum(times)
    if not len(ends) or not ends[-1]:
        return (np.empty(0, np.int64),) * 3
    at = np.arange(ends[-1]) + np.repeat(first - (ends - times), times)
    keys = items.item[at].astype(np.uint32) << np.uint32(16) | np.repeat(doc, times).astype(np.uint32)
    order = radix_sorted(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    scores = np.add.reduceat(np.repeat(impact, times)[order], starts)
    found = keys[starts]
    return (found >> np.uint32(16)).astype(np.int64), (found & np.uint32(MOST_DOCS - 1)).astype(np.int64), scores


class Best:
    """The best of each item so far, at most BEST of an item after each add(): items, documents' ids and whether they are null, and scores."""

    def __init__(self) -> None:
        self.rows = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)]

    def add(self, item: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        """item is sorted. Of more than BEST of an item, those below its BEST-th score go first, found by partition; the few left are sorted."""
        hit = np.flatnonzero(score > 0)
        item, doc, null, score = item[hit], doc[hit], null[hit], score[hit]
        edges = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]).tolist() if len(item) else []
        keep = np.ones(len(item), bool)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > BEST:
                keep[a:b] = score[a:b] >= np.partition(score[a:b], b - a - BEST)[b - a - BEST]
        item, doc, null, score = (np.concatenate([x, y[keep]]) for x, y in zip(self.rows, (item, doc, null, score), strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        top = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)])) < BEST
        self.rows = [item[top], *(x[order[top]] for x in (doc, null, score))]


def blocks(table: pa.Table, items: Items) -> Iterator[tuple[int, int]]:
    """Ranges of the table's rows with about MOST_IMPACTS matches of items each, MOST_DOCS rows at most."""
    term = table["terms"].combine_chunks()
    flat = term.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(items.start[flat + 1] - items.start[flat])])[term.offsets.to_numpy()]
    start = 0
    while start < table.num_rows:
        end = int(np.searchsorted(ends, ends[start] + MOST_IMPACTS, side="right")) - 1
        end = min(max(end, start + 1), start + MOST_DOCS, table.num_rows)
        yield start, end
        start = end


def selected(found: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(item, item_id, copies, doc_id, score): each task's best documents for each of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best()
        for whole in joined(batches, "terms"):
            for start, end in blocks(whole, items):
                t = whole.slice(start, end - start).combine_chunks()
                terms, tfs = t["terms"].combine_chunks(), t["tfs"].combine_chunks()
                term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
                doc = np.repeat(np.arange(t.num_rows), np.diff(terms.offsets.to_numpy()))
                m = 75 + 25 * t["n"].to_numpy() * n_docs // n_terms
                ids = t["doc_id"].combine_chunks()
                item, at, score = accumulated(items, term, doc, weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc])))
                best.add(item, ids.fill_null(0).to_numpy()[at], ids.is_null().to_numpy(zero_copy_only=False)[at], score)
        item, doc, null, score = best.rows
        own = [[x[k] for k in item.tolist()] for x in (items.ids, items.copies)]
        yield pa.record_batch({"item": pa.array(item), "item_id": pa.array(own[0], pa.int64()), "copies": pa.array(own[1], pa.int64()), "doc_id": pa.array(doc, mask=null), "score": pa.array(score)})

    return found.mapInArrow(run, "item long, item_id long, copies long, doc_id long, score long")


def ranked(best: DataFrame, *keys: str) -> DataFrame:
    """The BEST rows of each of the keys, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def passed(docs: DataFrame, ids: list[int | None], copies: list[int], texts: list[bytes]) -> DataFrame:
    """(item, item_id, copies, doc_id, score): what one pass over the texts selects for these items, which all tasks get."""
    numbers = numbered(texts)
    found = cut(matched(docs, numbers), "matched")
    n_docs, n_terms = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = np.zeros(len(numbers), np.int64)
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # at most one row for each of the items' terms
    having[counts["term"].to_numpy()] = counts["n"].to_numpy()
    items = Items(ids, copies, *inverted(texts, numbers))
    return selected(found.where("n > 0"), items, weights(n_docs, having), n_docs, max(1, n_terms)).withColumn("tasks", F.floor(F.spark_partition_id() / GROUP))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) the BEST rows of docs(doc_id, text) by score."""
    rows = cut(items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item_id", "text").agg(F.count("*").alias("copies")), "items")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_parts = max(1, math.ceil(size / PART_BYTES), math.ceil(2 * n / MOST_ITEMS))
    out, passes = None, 0
    for part in range(n_parts):
        listed = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part).toArrow()
        texts, ids, copies = utf8(listed), listed["item_id"].to_pylist(), listed["copies"].to_pylist()
        for a, b in ranges_of(texts):
            more = cut(passed(docs, ids[a:b], copies[a:b], texts[a:b]), "best").withColumn("pass", F.lit(passes))
            out, passes = more if out is None else out.unionByName(more), passes + 1
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    grouped = ranked(out.repartitionByRange("pass", "item", "tasks"), "pass", "item", "tasks")
    final = ranked(grouped.drop("rank"), "pass", "item")
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return final.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", each.alias("copy")).drop("copy")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, ts, len(ts) AS n FROM t WHERE len(ts) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
i AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
q AS (SELECT k, term, count(*) AS times FROM (SELECT k, unnest(ts) AS term FROM i) GROUP BY k, term),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM d, s),
x AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS impact FROM p JOIN w USING (term) JOIN m USING (r)),
f AS (SELECT k, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY k, r, doc_id),
o AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o JOIN i USING (k) WHERE rank <= 20"""
