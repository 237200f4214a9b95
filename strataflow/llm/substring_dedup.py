"""Substring dedup: passages of a number of words that an earlier document has, by repeated-phrase automata.

A window is `size` consecutive words; windows are removed that also start in a document of smaller id.

1. Candidates. A window stands for the least hash among its 5-word phrases (its minimizer), which equal
   windows share and neighbouring windows mostly do. Tasks send each minimizer once per block of
   documents, dealt by hash; those that two documents have are kept in sorted hash arrays.
2. Confirmation. Windows with a kept minimizer are sent by two hashes (128 bits) with the least id of
   the block; those of two documents recur, and are kept with the least id that has them.
3. Passages. Of each run of recurring windows that an earlier document has, enough to cover it are sent
   by their words, dealt by minimizer. A shard's distinct passages are compiled to one Aho-Corasick
   automaton over words, once, and stored in the shared folder.
4. Location. All documents are streamed through the automata: for each shard, the stretches of a text
   whose minimizers are dealt to it and recur, as a passage can't lie anywhere else. What the automata
   find, word by word, in a document later than the first that has it, is what goes.

What is shuffled are packed arrays, a row for each block and hash range, summed up within blocks: a
passage of a third of all documents is one entry of each block. Memory is that of a block and of a
hash range, both bounded; a document is never compared with another, and whole texts are not shuffled.

Nulls are empty texts. Rows without a doc_id have no smaller or larger id: nothing is removed from
or for them. Rows of one doc_id are not earlier than each other. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.hash_arrays import HashArrays, load_bytes, save, save_bytes, shard_edges
from strataflow.llm.shared import Words, cut, delete, equal_spans, gaps, input_bytes, joined, mixed, scratch, shards, small_batches, span_hashes, utf8, words_of

SIZE, PHRASE = 13, 5
#: Bytes of text that one hash range is for, and that one shard of automata is for. A shard has 2**PARTS automata, as a node's children are searched one by one, so that roots must not grow wide.
RANGE, SHARD, PARTS = 64 << 20, 64 << 20, 6
#: Bytes of text whose stretches a task gathers before it goes by the automata.
GATHERED = 32 << 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _grams(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of so many words."""
    n = len(words) - size + 1
    out, power = np.zeros(n, np.uint64), np.uint64(base)
    for k in range(size):
        out *= power
        out += words[k : n + k]
    return mixed(out)


class Windows(NamedTuple):
    """A block's words; for each window the place of its document, of its first word among all words, and its hashes."""

    words: Words
    doc: np.ndarray
    at: np.ndarray
    minimizer: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def windows(texts: list[bytes], usable: np.ndarray, size: int = SIZE, hashes: bool = True) -> Windows:
    """The texts' windows; without their own hashes, where minimizers are all that is asked."""
    words = words_of(texts)
    flat, last = span_hashes(*words[:3]), np.cumsum(words.sizes)
    n = len(flat)
    if n < size:
        empty, none = np.empty(0, np.uint64), np.empty(0, np.int64)
        return Windows(words, none, none, empty, empty, empty)
    phrase = min(PHRASE, size)
    phrases = _grams(flat, phrase, _P1)
    least = phrases[: n - size + 1].copy()
    for k in range(1, size - phrase + 1):
        np.minimum(least, phrases[k : n - size + 1 + k], out=least)
    whole = np.repeat(usable, words.sizes)
    for k in range(1, size):
        whole[last[last >= k] - k] = False
    w = np.flatnonzero(whole)
    own = (_grams(flat, size, base)[w] if hashes else np.empty(0, np.uint64) for base in (_P1, _P2))
    return Windows(words, np.repeat(np.arange(len(texts)), words.sizes)[w], w, mixed(least[w]), *own)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["doc_id"].combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _first_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new group starts in columns sorted together."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _minimizers(batches: Iterator[pa.RecordBatch], bits: int, size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """For each block and hash range: minimizers of one document with its id, and those that several have."""
    for t in joined(batches):
        ids, valid = _ids(t)
        w = windows(utf8(t), valid, size, False)
        change = np.ones(len(w.doc), bool)
        change[1:] = (w.minimizer[1:] != w.minimizer[:-1]) | (w.doc[1:] != w.doc[:-1])
        key, doc = w.minimizer[change], ids[w.doc[change]]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        if not len(key):
            continue
        first = _first_of(key)
        last = np.r_[first[1:], len(key)] - 1
        alone = doc[first] == doc[last]
        key, doc = key[first], doc[first]
        for k, a, b in shard_edges(key, bits):
            one = alone[a:b]
            yield pa.record_batch({"shard": pa.array([k], pa.int32()), "key": [key[a:b][one].tobytes()], "doc": [doc[a:b][one].tobytes()], "several": [key[a:b][~one].tobytes()]})


def _joined_arrays(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in table[column].to_pylist()] or [np.empty(0, kind)])


def _recurring(table: pa.Table, uri: str) -> pa.Table:
    """Keeps a hash range's minimizers that two documents have."""
    key, doc = _joined_arrays(table, "key", np.uint64), _joined_arrays(table, "doc", np.int64)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    again = (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])
    several = _joined_arrays(table, "several", np.uint64)
    kept = np.unique(np.concatenate([key[1:][again], several]))
    shard = table["shard"][0].as_py()
    save(uri, shard, key=kept)
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(kept)], pa.int64())})


@lru_cache(maxsize=4)
def _opened(uri: str, bits: int, *names: str) -> HashArrays:
    return HashArrays(uri, bits, *names)


def _candidate_windows(w: Windows, known: HashArrays) -> np.ndarray:
    """Which windows have a kept minimizer; runs of one minimizer are looked up once."""
    if not len(w.doc):
        return np.zeros(0, bool)
    first = _first_of(w.minimizer)
    (hit,) = known.find(w.minimizer[first])
    return np.repeat(hit, np.diff(np.r_[first, len(w.doc)]))


def _passages(batches: Iterator[pa.RecordBatch], minimizers: str, bits: int, size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """For each block and hash range: candidate windows with the least id, and whether several ids have them."""
    known = _opened(minimizers, bits)
    for t in joined(batches):
        ids, valid = _ids(t)
        w = windows(utf8(t), valid, size)
        c = np.flatnonzero(_candidate_windows(w, known))
        if not len(c):
            continue
        h1, h2, doc = w.h1[c], w.h2[c], ids[w.doc[c]]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        first = _first_of(h1, h2)
        last = np.r_[first[1:], len(h1)] - 1
        several = (doc[first] != doc[last]).astype(np.uint8)
        h1, h2, doc = h1[first], h2[first], doc[first]
        for k, a, b in shard_edges(h1, bits):
            yield pa.record_batch({"shard": pa.array([k], pa.int32()), "h1": [h1[a:b].tobytes()], "h2": [h2[a:b].tobytes()], "doc": [doc[a:b].tobytes()], "several": [several[a:b].tobytes()]})


def _confirmed(table: pa.Table, uri: str) -> pa.Table:
    """Keeps a hash range's windows that two documents have, with the least id."""
    h1, h2 = _joined_arrays(table, "h1", np.uint64), _joined_arrays(table, "h2", np.uint64)
    doc, several = _joined_arrays(table, "doc", np.int64), _joined_arrays(table, "several", np.uint8)
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, several = h1[order], h2[order], doc[order], several[order]
    first = _first_of(h1, h2) if len(h1) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(h1)] - 1
    kept = first[(np.maximum.reduceat(several, first) > 0) | (doc[first] != doc[last])] if len(first) else first
    shard = table["shard"][0].as_py()
    save(uri, shard, key=h1[kept], h2=h2[kept], doc=doc[kept])
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(kept)], pa.int64())})


def _recurring_windows(w: Windows, ids: np.ndarray, known: HashArrays, confirmed: HashArrays) -> tuple[np.ndarray, np.ndarray]:
    """The windows that an earlier document has too, in order, and the least id that has each."""
    c = np.flatnonzero(_candidate_windows(w, known))
    found, h2, earliest = confirmed.find(w.h1[c], (np.uint64(0), np.int64(0)))
    step = 0
    while (other := np.flatnonzero(found & (h2 != w.h2[c]))).size:  # another window of the same first hash
        step += 1
        found[other], h2[other], earliest[other] = confirmed.find(w.h1[c[other]], (np.uint64(0), np.int64(0)), step)
    hit = found & (earliest < ids[w.doc[c]])
    return c[hit], earliest[hit]


def _chosen(batches: Iterator[pa.RecordBatch], minimizers: str, passages: str, bits: int, deal: int, size: int) -> Iterator[pa.RecordBatch]:
    """For each block and shard of automata: distinct passages that cover the recurring windows, by their words, with the least id that has each."""
    known, confirmed = _opened(minimizers, bits), _opened(passages, bits, "h2", "doc")
    for t in joined(batches):
        ids, valid = _ids(t)
        w = windows(utf8(t), valid, size)
        c, earliest = _recurring_windows(w, ids, known, confirmed)
        if not len(c):
            continue
        doc, at = w.doc[c], w.at[c]
        starts = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]
        begin = np.flatnonzero(starts)
        run = np.arange(len(c)) - np.repeat(begin, np.diff(np.r_[begin, len(c)]))
        cover = np.flatnonzero((run % size == 0) | np.r_[starts[1:], True])
        sent: dict[int, dict[bytes, tuple[int, int]]] = {}
        for k, a, first in zip(_dealt(w.minimizer[c[cover]], deal).tolist(), at[cover].tolist(), earliest[cover].tolist(), strict=True):
            passage = b" ".join(w.words.raw[w.words.start[a] : w.words.end[a + size - 1]].tobytes().split())
            sent.setdefault(k >> PARTS, {})[passage] = k & ((1 << PARTS) - 1), first
        for k, own in sent.items():
            part, first = (np.fromiter((x[i] for x in own.values()), np.int64, len(own)) for i in (0, 1))
            yield pa.record_batch({"shard": pa.array([k], pa.int32()), "passages": [b"\n".join(own)], "part": [part.astype(np.uint8).tobytes()], "first": [first.tobytes()]})


def _dealt(minimizer: np.ndarray, deal: int) -> np.ndarray:
    """Shard and part of a minimizer, as one number."""
    return (minimizer >> np.uint64(64 - deal - PARTS)).astype(np.int64)


class Vocabulary(NamedTuple):
    """Words by their hashes: a word's number is one more than its place."""

    hashes: np.ndarray
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def numbers(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's number; 0 where it isn't one of these. Words are compared by their bytes."""
        h, out = span_hashes(raw, start, end), np.zeros(len(start), np.int64)
        at, left = np.searchsorted(self.hashes, h), np.arange(len(start))
        while len(left):  # hashes are equal rarely
            at, left = at[inside := at < len(self.hashes)], left[inside]
            at, left = at[same := self.hashes[at] == h[left]], left[same]
            same = equal_spans(raw, start[left], end[left], self.raw, self.start[at], self.end[at])
            out[left[same]] = at[same] + 1
            at, left = at[~same] + 1, left[~same]
        return out


def _vocabulary(passages: Iterable[bytes]) -> tuple[Vocabulary, dict[bytes, int]]:
    """The passages' words, and each one's number."""
    distinct = list({word for passage in passages for word in passage.split(b" ")})
    words = words_of(distinct)
    hashes = span_hashes(*words[:3])
    order = np.argsort(hashes, kind="stable")
    return Vocabulary(hashes[order], words.raw, words.start[order], words.end[order]), {distinct[i]: k for k, i in enumerate(order.tolist(), 1)}


def _compiled(table: pa.Table, uri: str) -> pa.Table:
    """Compiles a shard's passages to automata over the numbers of their words, and stores these and those."""
    import ahocorasick

    firsts: dict[bytes, tuple[int, int]] = {}
    for own, part, first in zip(table["passages"].to_pylist(), table["part"].to_pylist(), table["first"].to_pylist(), strict=True):
        for passage, k, i in zip(own.split(b"\n"), part, np.frombuffer(first, np.int64).tolist(), strict=True):
            firsts[passage] = k, min(i, firsts.get(passage, (k, i))[1])
    vocabulary, numbers = _vocabulary(firsts)
    parts: dict = {}
    for passage, (k, i) in firsts.items():
        if k not in parts:
            parts[k] = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        parts[k].add_word(tuple(numbers[word] for word in passage.split(b" ")), i)
    for automaton in parts.values():
        automaton.make_automaton()
    shard = table["shard"][0].as_py()
    save_bytes(f"{uri}/{shard}", pickle.dumps((tuple(vocabulary), parts)))
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(firsts)], pa.int64())})


class Stretches(NamedTuple):
    """Stretches of texts in which passages of a part of a shard may lie, by these (as one number): places of their document, first word and word after the last."""

    dealt: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def of(self, shard: int) -> Stretches:
        return Stretches(*(x[slice(*np.searchsorted(self.dealt, [shard << PARTS, (shard + 1) << PARTS]))] for x in self))


def _stretches(w: Windows, known: HashArrays, deal: int, size: int) -> Stretches:
    c = np.flatnonzero(_candidate_windows(w, known))
    dealt = _dealt(w.minimizer[c], deal)
    order = np.argsort(dealt, kind="stable")
    dealt, doc, at = dealt[order], w.doc[c[order]], w.at[c[order]]
    begin = np.flatnonzero(np.r_[np.ones(min(1, len(c)), bool), (dealt[1:] != dealt[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + size)])
    end = np.r_[begin[1:], len(c)][: len(begin)] - 1
    return Stretches(dealt[begin], doc[begin], at[begin], at[end] + size)


def _located(words: Words, ids: np.ndarray, stretches: Stretches, vocabulary: Vocabulary, parts: dict, size: int) -> np.ndarray:
    """Streams a shard's stretches through its automata: places of the first words of what they find of earlier documents' passages. A word of no passage parts a stretch."""
    lengths = stretches.end - stretches.begin
    stop = np.cumsum(lengths + 1) - 1
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    place = np.arange(len(owner)) + (stretches.begin - (stop - lengths))[owner]
    inner = np.ones(len(owner), bool)
    inner[stop] = False
    number = np.zeros(len(owner), np.int64)
    number[inner] = vocabulary.numbers(words.raw, words.start[place[inner]], words.end[place[inner]])
    to = np.flatnonzero(number == 0)
    begin = np.r_[0, to + 1][: len(to)]
    run = np.flatnonzero(to - begin >= size)
    lasts: list[int] = []
    firsts: list[int] = []
    for k, a, b in zip((stretches.dealt[owner[begin[run]]] & ((1 << PARTS) - 1)).tolist(), begin[run].tolist(), to[run].tolist(), strict=True):
        if k in parts:
            for last, first in parts[k].iter(tuple(number[a:b].tolist())):
                lasts.append(a + last)
                firsts.append(first)
    last = np.array(lasts, np.int64)
    return place[last[np.array(firsts, np.int64) < ids[stretches.doc[owner[last]]]]] + 1 - size


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """Blocks of texts, as many as make GATHERED bytes."""
    held, most = [], 0
    for t in joined(batches):
        held.append(t)
        most += t["text"].nbytes
        if most >= GATHERED:
            yield held
            held, most = [], 0
    if held:
        yield held


def _without(words: Words, gone: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """For each text the number of words that go, and the digest of the others, joined by spaces."""
    keep, stays = ~gaps(words.raw), ~gone
    keep[words.end] = True
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    for a, b in zip(words.start[edges[::2]].tolist(), words.end[edges[1::2] - 1].tolist(), strict=True):
        keep[a : b + 1] = False
    kept = words.raw[keep]
    kept[gaps(kept)] = 32
    last = np.cumsum(words.sizes)
    sums = lambda x: np.r_[0, np.cumsum(x, dtype=np.int64)][np.r_[0, last]]
    to = sums(np.where(stays, words.end - words.start + 1, 0))
    return np.diff(sums(gone)), [hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def _kept(batches: Iterator[pa.RecordBatch], minimizers: str, automata: str, have: frozenset[int], bits: int, deal: int, size: int) -> Iterator[pa.RecordBatch]:
    """SCHEMA's columns: each shard's automaton is read once for so many blocks."""
    known = _opened(minimizers, bits)
    for blocks in _gathered(batches):
        columns, ids, words, stretches = [], [], [], []
        while blocks:
            t = blocks.pop(0)
            own, valid = _ids(t)
            w = windows(utf8(t), valid, size, False)
            columns.append(t["doc_id"].combine_chunks())
            ids.append(own)
            words.append(w.words)
            stretches.append(_stretches(w, known, deal, size))
        del t, w
        gone: list[list[np.ndarray]] = [[] for _ in words]
        for k in sorted(have & {k for s in stretches for k in np.unique(s.dealt >> PARTS).tolist()}):
            vocabulary, parts = pickle.loads(load_bytes(f"{automata}/{k}"))
            for found, own, block, s in zip(gone, ids, words, stretches, strict=True):
                found.append(_located(block, own, s.of(k), Vocabulary(*vocabulary), parts, size))
        for column, block, found in zip(columns, words, gone, strict=True):
            at = np.concatenate([np.empty(0, np.int64), *found])
            n = len(block.start)
            covered = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
            removed, digests = _without(block, np.cumsum(covered)[:n] > 0)
            yield pa.record_batch({"doc_id": column, "n_words": pa.array(block.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def automata(docs: DataFrame, size: int = SIZE) -> tuple[str, str, frozenset[int], int, int]:
    """Compiles the passages of docs(doc_id long, text); returns where the minimizers and the automata are, which shards have any, and by how many leading bits either is dealt."""
    spark, total = docs.sparkSession, input_bytes(docs)
    bits, deal = (shards(total, RANGE) - 1).bit_length(), math.ceil(total / SHARD).bit_length()
    minimizers, passages, compiled = (scratch(spark, x) for x in ("minimizers", "passages", "automata"))
    for sent, columns, reduce in (
        (lambda b: _minimizers(b, bits, size), "key binary, doc binary, several binary", lambda t: _recurring(t, minimizers)),
        (lambda b: _passages(b, minimizers, bits, size), "h1 binary, h2 binary, doc binary, several binary", lambda t: _confirmed(t, passages)),
        (lambda b: _chosen(b, minimizers, passages, bits, deal, size), "passages binary, part binary, first binary", lambda t: _compiled(t, compiled)),
    ):
        written = docs.mapInArrow(sent, f"shard int, {columns}").groupBy("shard").applyInArrow(reduce, "shard int, n long").collect()  # a number for each shard
    delete(spark, passages)
    return minimizers, compiled, frozenset(r["shard"] for r in written), bits, deal


def substring_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs(doc_id, text), written before they are returned."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        minimizers, compiled, have, bits, deal = automata(rows, size)
        out = cut(rows.mapInArrow(lambda b: _kept(b, minimizers, compiled, have, bits, deal, size), SCHEMA), "kept-words")
    for path in (minimizers, compiled):
        delete(docs.sparkSession, path)
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM d WHERE len(ws) >= 13 AND doc_id IS NOT NULL)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT r, i FROM g JOIN m USING (g) WHERE first < doc_id),
x AS (SELECT DISTINCT r, i + k.range AS i FROM c, range(13) k),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
k AS (SELECT w.r, count(*) AS n, string_agg(w, ' ' ORDER BY w.i) AS t FROM w LEFT JOIN x ON w.r = x.r AND w.i = x.i WHERE x.r IS NULL GROUP BY w.r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
