"""Language-model scores: an interpolated modified Kneser-Ney model of order three (or two), counted in Spark.

1. Blocks of training texts send their distinct triples (two tokens before, token before, token) with
   counts, packed, to hash ranges of the middle token. So a range has all of a pair's left neighbours and
   all that follows a context, and sums triples, continuation counts of pairs, and contexts' totals
   by itself. It writes them to the shared folder as sorted hash arrays.
2. A middle token that is frequent enough to fill ranges is dealt by its next token as well; its
   contexts' partial totals then go on to a second exchange. Which tokens these are is told by a sample
   of the texts; it moves work only, and changes no count.
3. Words' sums (as history: how many pairs have continuation counts of one, two and more, and their
   total; as token: how many histories it has, and its count) meet by hash in that second exchange,
   with counts of counts, a few numbers for each range.
   Words have keys of 64 bits; triples, pairs and contexts of 40 beyond those of their range, so that
   about one of a million that never occurred is taken for another.
4. Workers memory-map the arrays and score blocks of documents: each distinct triple, pair, context and
   word of a block is looked up once, in keys' order, and sums are by document.

Triples are counted as they occur; pairs and words by how many different tokens stand before them, but
pairs at a text's start, which have nothing before them, as they occur. At order two pairs take the
place of triples. Nothing is pruned: every triple of every training text counts.

Tokens are words in lower case (A-Z), then one end. A text's first histories are starts, which are no
tokens. Probabilities are over all training tokens and one unknown. Null texts are empty: their one
token is the end. Rows without a doc_id are training rows. Repeated rows count, and are scored, each.
Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.hash_arrays import Counts, save_counts, shard_edges
from strataflow.llm.shared import cut, delete, distinct, input_bytes, joined, mixed, order_of, scratch, shards, small_batches, utf8, word_hashes

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ORDER = 3
#: Bytes of text whose triples are summed up before they are sent, and those that one hash range is for.
BLOCK, RANGE = 20 << 20, 16 << 20
#: Bytes of an exchange's rows that go as one batch.
SENT = 4 << 20
#: Bytes of text that are scored at once, as each look goes by nearly all ranges, and how many of their keys are looked up at once.
SCORED, LOOKED_UP = 12 << 20, 1 << 19
#: One of so many texts tells which middle tokens are frequent; a token of more than FREQUENT of a range's share is, but no token below RARE of all.
SAMPLED, FREQUENT, RARE = 16, 1.0, 1e-6
#: The fields of words, with what most words of a hash range send: seen in one pair, once.
FIELDS = {"history": 4, "token": 2, "context": 4}
USUAL = {"history": (1, 0, 0, 1), "token": (1, 1), "context": (1, 0, 0, 1), "count": (1,)}
START, END = np.uint64(0x9C5E2D3B7A1F4E61), np.uint64(0x3F84D5B5B5470917)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Discounts(NamedTuple):
    """What is taken off counts of 1, 2, and 3 or more."""

    one: float
    two: float
    more: float


class Layout(NamedTuple):
    """How triples are dealt to 2**bits ranges: by the middle token, and by the next too for frequent ones."""

    order: int
    bits: int
    frequent: tuple[int, ...]

    def split(self, v: np.ndarray) -> np.ndarray:
        frequent = np.array(sorted(self.frequent), np.uint64)
        return frequent[np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)] == v if len(frequent) else np.zeros(len(v), bool)

    def within(self, by: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Keys whose leading bits are those of by."""
        shift = np.uint64(64 - self.bits)
        return (by >> shift << shift) | (key >> np.uint64(self.bits)) if self.bits else key

    def keys(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The keys of triples and of their pairs (v, w); split(v) may be given."""
        pair = mixed(v * _P1 + w)
        home = np.where(self.split(v) if split is None else split, pair, mixed(v))
        return self.within(home, mixed(u * _P2 + pair)), self.within(home, pair)

    def contexts(self, u: np.ndarray, v: np.ndarray, split: np.ndarray | None = None) -> np.ndarray:
        """The keys of contexts (u, v): within the middle token's range, but dealt by themselves for frequent ones."""
        own = mixed(v * _P2 + mixed(u))
        return np.where(self.split(v) if split is None else split, own, self.within(mixed(v), own))

    def told(self, context: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Which contexts must be written: those that one triple follows once are told by their pair, as every pair but one at a text's end has something after it. Two starts are no pair."""
        both = self.contexts(np.array([START]), np.array([START]))
        return (sums != np.array(USUAL["context"])).any(axis=1) | (context == both)


class Model(NamedTuple):
    """Where a model's arrays are, and the few numbers beside them."""

    path: str
    layout: Layout
    tokens: int
    vocabulary: int
    distinct_pairs: int
    discounts: tuple[Discounts, Discounts, Discounts]
    seen_words: tuple[int, int, int]


def discounts(n: list[int]) -> Discounts:
    """Modified Kneser-Ney discounts from how many entries occur 1, 2, 3 and 4 times; kept between 0 and the count where counts of counts are too few to tell."""
    if min(n) <= 0:
        return Discounts(0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    return Discounts(*(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)))


def tokens(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token two before, token before, token, place of the text) for each token of the texts; at order two, a start is always two before."""
    words, lengths = word_hashes([t.lower() for t in texts])
    ends = np.cumsum(lengths + 1) - 1
    w = np.empty(len(words) + len(texts), np.uint64)
    is_end = np.zeros(len(w), bool)
    is_end[ends] = True
    w[~is_end], w[is_end] = words, END
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[ends - lengths] = START
    u = np.full_like(w, START)
    if order > 2:
        u[1:] = v[:-1]
        u[ends - lengths] = START
    return u, v, w, np.repeat(np.arange(len(texts)), lengths + 1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group starts in columns sorted together."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first, in keys' order, and the counts' sums by key as a matrix."""
    order = order_of(key)
    first = _starts(key[order])
    if not len(first):
        return first, np.empty((0, len(counts)), np.int64)
    return order[first], np.stack([np.add.reduceat(c[order].astype(np.int64), first) for c in counts], axis=1)


def _rows(found: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(shard, packed) rows as batches of some MB, as each batch costs about as much as a hundred rows."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for row in found:
        held.append(row)
        size += len(row[1])
        if size >= SENT:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    shard, packed = zip(*rows, strict=True)
    return pa.record_batch({"shard": pa.array(shard, pa.int32()), "packed": pa.array(packed, pa.binary())})


def _triples(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """For each block and range its distinct triples, sorted by the middle token and the one before, each written once for a run."""
    for t in joined(batches, most=BLOCK):
        u, v, w, _ = tokens(utf8(t), layout.order)
        key, _ = layout.keys(u, v, w)
        order = order_of(key)
        key = key[order]
        first = _starts(key)
        n, at = np.diff(np.r_[first, len(key)]), order[first]
        key, u, v, w = key[first], u[at], v[at], w[at]
        del order, first, at
        yield from _rows((k, _packed(u[a:b], v[a:b], w[a:b], n[a:b])) for k, a, b in shard_edges(key, layout.bits))


def _planes(x: np.ndarray) -> bytes:
    """Numbers by bytes of one significance after the other, which compress better."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _joined_planes(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T.copy().view(kind)[:, 0]


@lru_cache
def _compressor(level: int):
    """One for all rows: making one costs more than a short row."""
    import zstandard

    return zstandard.ZstdCompressor(level)


@lru_cache
def _decompressor():
    import zstandard

    return zstandard.ZstdDecompressor()


def _packed(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Distinct triples with counts: their words' hashes once, and places among them; v and u once for each run of them."""
    by = order_of(u)
    by = by[order_of(v[by])]
    u, v, w, n = u[by], v[by], w[by], n[by]
    runs, pairs, often = _starts(v), _starts(v, u), np.flatnonzero(n > 1)
    words, at = distinct(np.concatenate([v[runs], u[pairs], w]))
    sizes = np.array([len(words), len(runs), len(pairs), len(w), len(often)], np.uint32)
    lengths = np.concatenate([np.diff(np.r_[runs, len(v)]), np.diff(np.r_[pairs, len(v)]), np.diff(np.r_[0, often]), n[often]]).astype(np.uint32)
    return _compressor(6).compress(sizes.tobytes() + _planes(words) + _planes(at.astype(np.uint32)) + _planes(lengths))


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _decompressor().decompress(packed)
    n_words, n_runs, n_pairs, n, n_often = (int(x) for x in np.frombuffer(raw, np.uint32, 5))
    words = _joined_planes(raw, np.uint64, n_words, 20)
    numbers = lambda count, at: _joined_planes(raw, np.uint32, count, at)
    places = n_runs + n_pairs + n
    at = numbers(places, 20 + 8 * n_words)
    v_run, u_run, often, more = np.split(numbers(n_runs + n_pairs + 2 * n_often, 20 + 8 * n_words + 4 * places), np.cumsum([n_runs, n_pairs, n_often]))
    c = np.ones(n, np.int64)
    c[np.cumsum(often)] = more
    return np.repeat(words[at[n_runs : n_runs + n_pairs]], u_run), np.repeat(words[at[:n_runs]], v_run), words[at[n_runs + n_pairs :]], c


def _kinds(n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each count: whether it is one, two, more; and itself."""
    return n == 1, n == 2, n > 2, n


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _sent(sums: dict[str, tuple[np.ndarray, np.ndarray]], numbers: list[int], shard: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """A range's sums of sorted keys for the second exchange: one row for each shard, with the most usual ones as bare keys. The numbers go to the range's own shard."""
    parts = []
    for of in FIELDS:
        key, fields = sums.get(of, (np.empty(0, np.uint64), np.empty((0, FIELDS[of]), np.int64)))
        usual = (fields == np.array(USUAL[of])).all(axis=1)
        for own, more in ((key[usual], None), (key[~usual], fields[~usual])):
            parts.append((own, more, np.searchsorted(own >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))))
    edges = np.stack([x[2] for x in parts], axis=1)
    for k in np.flatnonzero((edges[1:] > edges[:-1]).any(axis=1) | (np.arange(1 << bits) == shard)).tolist():
        cuts = [(own[a:b], None if more is None else more[a:b]) for (own, more, _), a, b in zip(parts, edges[k].tolist(), edges[k + 1].tolist(), strict=True)]
        head = np.array([len(own) for own, _ in cuts] + (numbers if k == shard else [0] * len(numbers)), np.int64)
        fields = np.concatenate([more.T.reshape(-1) for _, more in cuts if more is not None])
        yield k, _compressor(3).compress(head.tobytes() + _planes(np.concatenate([own for own, _ in cuts])) + _planes(fields))


def _received(rows: Iterable[bytes]) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The numbers that a shard was sent, added, and its sums: keys that may repeat, and their fields."""
    numbers, keys, fields = np.zeros(9, np.int64), [[np.empty(0, np.uint64)] for _ in range(2 * len(FIELDS))], [[np.empty((0, n), np.int64)] for n in FIELDS.values()]
    for packed in rows:
        raw = _decompressor().decompress(packed)
        head = np.frombuffer(raw, np.int64, 2 * len(FIELDS) + 9)
        numbers += head[2 * len(FIELDS) :]
        sizes = head[: 2 * len(FIELDS)].tolist()
        own, at = _joined_planes(raw, np.uint64, sum(sizes), head.nbytes), 0
        more, start = _joined_planes(raw, np.int64, (len(raw) - head.nbytes) // 8 - len(own), head.nbytes + own.nbytes), 0
        for held, n in zip(keys, sizes, strict=True):
            if n:
                held.append(own[at : at + n])
                at += n
        for held, n, width in zip(fields, sizes[1::2], FIELDS.values(), strict=True):
            if n:
                held.append(more[start : start + n * width].reshape(width, n).T)
                start += n * width
    sums = {}
    for of, bare, other, more in zip(FIELDS, keys[::2], keys[1::2], fields, strict=True):
        own = np.concatenate(bare)
        sums[of] = np.concatenate([own, *other]), np.concatenate([np.tile(USUAL[of], (len(own), 1)), *more])
    return numbers, sums


def _range(table: pa.Table, path: str, layout: Layout) -> Iterator[pa.RecordBatch]:
    """Writes a range's triples, pairs and contexts; sends on its words' sums, frequent contexts' and its counts of counts."""
    shard = table["shard"][0].as_py()
    u, v, w, n = (np.concatenate(x) for x in zip(*map(_unpacked, table["packed"].to_pylist()), strict=True))
    at, sums = _summed(layout.keys(u, v, w)[0], n)
    u, v, w, n = u[at], v[at], w[at], sums[:, 0]
    key, pair = layout.keys(u, v, w)
    save_counts(f"{path}/triples", shard, layout.bits, key, sums, USUAL["count"])
    numbers, sent = [*_counts_of_counts(n), *[0] * 4], {}
    if layout.order > 2:
        context = layout.contexts(u, v)
        at, sums = _summed(context, *_kinds(n))
        own, split = context[at], layout.split(v[at])
        kept = ~split & layout.told(own, sums)
        save_counts(f"{path}/contexts", shard, layout.bits, own[kept], sums[kept])
        sent["context"] = own[split], sums[split]
        at, sums = _summed(pair, np.ones(len(n)), n)
        continued = np.where(v[at] == START, sums[:, 1], sums[:, 0])
        save_counts(f"{path}/pairs", shard, layout.bits, pair[at], continued[:, None], USUAL["count"])
        v, w, n, raw = v[at], w[at], continued, sums[:, 1]
        numbers[4:] = _counts_of_counts(n)
    else:
        raw = n
    for of, word, fields in (("history", v, _kinds(n)), ("token", w, (np.ones(len(n)), raw))):
        at, sums = _summed(word, *fields)
        sent[of] = word[at], sums
    yield from _rows(_sent(sent, [*numbers, len(v)], shard, layout.bits))


def _word_range(table: pa.Table, path: str, layout: Layout) -> pa.Table:
    """Writes a range's words and frequent contexts; returns its sums and counts of counts."""
    shard, (numbers, sent) = table["shard"][0].as_py(), _received(table["packed"].to_pylist())
    found = {}
    for of in FIELDS:
        key, fields = sent.pop(of)
        at, sums = _summed(key, *fields.T)
        found[of] = key[at], sums
    context, sums = found["context"]
    kept = layout.told(context, sums)
    save_counts(f"{path}/frequent", shard, layout.bits, context[kept], sums[kept])
    word = np.union1d(found["history"][0], found["token"][0])
    whole = np.zeros((len(word), 6), np.int64)
    whole[np.searchsorted(word, found["history"][0]), :4] = found["history"][1]
    whole[np.searchsorted(word, found["token"][0]), 4:] = found["token"][1]
    save_counts(f"{path}/words", shard, layout.bits, word, whole, exact=True)
    histories, count = whole[:, 4], whole[:, 5]
    sums = [int(count.sum()), int((count > 0).sum()), *_counts_of_counts(histories), *numbers.tolist()]
    return pa.table({"shard": pa.array([shard], pa.int32()), "sums": pa.array([sums], pa.list_(pa.int64()))})


def _frequent(docs: DataFrame, share: float) -> tuple[int, ...]:
    """Tokens of more than about that share of all, by one of SAMPLED texts; at most 1 / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joined(batches):
            v, n = np.unique(tokens(utf8(t))[1], return_counts=True)
            often = np.flatnonzero(n >= share * n.sum() / 4)
            yield pa.record_batch({"v": pa.array(v[often].view(np.int64)), "n": pa.array(n[often]), "of_all": pa.array(np.r_[n.sum(), np.zeros(len(often), np.int64)][: len(often)], pa.int64())})

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    counted = some.mapInArrow(run, "v long, n long, of_all long").groupBy("v").agg(F.sum("n").alias("n"), F.sum("of_all").alias("of_all"))
    rows = counted.collect()  # 4 / share rows for each block at most, few of them different
    total = sum(r["of_all"] for r in rows)
    return tuple(sorted(r["v"] % (1 << 64) for r in rows if r["n"] > share * total))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts docs(text), in which nulls are empty."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    bits = (shards(input_bytes(docs), RANGE) - 1).bit_length()
    layout = Layout(order, bits, _frequent(docs, max(FREQUENT / (1 << bits), RARE)))
    path = scratch(docs.sparkSession, "ngrams")
    sent = docs.select("text").mapInArrow(lambda b: _triples(b, layout), "shard int, packed binary")
    entries = sent.groupBy("shard").applyInArrow(lambda t: pa.Table.from_batches(list(_range(t, path, layout))), "shard int, packed binary")
    sums = np.zeros(15, np.int64)
    for r in entries.groupBy("shard").applyInArrow(lambda t: _word_range(t, path, layout), "shard int, sums array<long>").collect():  # a few numbers for each range
        sums += np.array(r["sums"], np.int64)
    n = [int(x) for x in sums]
    of = (discounts(n[2:6]), discounts(n[10:14]) if order > 2 else discounts(n[6:10]), discounts(n[6:10]))
    return Model(path, layout, n[0], n[1], n[14], of, (n[2], n[3], n[1] - n[2] - n[3]))


def _looked_up(counts: Counts, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Looks keys up in their order, some at a time and each distinct one of these once: places of the keys, their rows, the rows' numbers."""
    order = order_of(key)
    for a in range(0, len(order), LOOKED_UP):
        own = key[order[a : a + LOOKED_UP]]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        yield order[a : a + LOOKED_UP], np.cumsum(new) - 1, counts.find_sorted(own[new])


def _first_numbers(counts: Counts, key: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key), np.int64)
    for places, rows, values in _looked_up(counts, key):
        out[places] = values[rows, 0]
    return out


def _by_parts(f: Callable[..., np.ndarray], *columns: np.ndarray) -> np.ndarray:
    """f(*columns) for keys, with its temporary arrays for some rows at a time."""
    out = np.empty(len(columns[0]), np.uint64)
    for a in range(0, len(out), LOOKED_UP):
        out[a : a + LOOKED_UP] = f(*(c[a : a + LOOKED_UP] for c in columns))
    return out


class Opened:
    """A model's arrays, as a worker maps them."""

    def __init__(self, model: Model):
        self.model = model
        at = lambda name, k, usual=(), exact=False: Counts(f"{model.path}/{name}", model.layout.bits, k, usual, exact)
        self.triples, self.pairs, self.words = at("triples", 1, USUAL["count"]), at("pairs", 1, USUAL["count"]), at("words", 6, exact=True)
        self.contexts, self.frequent = at("contexts", 4), at("frequent", 4)


@lru_cache(maxsize=1)
def _opened(model: Model) -> Opened:
    return Opened(model)


def _taken(n: np.ndarray, d: Discounts) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def _left(context: np.ndarray, d: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """The share of each context that discounts leave to the lower order, all of one that was never seen, and the contexts' totals."""
    once, twice, more, total = context.T
    return np.divide(d.one * once + d.two * twice + d.more * more, total, out=np.ones(len(context)), where=total > 0), total.astype(float)


def _interpolated(n: np.ndarray, rest: np.ndarray, total: np.ndarray, d: Discounts, lower: np.ndarray) -> np.ndarray:
    """Discounted counts, with what was taken off given to the lower order; the lower order alone after a context that was never seen."""
    return np.divide(np.maximum(n - _taken(n, d), 0), total, out=np.zeros(len(n)), where=total > 0) + rest * lower


def probabilities(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray, running: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(probability, training count) of each token w after v, and u before that. In running text it is told which tokens follow the one before; others are a text's first. So a token's context is the pair before it, and isn't looked up as one."""
    own, layout = _opened(model), model.layout
    words_d, pairs_d, triples_d = model.discounts
    if running is None:
        word, back = distinct(np.concatenate([w, v]))
        at, before = back[: len(w)], back[len(w) :]
    else:
        word, at = distinct(np.append(w, START))
        before = np.where(running, np.roll(at[:-1], 1), at[-1])
        at = at[:-1]
    found = own.words.find_sorted(word)
    histories = found[:, 4]
    if model.distinct_pairs:
        kept = sum(x * n for x, n in zip(words_d, model.seen_words, strict=True)) / model.distinct_pairs
        lower = np.maximum(histories - _taken(histories, words_d), 0) / model.distinct_pairs + kept / (model.vocabulary + 1)
    else:
        lower = np.full(len(word), 1.0 / (model.vocabulary + 1))
    known = found[at, 5]
    rest, total = (x[before] for x in _left(found[:, :4], triples_d if layout.order == 2 else pairs_d))
    lower = lower[at]
    del at, before
    split = layout.split(v)
    triple, pair = (lambda *x: layout.keys(*x)[0]), (lambda v, *x: layout.keys(v, v, *x)[1])
    if layout.order == 2:
        return _interpolated(_first_numbers(own.triples, _by_parts(triple, u, v, w, split)), rest, total, triples_d, lower), known
    continued = _first_numbers(own.pairs, _by_parts(pair, v, w, split))
    p = _interpolated(continued, rest, total, pairs_d, lower)
    seen = np.r_[False, continued[:-1] > 0][: len(w)]
    del lower, continued
    rest[:], total[:] = 1, 0
    context = _by_parts(layout.contexts, u, v, split)
    for counts, some in ((own.contexts, np.flatnonzero(~split)), (own.frequent, np.flatnonzero(split))):
        for places, rows, values in _looked_up(counts, context[some]):
            to = some[places]
            rest[to], total[to] = (x[rows] for x in _left(values, triples_d))
    del context
    left = np.flatnonzero((total == 0) & (v != END))  # those that aren't written are usual where they are a pair; nothing comes after an end
    left = left[(seen & running)[left] if running is not None else _first_numbers(own.pairs, pair(u[left], v[left])) > 0]
    rest[left], total[left] = (x[0] for x in _left(np.array([USUAL["context"]]), triples_d))
    return _interpolated(_first_numbers(own.triples, _by_parts(triple, u, v, w, split)), rest, total, triples_d, p), known


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCHEMA's columns for each row of docs(doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joined(batches, most=SCORED):
            u, v, w, doc = tokens(utf8(t), model.layout.order)
            p, c = probabilities(model, u, v, w, np.r_[False, doc[1:] == doc[:-1]][: len(doc)])
            sums = lambda x: np.bincount(doc, x, t.num_rows)
            base = np.log10((c + 1) / (model.tokens + 1 * (model.vocabulary + 1)))
            whole = lambda x: pa.array(np.rint(x).astype(np.int64))
            yield pa.record_batch({
                "doc_id": t["doc_id"].combine_chunks(), "held_out": t["held_out"].combine_chunks(), "n_tokens": whole(sums(np.ones(len(doc)))), "n_known": whole(sums(c > 0)),
                "train_tokens": pa.array(np.full(t.num_rows, model.tokens, np.int64)), "base_score": pa.array(sums(base)), "score": pa.array(sums(np.log10(p))),
            })

    return docs.mapInArrow(run, SCHEMA)


def language_model(docs: DataFrame, folds: int = 7, held: int = 2, order: int = ORDER) -> DataFrame:
    """Scores of all rows of docs(doc_id, text), written before they are returned, by a model of those whose crc32(doc_id as text) mod folds isn't held."""
    own = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("held_out"))
    with small_batches(docs.sparkSession):
        model = train(rows.where(~F.col("held_out")), order)
        out = cut(score(rows, model), "scores")
    delete(docs.sparkSession, model.path)
    return out
