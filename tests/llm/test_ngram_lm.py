import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataflow.llm import ngram_lm as L
from strataflow.llm.shared import documents


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + ["end"]


class Brute:
    """The model by its definition, on dictionaries."""

    def __init__(self, texts, order=3):
        self.order = order
        runs = [["start"] * (order - 1) + words(t) for t in texts]
        grams = [Counter(tuple(r[i : i + k]) for r in runs for i in range(order - k, len(r) - k + 1)) for k in range(order + 1)]
        self.count = Counter(w for t in texts for w in words(t))
        self.c = {order: grams[order]}
        for k in range(order - 1, 0, -1):
            before = Counter(g[1:] for g in self.c[k + 1])
            self.c[k] = Counter({g: grams[k][g] if g[0] == "start" else n for g, n in before.items()})
        self.kinds = {k: defaultdict(Counter) for k in self.c}
        self.total = {k: Counter() for k in self.c}
        for k, c in self.c.items():
            for g, n in c.items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]][min(n, 3)] += 1
        self.d = {k: (0, *L.discounts([sum(n == m for n in c.values()) for m in (1, 2, 3, 4)])) for k, c in self.c.items()}

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.count) + 1)
        d, c, t = self.d[k], self.c[k][gram], self.total[k][gram[:-1]]
        if not t:
            return self.p(gram[1:])
        return max(c - d[min(c, 3)], 0) / t + sum(d[m] * n for m, n in self.kinds[k][gram[:-1]].items()) / t * self.p(gram[1:])

    def row(self, text):
        ws, n, v = words(text), sum(self.count.values()), len(self.count)
        run = ["start"] * (self.order - 1) + ws
        return len(ws), sum(self.count[w] > 0 for w in ws), n, sum(math.log10((self.count[w] + 1) / (n + v + 1)) for w in ws), sum(math.log10(self.p(tuple(run[i : i + self.order]))) for i in range(len(ws)))


def check(df, order=3):
    rows = df.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = Brute([r.text for r in rows if not held(r.doc_id)], order)
    got = sorted((tuple(r) for r in L.language_model(df, order=order).collect()), key=str)
    want = sorted(((r.doc_id, held(r.doc_id), *model.row(r.text)) for r in rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])
    return model


@pytest.mark.parametrize("order", [2, 3])
def test_a_table_equals_the_definition(spark, sf, order):
    check(documents(spark, sf).where("length(text) < 3000").repartition(3), order)


def test_frequent_tokens_in_several_ranges_change_nothing(spark, sf, monkeypatch):
    monkeypatch.setattr(L, "SAMPLED", 1)
    monkeypatch.setattr(L, "FREQUENT", 0.1)
    docs = documents(spark, sf).where("length(text) < 1500").repartition(3)
    assert len(L._frequent(docs, 0.1 / 8)) > 2
    check(docs)


def test_held_out_texts_score_better_than_by_words_alone_and_by_pairs(spark, sf):
    rows = L.language_model(documents(spark, sf)).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a b a d", "c a", "", "e e e e e a b a b"]
    df = spark.createDataFrame([(t,) for t in texts * 100], "text string")
    for order in (2, 3):
        model = L.train(df, order)
        token = np.array([*{int(x) for t in texts for x in L.tokens([t.encode()])[2]}, 12345], np.uint64)
        assert len(token) == model.vocabulary + 1
        for u, v in ((u, v) for u in (*token[:3], L.START) for v in (*token, L.START)):
            p, _ = L.probabilities(model, np.full(len(token), u if order == 3 else L.START, np.uint64), np.full(len(token), v, np.uint64), token)
            assert p.sum() == pytest.approx(1) and p.min() > 0
        assert L.probabilities(model, np.array([L.START]), np.array([L.START]), token[:1])[1][0] >= 100


def test_nulls_repeats_counts_over_a_byte_and_empty_tables(spark):
    rows = [(1, "A b c", "x"), (1, "A b c", "x"), (2, None, "x"), (3, "", "x"), (None, "b c d", "x"), (9, "z " * 2000, "x"), (10, "é 😀\x0bq", "x")] + [(100 + i, f"a b {i % 7}", "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    check(df)
    assert L.language_model(df.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "q r", "x") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string, score string")
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in L.language_model(only).collect()} == {(True, 3, 0, 0, 0.0, 0.0)}


def test_a_lookup_sorts_its_keys_once(tmp_path, monkeypatch):
    from strataflow.llm import hash_arrays

    rng, bits = np.random.default_rng(4), 2
    stored = np.unique(rng.integers(0, 1 << 64, 4000, np.uint64))
    fields = rng.choice([1, 1, 7, 300], (len(stored), 2)).astype(np.int64)
    for exact in (False, True):
        at = f"{tmp_path}/{exact}"
        for k, a, b in hash_arrays.shard_edges(stored, bits):
            hash_arrays.save_counts(at, k, bits, stored[a:b], fields[a:b], (1, 1), exact)
        asked = rng.permutation(np.concatenate([stored, stored[::3], stored[::2] ^ np.uint64(1 << 40)]))
        want = {int(k): f.tolist() for k, f in zip(stored, fields, strict=True)}
        calls, unique = [], np.unique
        with monkeypatch.context() as m:
            m.setattr(np, "unique", lambda *a, **b: calls.append(1) or unique(*a, **b))
            got = hash_arrays.Counts(at, bits, 2, (1, 1), exact).find(asked)
        assert got.tolist() == [want.get(int(k), [0, 0]) for k in asked] and len(calls) == 1


def test_words_are_hashed_as_arrays_and_in_lower_case(monkeypatch):
    import xxhash

    from strataflow.llm import shared

    calls, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda x: calls.append(1) or digest(x))
    monkeypatch.setattr(shared, "PIECE", 3000)
    texts = [" ".join(f"Wörd{i % 977}aNDMore" for i in range(k)).encode() for k in (0, 1, 700, 3, 0, 900)]
    _, _, token, place = L.tokens(texts)
    want = [(x, k) for k, t in enumerate(texts) for x in [*t.lower().split(), b"end"]]
    assert not calls and place.tolist() == [k for _, k in want] and len(set(token.tolist())) == len({x for x, _ in want}) == len(set(zip(token.tolist(), (x for x, _ in want), strict=True)))


def test_hashes_are_sorted_like_numpys_stable_sort():
    from strataflow.llm.shared import distinct, order_of

    rng = np.random.default_rng(8)
    for key in (rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 1 << 15, 5000, np.uint64), rng.integers(0, 1 << 64, 300, np.uint64)[rng.integers(0, 300, 5000)], np.array([5], np.uint64), np.empty(0, np.uint64)):
        assert order_of(key).tolist() == np.argsort(key, kind="stable").tolist()
        assert [x.tolist() for x in distinct(key)] == [x.tolist() for x in np.unique(key, return_inverse=True)]
    few = rng.integers(0, 1 << 64, 5000, np.uint64)
    few[::50] = few[0] ^ rng.integers(0, 9, 100, np.uint64)  # told apart by their last bits only
    assert order_of(few).tolist() == np.argsort(few, kind="stable").tolist()


def test_lookups_in_many_ranges_hold_no_files_open(tmp_path, monkeypatch):
    import os
    import resource

    from strataflow.llm import hash_arrays

    rng, bits = np.random.default_rng(6), 8
    stored = np.unique(rng.integers(0, 1 << 64, 4000, np.uint64))
    fields = rng.choice([1, 1, 7, 300], (len(stored), 4)).astype(np.int64)
    asked = rng.permutation(np.concatenate([stored, stored[::2] ^ np.uint64(1 << 40)]))
    want = {int(k): f.tolist() for k, f in zip(stored, fields, strict=True)}
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    for exact in (False, True):
        at = f"{tmp_path}/{exact}"
        for k, a, b in hash_arrays.shard_edges(stored, bits):
            hash_arrays.save_counts(at, k, bits, stored[a:b], fields[a:b], (1, 1, 1, 1), exact)
        counts = hash_arrays.Counts(at, bits, 4, (1, 1, 1, 1), exact)
        resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 20, hard))
        try:
            got = counts.find(asked).tolist()
        finally:
            resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
        assert got == [want.get(int(k), [0] * 4) for k in asked]
        monkeypatch.setattr(hash_arrays, "MOST_MAPS", 7)
        few = hash_arrays.Counts(at, bits, 4, (1, 1, 1, 1), exact)
        assert few.find(asked).tolist() == few.find(asked).tolist() == got and len(few.arrays.shards) == 7


def test_a_table_in_many_ranges_equals_the_definition(spark, sf, monkeypatch):
    monkeypatch.setattr(L, "RANGE", 1 << 8)
    docs = documents(spark, sf).where("length(text) < 1000").repartition(2)
    assert L.train(docs).layout.bits > 4
    check(docs)


def test_a_range_sends_each_shard_one_row(tmp_path):
    import pyarrow as pa

    texts = [" ".join(f"w{(i * i * k) % 97}" for i in range(200)).encode() for k in range(40)]
    for order in (2, 3):
        layout = L.Layout(order, 3, tuple(sorted(int(x) for x in L.tokens([b"w1 w4 w9"])[2][:3])))
        rows = pa.table({"text": texts}).to_batches()
        sent = [(k, p) for b in L._triples(rows, layout) for k, p in zip(b["shard"].to_pylist(), b["packed"].to_pylist(), strict=True)]
        for shard in {k for k, _ in sent}:
            own = [p for k, p in sent if k == shard]
            to = [k for b in L._range(pa.table({"shard": pa.array([shard] * len(own), pa.int32()), "packed": own}), str(tmp_path), layout) for k in b["shard"].to_pylist()]
            assert len(to) == len(set(to)) and shard in to


def test_arrays_of_another_store_are_copied_and_mapped(tmp_path, monkeypatch):
    import pyarrow.fs as fs

    from strataflow.llm import hash_arrays

    monkeypatch.setattr(hash_arrays, "_store", lambda uri: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), uri))
    stored = np.unique(np.random.default_rng(7).integers(0, 1 << 64, 500, np.uint64))
    for k, a, b in hash_arrays.shard_edges(stored, 3):
        hash_arrays.save_counts("x", k, 3, stored[a:b], np.arange(a, b)[:, None] + 1, (1,))
        hash_arrays.save("y", k, key=stored[a:b], doc=np.arange(a, b))
    assert hash_arrays.Counts("x", 3, 1, (1,)).find(stored)[:, 0].tolist() == list(range(1, len(stored) + 1))
    hit, doc = hash_arrays.HashArrays("y", 3, "doc").find(stored, (np.int64(-1),))
    assert hit.all() and doc.tolist() == list(range(len(stored)))
