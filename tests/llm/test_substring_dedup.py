import hashlib
import random
import re

import numpy as np
import pytest

from strataflow.llm import substring_dedup as S
from strataflow.llm.shared import documents


def brute(docs, size=13):
    """docs: (doc_id, text) rows; the definition, on word tuples."""
    first, out = {}, []
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - size + 1) if i is not None else ():
            g = tuple(w[k : k + size])
            first[g] = min(i, first.get(g, i))
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in S.substring_dedup(df).collect()), key=str)


def test_a_table_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    assert found(docs.repartition(5)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_random_passages_and_edges(spark):
    rng = random.Random(7)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)] for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, 5)
            text += p[cut:] if rng.random() < 0.3 else p
            text += [f"w{rng.random()}" for _ in range(rng.randint(0, 6))]
        rows.append((i * 3 % 100, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(None, " ".join(passages[4])), (-5, " ".join(passages[3])), (2**61, " ".join(["a"] * 40)), (2**61 + 1, " ".join(["a"] * 40)), (300, None), (301, ""), (302, "one two")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    assert found(df.repartition(6)) == brute(rows)
    assert found(df.limit(0)) == []


def test_equal_first_hashes_are_told_apart(spark, monkeypatch):
    real = S._grams

    def few(words, size, base):
        h = real(words, size, base)
        return h & np.uint64(0xF00000000000000F) if size == S.SIZE and base == S._P1 else h

    monkeypatch.setattr(S, "_grams", few)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(30)).encode() for _ in range(40)]
    texts += texts[::2]
    ids = np.arange(len(texts))
    import pyarrow as pa

    t = pa.table({"doc_id": ids, "text": [x.decode() for x in texts]})
    import os
    import tempfile

    at = [f"file://{tempfile.mkdtemp()}" for _ in range(3)]

    def reduced(rows, f, uri):
        table = pa.Table.from_batches(rows)
        for k in range(4):
            part = table.filter(pa.compute.equal(table["shard"], k))
            if part.num_rows:
                f(part, uri)

    of = lambda: iter(t.to_batches())
    reduced(list(S._minimizers(of(), 2)), S._recurring, at[0])
    reduced(list(S._passages(of(), at[0], 2)), S._confirmed, at[1])
    reduced(list(S._chosen(of(), at[0], at[1], 2, 1, 13)), S._compiled, at[2])
    got = [tuple(r.values()) for b in S._kept(of(), at[0], at[2], frozenset(int(x) for x in os.listdir(at[2].removeprefix("file://"))), 2, 1, 13) for r in b.to_pylist()]
    assert sorted(got, key=str) == brute(list(zip(ids.tolist(), [x.decode() for x in texts], strict=True)))


def test_other_sizes(spark):
    rng = random.Random(5)
    shared = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)] for n in (3, 4, 8, 9, 20, 40)]
    rows = [(i, " ".join(w for _ in range(3) for w in (*rng.choice(shared), f"w{rng.random()}"))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size in (3, 8, 20):
        want = brute(rows, size)
        assert sorted(map(tuple, S.substring_dedup(df, size).collect()), key=str) == want and any(r[2] for r in want)


def test_automata_find_the_occurrences(spark, sf, monkeypatch):
    import os

    monkeypatch.setattr(S, "SHARD", 100_000)
    docs = documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    minimizers, compiled, have, bits, deal = S.automata(docs)
    kept = lambda shards: sorted((tuple(r) for r in docs.mapInArrow(lambda b: S._kept(b, minimizers, compiled, shards, bits, deal, 13), S.SCHEMA).collect()), key=str)
    assert kept(have) == brute(rows) and len(have) > 4
    found = [sum(r[2] for r in kept(have - {k})) for k in sorted(have)[:3]]
    assert max(found) < sum(r[2] for r in kept(have)) and not any(r[2] for r in kept(frozenset()))
    os.remove(f"{compiled.removeprefix('file://')}/{min(have)}")
    with pytest.raises(FileNotFoundError):
        list(S._kept(docs.toArrow().to_batches(), minimizers, compiled, have, bits, deal, 13))


def test_words_are_hashed_as_arrays(monkeypatch):
    import pyarrow as pa
    import xxhash

    calls, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda x: calls.append(1) or digest(x))
    text = " ".join(f"word{i}andmore" for i in range(5000))
    t = pa.table({"doc_id": [1, 2], "text": [text, text]})
    assert len(list(S._minimizers(iter(t.to_batches()), 3))) > 1 and not calls


def test_spans_equal_words():
    from strataflow.llm import shared

    rng = random.Random(11)
    parts = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x08", b"\x0e", b"\x00", b"\x1f", b"\x85", " é".encode(), b"a", b"b", b"c" * 7, b"d" * 8, b"e" * 57]
    texts = [b"".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300)] + [b"", b" ", b"x", b"q" * 64, b"q" * 65, b"q" * 5000, b"q" * 4999 + b"r", b"ab", b"ab\x00", b"ab\x00\x00"]
    for some in (texts, [b""], []):
        w = shared.words_of(some)
        words = [x for t in some for x in t.split()]
        assert [w.raw[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == words and w.sizes.tolist() == [len(t.split()) for t in some]
        hashes = shared.span_hashes(*w[:3]).tolist()
        assert len(set(hashes)) == len(set(words)) == len(set(zip(hashes, words, strict=True)))
    w = shared.words_of(texts)
    words = [x for t in texts for x in t.split()]
    for k in (0, 1, 7, 100):
        order = np.roll(np.arange(len(words)), k) if k < 100 else np.array([words.index(x) for x in words])
        assert shared.equal_spans(*w[:3], w.raw, w.start[order], w.end[order]).tolist() == [x == words[i] for x, i in zip(words, order, strict=True)]


def test_words_of_equal_hashes_have_different_numbers(monkeypatch):
    real = S.span_hashes
    monkeypatch.setattr(S, "span_hashes", lambda *a: real(*a) & np.uint64(3))
    known = [f"w{i}" * (1 + i % 30) for i in range(40)]
    vocabulary, numbers = S._vocabulary(" ".join(known[i : i + 5]).encode() for i in range(36))
    asked = [x for i in range(80) for x in (f"w{i}" * (1 + i % 30), f"v{i}")]
    w = S.words_of([" ".join(asked).encode()])
    assert vocabulary.numbers(*w[:3]).tolist() == [numbers.get(x.encode(), 0) for x in asked] and sorted(numbers.values()) == list(range(1, 41))
