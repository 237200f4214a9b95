import random

from strataflow.llm import decontamination as D
from strataflow.llm.shared import documents


def brute(texts, items):
    """Which items' questions and answers overlap a text: by shingles of the whole text, without an index."""
    out = []
    for t in texts:
        words = D.words_of((t or "").encode())
        runs = {k: {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} for k in range(1, 6)}
        found = set()
        for i, text in items:
            parts = [D.shingles(p) for p in D.question_and_answer(text or "")]
            if any(parts) and all(sum(s in runs[len(s.split())] for s in p) >= 0.8 * len(p) for p in parts):
                found.add(i)
        out.append(sorted(found))
    return out


def test_a_table_equals_brute_force(spark, sf):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = docs.collect()
    want = brute([r.text for r in rows], [(r.item_id, r.text) for r in items.collect()])
    got = {r.doc_id: r.item_ids for r in D.contaminated(docs, items).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}
    assert any(want)


def test_wand_retrieves_every_segment_above_the_threshold():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for k in range(150)]
    index = D.build(items)
    n_found = 0
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(20, 100))
        have = sorted({index.terms[w.encode()] for w in words if w.encode() in index.terms})
        scores = [sum(x for t in have for s, x in zip(*index.postings[t], strict=True) if s == k) for k in range(len(index.owner))]
        want = [k for k, x in enumerate(scores) if x >= D.THRESHOLD - 1e-9]
        live = [b for b in range(index.bound.shape[1]) if index.bound[have, b].sum() >= D.THRESHOLD - D.ROUNDING]
        assert D.retrieved(index, have, live) == want == D.retrieved(index, have, list(range(index.bound.shape[1])))
        n_found += len(want)
    assert n_found > 50


def test_results_do_not_depend_on_the_parts(spark, monkeypatch):
    docs, items = documents(spark, "/root/testdata/sf0.01").where("doc_id < 400"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rng = random.Random(8)
    damaged = []
    for r in items.collect():
        words = r.text.split()
        words[rng.choice([0, -1])] = f"z{rng.random()}"
        damaged.append((10**6 + r.item_id, " ".join(words)))
    docs = docs.unionByName(spark.createDataFrame(damaged, "doc_id long, text string"))
    whole = {r.doc_id: r.item_ids for r in D.contaminated(docs, items).collect()}
    monkeypatch.setattr(D, "INDEX_BYTES", 1500)
    assert {r.doc_id: r.item_ids for r in D.contaminated(docs, items).collect()} == whole
    want = brute([t for _, t in damaged], [(r.item_id, r.text) for r in items.collect()])
    pairs = [(i, x) for (i, _), w in zip(damaged, want, strict=True) for x in w]
    assert len(pairs) > 20 and sum(x in whole[i] for i, x in pairs) >= 0.98 * len(pairs)


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "x one two y", "a", 5), (2, "none", "b", 6)], "doc_id long, text string, benchmark_items string, Benchmark_Items_ int")
    items = spark.createDataFrame([(7, "one two")], "item_id long, text string")
    assert [tuple(r) for r in D.clean(docs, items).collect()] == [(2, "none", "b", 6)]
    assert sorted(tuple(r) for r in D.with_items(docs, items).select("doc_id", "benchmark_items", "benchmark_items__").collect()) == [(1, "a", [7]), (2, "b", [])]


def test_edges_and_more_indexes_than_one(spark, monkeypatch):
    rng = random.Random(9)
    filler = lambda n: " ".join(f"z{rng.random()}" for _ in range(n))
    items = [(1, "The quick brown fox jumps over it. Where does the lazy dog sleep at night?"), (2, "one two"), (3, None), (4, "!!"), (5, " ".join(f"q{k}" for k in range(300)) + ". The last one is here today"), (6, "Where does the lazy dog sleep at night?")]
    texts = [filler(50) + " " + items[0][1].upper() + filler(70), "the quick brown fox jumps over it", "x one two y", None, "", filler(777) + " " + items[4][1] + " " + filler(333), filler(5000), items[5][1]]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[0], 1)], "doc_id long, text string, benchmark_item int")
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (D.INDEX_BYTES, 40):
        monkeypatch.setattr(D, "INDEX_BYTES", size)
        got = {r.doc_id: r.item_ids for r in D.contaminated(docs, table).collect()}
        assert got == {**dict(enumerate(brute(texts, items))), None: [1, 6]}
        assert sorted(r.doc_id for r in D.clean(docs, table).collect()) == [1, 3, 4, 6]
    assert D.contaminated(docs.limit(0), table).count() == 0
    assert D.clean(docs, table.limit(0)).count() == 9


def test_items_of_null_id_are_looked_for(spark, monkeypatch):
    items = [(None, "The quick brown fox jumps over it. Where does the lazy dog sleep at night?"), (None, "A second one without any id is also here to be found by all"), (4, "Some other words that nobody has written down before this day")]
    docs = spark.createDataFrame([(0, "x " + items[0][1]), (1, items[1][1] + " " + items[2][1] + " " + items[0][1]), (2, items[2][1]), (3, "none of them")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (D.INDEX_BYTES, 40):
        monkeypatch.setattr(D, "INDEX_BYTES", size)
        assert {r.doc_id: (r.n_items, r.item_ids) for r in D.contaminated(docs, table).collect()} == {0: (1, [None]), 1: (2, [4, None]), 2: (1, [4]), 3: (0, [])}
        assert [r.doc_id for r in D.clean(docs, table).collect()] == [3]
