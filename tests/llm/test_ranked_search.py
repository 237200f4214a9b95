import math
import random
from collections import Counter

import numpy as np

from strataflow.llm import ranked_search as R
from strataflow.llm.shared import documents


def terms(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if run:
                out.append(run)
            run = ""
        else:
            run += c.lower() if "A" <= c <= "Z" else c
    return out


def plain(docs, items):
    """(item_id, rank, doc_id, score) by the definition."""
    found = [(i, t) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, total = len(found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, t in found:
            tf, m = Counter(t), 75 + 25 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in terms(text) if tf[x])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, k, d, -s) for k, (s, _, d) in enumerate(scored[:20], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_a_table_equals_brute_force(spark, sf):
    docs, items = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert got(R.search(docs, items)) == plain([tuple(r) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_results_do_not_depend_on_parts_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    items = [(i, " ".join(rng.choice("abcdefghijklmn") for _ in range(5))) for i in range(30)]
    want = plain(docs, items)
    for name, value in (("PART_BYTES", 40), ("MOST_IMPACTS", 50), ("MOST_ITEMS", 4), ("GROUP", 1)):
        with monkeypatch.context() as m:
            m.setattr(R, name, value)
            assert got(R.search(*frames(spark, docs, items))) == want


def test_nulls_ties_repeats_and_characters(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (4, "Ärger ärger straße"), (5, "a_b a-b\x00c"), (5, "a_b a-b\x00c"), (None, "a b"), (None, "a b"), (7, "b " * 100_000), *((k, "same text here") for k in range(60, 30, -1)), (8, "İ 東京 x1")]
    items = [(1, "A"), (1, "A"), (2, "b c"), (None, "same here same"), (3, None), (4, "  "), (5, "ärger"), (6, "unknown"), (7, "東京 X1 İ")]
    assert got(R.search(*frames(spark, docs, items))) == plain(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = frames(spark, [(1, "a")], [(1, "a")])
    assert got(R.search(docs.where("doc_id > 1"), items)) == []
    assert got(R.search(docs, items.where("item_id > 1"))) == []
    assert got(R.search(docs.selectExpr("*", "1 AS n", "2 AS score"), items.selectExpr("*", "1 AS copies", "2 AS rank"))) == plain([(1, "a")], [(1, "a")])


def test_radix_sort_orders_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 32, 10_000, dtype=np.uint32)
    assert (keys[R.radix_sorted(keys)] == np.sort(keys)).all()
