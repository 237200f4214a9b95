import random

import numpy as np
import pytest
import xxhash

from strataflow.llm import components as C
from strataflow.llm import simhash as S
from strataflow.llm.shared import documents


def brute_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    out, left = {}, dict(fps)
    for start in sorted(fps):
        if start in left:
            todo, seen = [start], {start}
            del left[start]
            while todo:
                x = fps[todo.pop()]
                near = [k for k, y in left.items() if (x ^ y).bit_count() <= radius]
                for k in near:
                    del left[k]
                todo += near
                seen |= set(near)
            out |= dict.fromkeys(seen, min(seen))
    return out


def test_fingerprints_of_a_table(spark, sf):
    docs = documents(spark, sf)
    got = {r.doc_id: r.fp % 2**64 for r in S.fingerprints(docs).collect()}
    assert got == {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}


def test_components_of_a_table_equal_brute_force(spark, sf):
    docs = documents(spark, sf)
    want = brute_components({r.doc_id: brute_fingerprint(r.text) for r in docs.collect()})
    got = S.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("most", [1 << 22, 1000])
def test_balls_link_exactly_what_is_near(monkeypatch, spark, most):
    monkeypatch.setattr(S, "MOST_VALUES", most)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), d)) for c in centres for d in (0, 1, 2, 3, 4, 5, 8) for _ in range(3)})
    rows = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    roots = {r.node % 2**64: r.root for r in C.components(S.links(rows, len(fps))).collect()}
    want = brute_components(dict(enumerate(fps)))
    same = lambda i, j: fps[i] in roots and fps[j] in roots and roots[fps[i]] == roots[fps[j]]
    assert all(same(i, j) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_a_long_chain_is_one_component(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in C.components(rows).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and roots[1000] == roots[1001] != roots[0]


def test_nulls_ties_and_empty_tables(spark):
    text = "one two three four five six seven"
    rows = spark.createDataFrame([(7, text, "x"), (3, text.upper(), "y"), (3, text.upper(), "y"), (9, None, "x"), (8, " \n", "x"), (None, "", "z"), (5, "alone here", "z")], "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, 8), (5, 5)], key=str)
    assert {r.fingerprint for r in S.near_duplicates(rows).collect() if r.component_id == 8} == {"0" * 16}
    assert S.near_duplicates(rows.limit(0)).count() == 0


def test_very_long_text():
    text = " ".join(random.Random(1).choices(["ab", "cd", "ef", "gh", "ij"], k=70000))
    assert S.fingerprint(text.encode()) == brute_fingerprint(text)
