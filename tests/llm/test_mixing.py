import re

import numpy as np
import pytest

from strataflow.llm import mixing as M
from strataflow.llm.shared import documents


def brute_targets(sizes):
    """Sources' targets by the rule as stated: cut at the cap, reshare the excess by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    capped = set()
    while over := [s for s in order if target[s] > 2 * sizes[s] * (1 + 1e-12) and s not in capped]:
        capped |= set(over)
        left, rest = total - sum(2 * sizes[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / rest for s in order}
    return target


def check(rows, docs):
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    want, largest = brute_targets(sizes), {}
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken in (0, r.size, 2 * r.size)
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s, t in want.items():
        assert abs(sum(r.taken for r in rows if r.source == s) - t) <= largest[s]


def test_targets_are_met_and_reruns_agree(spark, sf):
    docs = documents(spark, sf, "source")
    rows = M.mix(docs).collect()
    check(rows, docs.collect())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(docs.repartition(7)).collect()))


def test_levels_of_groups_meet_the_targets_too(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 4)
    docs = documents(spark, sf, "source")
    check(M.mix(docs).collect(), docs.collect())


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 1000, 5000), rng.random(5000)
    out = M.flight(size, p, rng.random(5000))
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    same = M.flight(np.full(100, 7), np.full(100, 0.25), rng.random(100))
    assert same.sum() == pytest.approx(25)


def test_inclusion_probabilities_hold_on_average():
    size, p, rng = np.arange(1, 31), np.full(30, 0.3), np.random.default_rng(2)
    mean = np.mean([M.flight(size, p, rng.random(30)) for _ in range(2000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.06


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b c", "x", 0.5, 1), (1, "a b c", "x", 0.5, 1), (None, "d e", None, 0.5, 1), (None, "d e", None, 0.5, 1), (2**60 + 1, None, "y", 0.5, 1), (4, "w " * 1000, "y", 0.5, 1)], "doc_id long, text string, source string, p double, n int")
    got = M.mix(rows).collect()
    check(got, rows.collect())
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows.collect())
    assert M.mix(rows.limit(0)).count() == 0
    taken = M.copies(rows)
    assert taken.columns == [*rows.columns, "copy"]
    assert sorted((str(r.doc_id), len((r.text or "").split())) for r in taken.collect()) == sorted((str(r.doc_id), r.size) for r in got for _ in range(r.times))
