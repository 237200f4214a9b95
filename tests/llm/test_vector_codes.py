import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from strataflow.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(vec_id, code, error, label_error, sha) by the definition, in plain Python."""
    kept = [(i, e, lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max((len(e) for _, e, _ in kept), default=0) // 4) * 4
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in e] + [0] * (width - len(e)), lab) for i, e, lab in kept]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = width // 4
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, v, _ in ints[:256]] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda v, p: min((dist(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        found = [[find(v, p)[1] for p in range(4)] for _, v, _ in ints]
        for p in range(4):
            groups = defaultdict(list)
            for (_, v, _), f in zip(ints, found, strict=True):
                groups[f[p]].append(part(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, labels = [], defaultdict(int)
    for i, v, lab in ints:
        hits = [find(v, p) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in hits), sum(x for x, _ in hits), lab))
        labels[lab] += out[-1][2]
    return sorted(((i, c, e, labels[lab], sha) for i, c, e, lab in out), key=str)


def got(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in V.vector_codes(spark.createDataFrame(rows, schema)).collect()), key=str)


@pytest.mark.parametrize("n,dims", [(60, 8), (400, 12)])
def test_equals_the_definition(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.normal(0, 0.1, dims).astype(np.float32).tolist(), int(i % 3)) for i in rng.permutation(n)]
    assert got(spark, rows) == plain(rows)


def test_ties_repeats_nulls_and_lengths(spark):
    a, b = [0.5, -0.25, 0.0, 1.0, 0.1, 0.2, 0.3, 0.4], [0.5, -0.25, 0.0, 1.0]
    rows = [(3, a, 1), (3, a, 1), (2, a, None), (None, b, None), (None, a, 2), (1, None, 1), (4, [1.0, None], 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] * 8, 1), (7, [], 1), (3, b, 1), (8, a[:7], 2)]
    assert got(spark, rows) == plain(rows)


def test_empty_tables_and_vectors_without_dimensions(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None)]) == []
    assert got(spark, [(1, [], None), (2, [], 3)]) == plain([(1, [], None), (2, [], 3)])


def test_extra_columns_and_other_types(spark):
    rows = [(1, [1.5, 2.5, 0.5, -1.0], "x", 9), (2, [1.0, 2.0, 0.0, -1.0], None, 9)]
    assert got(spark, rows, "vec_id int, embedding array<double>, label string, code int") == plain([r[:3] for r in rows])


def test_huge_components_are_held(spark):
    rows = [(1, [3e38, -3e38, 0.0, 0.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1)]
    assert [r[2] for r in got(spark, rows)] == [0, 0]


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(0)
    for spread in (3, 1000):
        parts, book = rng.integers(-spread, spread, (3000, 16)), rng.integers(-spread, spread, (256, 16))
        d = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        code, error = V.nearest(parts, book)
        assert (code == d.argmin(axis=1)).all()
        assert (error == d.min(axis=1)).all()
