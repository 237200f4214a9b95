"""Every registered query of the library's own operators, against DuckDB where it has SQL."""

import datetime
import glob
import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strataflow.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    r = oracle.execute(SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(columns)
    want = Counter(tuple(map(same, row)) for row in r.fetchall())
    assert Counter(tuple(same(row[c]) for c in columns) for row in df.collect()) == want


def test_a_bin_join_by_cells_equals_the_broadcast(spark, sf, monkeypatch):
    from strataflow.operators import binning
    from strataflow.plans import gathers

    for how in ("inner", "left"):
        want = Counter(map(tuple, binning.assign(gathers.indexed(spark, sf), gathers.BINS, how=how).collect()))
        with monkeypatch.context() as m:
            m.setattr(binning, "MOST_BROADCAST", 0)
            assert Counter(map(tuple, binning.assign(gathers.indexed(spark, sf), gathers.BINS, how=how).collect())) == want


def test_computed_headers_refuse_what_they_do_not_know(spark):
    from strataflow.functions import headers

    df = spark.createDataFrame([(1, 0.0)], "a long, b double")
    for bad in ("__import__('os')", "a.b", "a if b else 1", "[a]", "open(a)", "missing + 1"):
        with pytest.raises(ValueError):
            headers.computed(df, {"x": bad})
    with pytest.raises(ValueError, match="depend"):
        headers.computed(df, {"x": "y + 1", "y": "x + 1"})
    assert headers.computed(df, {"x": "a / b", "y": "x + sqrt(-a)", "z": "round(2.5) + 2 ** 3"}).first().asDict() == {"a": 1, "b": 0.0, "x": 0.0, "y": 0.0, "z": 10.0}
    assert headers.validate(["SX", "sy", "gx", "gy"], ["offset", "cdp", "source_x"]) == {"offset": "computable", "cdp": "missing", "source_x": "present"}


def test_presets():
    from strataflow.operators import binning as b

    assert [len(b.preset(p)) for p in ("land_3d", "marine", "wide_azimuth_ovt", "narrow_azimuth", "full_stack")] == [10, 6, 16, 4, 1]
    assert [x.offset_max for x in b.preset("land_3d")] == [200, 400, 600, 800, 1000, 1500, 2000, 2500, 3000, 5000]
    assert b.narrow_azimuth(inline_azimuth=350, width=20)[0][3:5] == (340, 360.0)
    assert [x.bin_name for x in b.ovt([(0, 500)], 2)] == ["ovt_off0000_az000", "ovt_off0000_az180"]
    log = b.custom_offset(0, 1000, 3, True)
    assert log[0].offset_min == 0 and log[-1].offset_max == pytest.approx(1000) and log[1].offset_max / log[1].offset_min == pytest.approx(10)


def test_agc_takes_its_floor_from_the_gather_and_can_be_undone(spark):
    from strataflow.operators import traces as X

    rows = [(0, 7, [1.0, -2.0, 3.0, 4.0, 0.5]), (1, 7, [0.0] * 5), (2, 8, [1e-3, 0.0, -1e-3, 2e-3, 0.0])]
    df = spark.createDataFrame(rows, "trace_index long, gather long, samples array<double>")
    out = {r.trace_index: r for r in X.agc(df, 1).collect()}
    floor = {7: 0.001 * (sum(x * x for _, g, s in rows for x in s if g == 7) / 10) ** 0.5, 8: 0.001 * (sum(x * x for x in rows[2][2]) / 5) ** 0.5}
    for i, g, s in rows:
        wide = [s[0], *s, s[-1]]
        scales = [1 / ((sum(x * x for x in wide[k : k + 3]) / 3) ** 0.5 + floor[g]) for k in range(5)]
        assert out[i].scales == pytest.approx(scales) and out[i].samples == pytest.approx([x * k for x, k in zip(s, scales, strict=True)])
    undone = X.agc(df, 1).select("trace_index", X.remove_agc(F.col("samples"), F.col("scales")).alias("a")).collect()
    assert all(r.a == pytest.approx(rows[r.trace_index][2]) for r in undone)


def test_weighted_stacks_and_inlines_by_hand(spark):
    from strataflow.operators import stacking as S

    rows = [(1, 5, -100.0, [1.0, 2.0]), (1, 5, 50.0, [3.0, 0.0, 7.0]), (1, 5, None, [5.0]), (1, 6, 0.0, [2.0]), (2, 5, 10.0, None), (2, None, 10.0, [1.0]), (None, 9, 1.0, [1.0])]
    df = spark.createDataFrame(rows, "inline long, cdp long, offset double, samples array<double>")
    got = {(r.cdp, r.sample_index): (r.stack, r.fold) for r in S.weighted_stack(df, "cdp").collect()}
    want = {(5, 0): ((0.5 * 1 + 0.75 * 3 + 5) / 2.25, 3), (5, 1): (2.0, 1), (5, 2): (7.0, 1), (6, 0): (2.0, 1), (9, 0): (1.0, 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    lines = S.stack_inlines(df, [1, 2])
    assert {tuple(r) for r in lines.collect()} == {(1, 5, 0, 3.0, 3), (1, 5, 1, 2.0, 1), (1, 5, 2, 7.0, 1), (1, 6, 0, 2.0, 1), (2, None, 0, 1.0, 1)}
    assert S.stack_inlines(df, []).count() == 0 and S.stack_inlines(df, [3]).columns == lines.columns
