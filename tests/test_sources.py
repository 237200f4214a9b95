import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import imaging
from strataflow.sources import bundle, export, functions_of_depth, segy, synthetic
from strataflow.streaming import jobs as streaming


def section(spark, n=50):
    df = synthetic.gather(spark, n, 200)
    return df.selectExpr("trace_index", "cast(trace_index + 1 as int) trace_sequence_line", "100 field_record", "cast(1000 + trace_index div 5 as int) cdp", "cast(offset as int) offset", "samples")


@pytest.mark.parametrize(("code", "tolerance"), [(5, 0), (1, 1e-6)])
def test_segy_round_trip(spark, tmp_path, code, tolerance):
    path = str(tmp_path / "a.sgy")
    df = section(spark)
    assert segy.write(df, path, 2000, code) == 50
    assert segy.layout(path) == segy.Layout(200, 2000, code, 50)
    got = segy.read(spark, path, traces_per_task=7)
    assert got.rdd.getNumPartitions() == 8
    want = {r.trace_index: r for r in df.collect()}
    for r in got.collect():
        w = want.pop(r.trace_index)
        assert (r.trace_sequence_line, r.field_record, r.cdp, r.offset, r.sample_count, r.sample_interval) == (w.trace_sequence_line, 100, w.cdp, w.offset, 200, 2000)
        assert np.abs(np.array(r.samples) - np.array(w.samples)).max() <= tolerance
    assert not want
    short = segy.read(spark, path, {"line": (1, "i"), "beyond": (239, "i")}, samples=False)
    assert short.columns == ["trace_index", "line", "beyond"]
    assert [tuple(r) for r in short.where("trace_index < 2").collect()] == [(0, 1, 0), (1, 2, 0)]


def test_ibm_floats():
    x = np.array([0, 1, -1, 118.625, -118.625, 1e-5, 3.4e38, 5.4e-79], np.float64)
    words = segy.float_to_ibm(x)
    assert words[4] == 0xC276A000
    assert segy.ibm_to_float(words)[:7] == pytest.approx(x[:7], rel=1e-6)


def test_segy_template_and_ragged_traces(spark, tmp_path):
    a, b = str(tmp_path / "a.sgy"), str(tmp_path / "b.sgy")
    segy.write(section(spark, 10), a, 4000)
    segy.write(section(spark, 5), b, 4000, template=a)
    assert open(a, "rb").read(3200) == open(b, "rb").read(3200)
    ragged = section(spark, 5).selectExpr("trace_index", "slice(samples, 1, cast(trace_index + 1 as int)) samples")
    with pytest.raises(Exception, match="samples"):
        segy.write(ragged, b, 4000)


def test_bundle(spark, tmp_path):
    path = str(tmp_path / "data")
    bundle.save(section(spark), path, 2.0, ["cdp"])
    data = bundle.Bundle(spark, path)
    assert data.metadata == {"sample_rate_ms": 2.0, "n_traces": 50, "n_samples": 200, "ensemble_keys": ["cdp"]}
    rows = data.ensembles.orderBy("ensemble_id").collect()
    assert [(r.ensemble_id, r.cdp, r.start_trace, r.end_trace, r.n_traces) for r in rows] == [(k, 1000 + k, 5 * k, 5 * k + 4, 5) for k in range(10)]
    assert sorted(r.trace_index for r in data.ensemble(3).collect()) == [15, 16, 17, 18, 19]
    assert data.ensemble(99).count() == 0
    w = data.window(20, 60, 5, 8).collect()
    assert len(w) == 3 and {len(r.samples) for r in w} == {20}
    assert data.query("cdp = 1001 AND offset > 150").count() == 3
    assert data.statistics()["n_ensembles"] == 10


def test_velocity_files(spark, tmp_path):
    for name, text, columns, first in (
        ("tv.txt", "# t v\n0 1500\n\n// x\n1000, 2000\n", ["t", "v"], (0.0, 1500.0)),
        ("cdp.txt", "7\t0\t1500\n7\t1000\t2000\n", ["cdp", "t", "v"], (7, 0.0, 1500.0)),
        ("il.txt", "1 2 0 1500\n1 2 1000 2000\n", ["il", "xl", "t", "v"], (1, 2, 0.0, 1500.0)),
    ):
        path = tmp_path / name
        path.write_text(text)
        rows = functions_of_depth.read_velocity(spark, str(path))
        assert rows.columns == columns and tuple(rows.orderBy("t").first()) == first and rows.count() == 2
        out = str(tmp_path / f"out-{name}")
        functions_of_depth.write_velocity(rows, out)
        assert sorted(map(tuple, functions_of_depth.read_velocity(spark, out).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "v.json").write_text(json.dumps([{"t": 500, "v": 1800}]))
    assert tuple(functions_of_depth.read_velocity(spark, str(tmp_path / "v.json")).first()) == (0.5, 1800)
    assert tuple(functions_of_depth.preview(spark, str(tmp_path / "tv.txt")).first()) == (2, 0.0, 1.0, 1500.0, 2000.0)
    functions_of_depth.convert(spark, str(tmp_path / "tv.txt"), str(tmp_path / "interval"))
    assert functions_of_depth.read_velocity(spark, str(tmp_path / "interval")).orderBy("t").collect()[1].v == pytest.approx(2000)
    (tmp_path / "a.txt").write_text("0 0.1 0.05\n1 0.2 0.1\n")
    assert functions_of_depth.read_anisotropy(spark, str(tmp_path / "a.txt")).count() == 2


def test_geometries(spark):
    assert synthetic.marine(spark, 3, 4).count() == 12
    assert synthetic.land_3d(spark, (2, 2), (3, 3)).select("shot").distinct().count() == 4
    assert synthetic.volume(spark, 4, 5, 16).count() == 20


def test_a_diffractor_focuses(spark):
    grid = imaging.Grid((300.0, 300.0), (50.0, 50.0), (9, 9))
    image = imaging.migrate(synthetic.diffractor(spark), grid, 2000.0, 0.004, 256, 600.0, 60.0, mode="focus").where("t_index > 50").collect()
    best = max(image, key=lambda r: abs(r.image))
    assert (best.il, best.xl) == (4, 4) and abs(best.t_index * 0.004 - 0.4) <= 0.012


def rows_of(query, table, spark):
    query.processAllAvailable()
    query.stop()
    return sorted(map(tuple, spark.table(table).collect()))


def test_streams(spark, tmp_path):
    jobs = [(k, f"w{k % 2}", "FAILED" if k % 2 or k > 12 else "COMPLETED", datetime(2024, 1, 1, k // 6, 10 * (k % 6))) for k in range(24)]
    for name, part in (("a", jobs[:12]), ("b", jobs[12:])):
        spark.createDataFrame(part, "id long, worker string, state string, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / "jobs" / name))
    schema = "id long, worker string, state string, created_at timestamp"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "jobs" / "*"))
    q = streaming.consecutive_failure_alerts(source()).writeStream.format("memory").queryName("runs").start()
    assert rows_of(q, "runs", spark) == [("w0", datetime(2024, 1, 1, 3, 0), 3), ("w1", datetime(2024, 1, 1, 0, 50), 3)]
    q = streaming.error_rate_alerts(source(), rate=0.6).writeStream.format("memory").queryName("rates").outputMode("append").start()
    assert [r[0].hour for r in rows_of(q, "rates", spark)] == [2]


def test_gathers_of_a_stream_equal_the_batch(spark, tmp_path):
    values = "aaabbbbcaadd"
    rows = [("f", v, k) for k, v in enumerate(values)]
    for k in range(0, 12, 5):
        spark.createDataFrame(rows[k : k + 5], "file string, cdp string, trace_index long").coalesce(1).write.parquet(str(tmp_path / "h" / str(k)))
        if k == 0:
            first = spark.readStream.schema("file string, cdp string, trace_index long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "h" / "*"))
            q = streaming.gathers(first, "cdp").writeStream.format("memory").queryName("gathers").start()
        q.processAllAvailable()
    closed = [("f", "a", 0, 2, 3), ("f", "a", 8, 9, 2), ("f", "b", 3, 6, 4), ("f", "c", 7, 7, 1)]
    assert sorted(map(tuple, spark.table("gathers").collect())) == closed
    spark.createDataFrame([("f", None, None), ("g", "x", 0), ("g", None, None)], "file string, cdp string, trace_index long").coalesce(1).write.parquet(str(tmp_path / "h" / "end"))
    q.processAllAvailable()
    assert rows_of(q, "gathers", spark) == [*closed, ("f", "d", 10, 11, 2), ("g", "x", 0, 0, 1)]


def test_ingest(spark, tmp_path):
    section(spark, 10).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(section(spark, 1).schema).parquet(str(tmp_path / "in"))
    streaming.ingest(source, str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.where("trace_index > 3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def shots(spark, n, first=0):
    return section(spark, n).selectExpr(f"trace_index + {first} AS trace_index", "trace_sequence_line", f"cast((trace_index + {first}) div 7 as int) AS cdp", "offset", "samples")


@pytest.fixture
def three_files(spark, tmp_path):
    for k, (n, first) in enumerate(((20, 0), (1, 20), (29, 21))):
        segy.write(shots(spark, n, first), str(tmp_path / f"line{k}.sgy"), 4000)
    return f"{tmp_path}/line*.sgy"


def test_several_files_are_one(spark, three_files):
    rows = segy.read(spark, three_files, traces_per_task=8).orderBy("trace_index").collect()
    assert [r.trace_index for r in rows] == list(range(50)) and [r.cdp for r in rows] == [k // 7 for k in range(50)]
    assert segy.read(spark, three_files.rpartition("/")[0], columns=["cdp", "trace_index"]).columns == ["cdp", "trace_index"]
    last = segy.read(spark, ",".join(three_files.replace("*", k) for k in "20"), columns=["trace_index", "trace_sequence_line"]).where("trace_index = 29").first()
    assert last.trace_sequence_line == 1
    with pytest.raises(FileNotFoundError):
        segy.files_of(three_files.replace("line", "none"))


def read_bytes(reader, partitions):
    """Bytes that reading these partitions asks the system for, once modules are loaded."""
    list(reader.read(partitions[0]))
    asked = lambda: int(next(x for x in open("/proc/self/io") if x.startswith("rchar")).split()[1])
    before = asked()
    rows = sum(b.num_rows for p in partitions for b in reader.read(p))
    return asked() - before, rows


def test_headers_and_filters_read_no_other_samples(three_files):
    source = segy.SegyDataSource({"path": three_files, "columns": "trace_index,cdp"})
    reader = source.reader(source.schema())
    size, rows = read_bytes(reader, reader.partitions())
    assert rows == 50 and size < 50 * 240 + 3 * 4096 < 50 * 800
    source = segy.SegyDataSource({"path": three_files, "pushdown": "true", "tracespertask": "10"})
    reader = source.reader(source.schema())
    kept = list(reader.pushFilters([segy.EqualTo(("cdp",), 3), segy.GreaterThan(("trace_index",), 22), segy.EqualTo(("unknown",), 1)]))
    assert len(kept) == 3
    assert [(p.before + p.first, p.before + p.last) for p in reader.partitions()] == [(21, 31), (31, 41), (41, 50)]
    size, rows = read_bytes(reader, reader.partitions())
    assert rows == 5 and size < 29 * 240 + 5 * 1040 + 3 * 4096


def test_filters_are_pushed_by_the_session(spark, three_files):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = segy.read(spark, three_files, traces_per_task=10).where("trace_index >= 45 AND cdp IN (6, 7)").select("trace_index", "cdp")
        assert sorted(tuple(r) for r in df.collect()) == [(k, k // 7) for k in range(45, 50)]
        assert segy.read(spark, three_files, traces_per_task=10).where("trace_index >= 45").rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_import_is_one_pass_and_stitches_gathers(spark, three_files, tmp_path):
    data = bundle.import_segy(spark, three_files, str(tmp_path / "bundle"), ["cdp"], traces_per_task=8)
    assert data.metadata == {"sample_rate_ms": 4.0, "n_traces": 50, "n_samples": 200, "ensemble_keys": ["cdp"]}
    assert [(r.cdp, r.start_trace, r.n_traces) for r in data.ensembles.orderBy("ensemble_id").collect()] == [(k, 7 * k, min(7, 50 - 7 * k)) for k in range(8)]
    got = data.with_ensembles(each=4).collect()
    assert sorted((r.trace_index, r.ensemble_id, r.at) for r in got) == [(k, k // 7, k % 7) for k in range(50)]
    want = {r.trace_index: r.samples for r in segy.read(spark, three_files).collect()}
    assert {r.trace_index: r.samples for r in got} == want
    segy.write(shots(spark, 3), str(tmp_path / "line9.sgy"), 2000)
    with pytest.raises(ValueError, match="differ"):
        bundle.import_segy(spark, f"{tmp_path}/line*.sgy", str(tmp_path / "other"))


def test_export_in_order_muted_and_noise(spark, tmp_path):
    df, path = shots(spark, 50).repartition(5), f"{tmp_path}/out.sgy"
    half = df.withColumn("samples", F.transform("samples", lambda x: x / 2))
    mute = export.Mute(3000.0, 2.0, bottom=True, taper=4)
    assert export.export(half, path, 2000, ["offset", "cdp"], df, "noise", mute, "output") == 50
    want = sorted(df.collect(), key=lambda r: (r.offset, r.cdp, r.trace_index))
    quiet = {r.trace_index: r.samples for r in export.prepared(df, mute=mute).collect()}
    got = segy.read(spark, path).orderBy("trace_index").collect()
    assert [r.offset for r in got] == [r.offset for r in want]
    assert all(np.allclose(g.samples, np.array(quiet[w.trace_index]) / 2, atol=1e-6) for g, w in zip(got, want, strict=True))
    table = export.sorted_traces(df, ["offset", "cdp"], f"{tmp_path}/sorted")
    assert [r.original_trace_index for r in table.orderBy("trace_index").collect()] == [r.trace_index for r in want]
    for wrong in ({"what": "noise"}, {"what": "x"}, {"muted": "x"}):
        with pytest.raises(ValueError):
            export.prepared(df, **wrong)


def test_failed_and_empty_writes(spark, tmp_path):
    ragged = shots(spark, 5).selectExpr("trace_index", "slice(samples, 1, cast(trace_index + 1 as int)) samples")
    for many in (False, True):
        with pytest.raises(Exception, match="samples"):
            segy.write(ragged, f"{tmp_path}/bad/{many}", 4000, folder_of_files=many)
    assert [f.name for f in tmp_path.glob("bad/*.sgy")] == [] and not (tmp_path / "bad/False").exists()
    assert segy.write(shots(spark, 5).limit(0), f"{tmp_path}/empty.sgy", 4000) == 0
    assert (tmp_path / "empty.sgy").stat().st_size == 3600
    assert segy.write(shots(spark, 50).repartition(4), f"{tmp_path}/many", 4000, folder_of_files=True) == 50
    assert [r.cdp for r in segy.read(spark, f"{tmp_path}/many").orderBy("trace_index").collect()] == [k // 7 for k in range(50)]
    assert segy.text_header(f"{tmp_path}/empty.sgy")[0].startswith("C 1 written")


def test_synthetic_events_by_arrays(spark, sf):
    from strataflow.plans import files

    rows = spark.createDataFrame([(0,), (7,), (None,)], "trace_index long")
    wave = lambda t: (1 - 2 * (np.pi * 30 * t) ** 2) * np.exp(-((np.pi * 30 * t) ** 2))
    t = np.arange(300) * 0.002
    for noise in (0.0, 1e-9):
        got = {r.trace_index: r.samples for r in synthetic.events(rows, 300, noise=noise).collect()}
        for i in (0, 7):
            assert np.allclose(got[i], wave(t - 0.2) + 0.7 * wave(t - 0.4 - 0.001 * i) + 0.5 * wave(t - np.sqrt(0.36 + (i * 25 / 2000) ** 2)), atol=1e-6)
        assert got[None] == [None] * 300
    assert "lambda" not in synthetic.events(rows, 300, noise=0.0)._jdf.queryExecution().optimizedPlan().toString()  # not sample by sample
    assert files.synthetic_gather(spark, sf).rdd.getNumPartitions() == 4  # though its table is one file


def test_a_stream_over_several_files_is_one_batch(spark, sf, tmp_path, monkeypatch):
    from strataflow.plans import files
    from strataflow.plans.job_history import jobs

    monkeypatch.setattr(files, "folder", lambda s: str(tmp_path / str(len(list(tmp_path.iterdir())))))
    run = lambda more: sorted(map(tuple, files.streamed(lambda j: streaming.consecutive_failure_alerts(j, "worker", 2), "runs", more)(spark, sf).collect()))
    assert run(lambda j: j.repartition(5)) == run(lambda j: j) != []
    assert len(list(tmp_path.glob("0/in/*.parquet"))) == 5  # not put together by one task
    assert [len(list(tmp_path.glob(f"{k}/state/commits/[0-9]*"))) for k in (0, 1)] == [1, 1]
    assert jobs(spark, sf).count() == spark.read.parquet(str(tmp_path / "0/in")).count()
