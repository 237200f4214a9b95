import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow import config
from strataflow.functions import dsp, sql
from strataflow.operators import lifecycle, moveout, velocity
from strataflow.sources import synthetic


def test_moveout_there_and_back(spark):
    t = np.arange(300) * 0.004
    x = np.array([np.sin(2 * np.pi * 5 * t) * np.exp(-((t - 0.6) ** 2) / 0.02)] * 3)
    df = spark.createDataFrame([(k, k * 200.0, row.tolist()) for k, row in enumerate(x)], "trace_index long, offset double, samples array<double>")
    v = velocity.linear(spark, 2000.0, 500.0, 1.2, 0.1)
    flat = moveout.nmo(df, v, 0.004, stretch=100.0)
    back = np.array([r.samples for r in moveout.inverse_nmo(flat, v, 0.004).orderBy("trace_index").collect()])
    assert np.abs(back - x)[:, 80:250].max() < 0.05
    linear, sinc = (np.array([r.samples for r in moveout.nmo(df, v, 0.004, method=m).orderBy("trace_index").collect()]) for m in ("linear", "sinc"))
    assert np.abs(linear - sinc)[:, 30:250].max() < 0.02
    with pytest.raises(ValueError, match="entries"):
        moveout.table_lookup([[0.0] * 2000] * 1000, F.lit(1), F.lit(1), (1.0, 1.0))


def test_velocity_conversions_undo_each_other(spark):
    knots = velocity.layered(spark, [(0, 1500), (0.5, 2000), (1.0, 2600)])
    rms = velocity.interval_to_rms(knots, "id").select("id", "t", F.col("v_rms").alias("v"), F.col("v").alias("was"))
    rows = velocity.rms_to_interval(rms, "id").join(rms.select("t", "was"), "t").where("t > 0.1").collect()
    assert all(r.v_interval == pytest.approx(r.was, rel=1e-6) for r in rows if r.t not in (0.5, 1.0))


def test_sql_functions(spark):
    sql.register(spark)
    x = np.random.default_rng(0).standard_normal(200)
    spark.createDataFrame([(x.tolist(),), (None,), ([],)], "samples array<double>").createOrReplaceTempView("t")
    rows = spark.sql("SELECT sf_bandpass(samples, 500D, 10D, 60D) a, sf_spectrum(samples) b, sf_dwt_denoise(samples) c FROM t").collect()
    assert np.allclose(rows[0].a, dsp.bandpass(x[None, :], 500, 10, 60)[0]) and len(rows[0].b) == 101
    assert spark.sql("SELECT x.* FROM t, LATERAL explode_samples(samples, 2.0D) x").count() == 200


def test_job_lifecycle(spark, tmp_path):
    m = lifecycle.Manager(spark)
    good, bad, off = (m.submit(n, "stack", tags=[n]) for n in ("good", "bad", "off"))
    assert m.run(good.id, lambda s: s.range(10).count()).state == "COMPLETED"
    with pytest.raises(ZeroDivisionError):
        m.run(bad.id, lambda s: 1 / 0)
    assert m.set(bad.id, "RETRYING").retry_count == 1 and m.cancel(off.id).state == "CANCELLED"
    with pytest.raises(ValueError, match="become"):
        m.set(good.id, "RUNNING")
    history = m.history()
    assert history.where("state = 'COMPLETED' AND duration >= 0").count() == 1
    lifecycle.export_json(history, str(tmp_path / "h"))
    again = lifecycle.import_json(spark, str(tmp_path / "h"), history)
    assert sorted(again.select("id", "state", "tags").collect()) == sorted(history.select("id", "state", "tags").collect())


def test_checkpoints_resume(spark, tmp_path):
    seen = []

    def work(part):
        if part == "c" and len(seen) < 3:
            seen.append("!")
            raise RuntimeError(part)
        seen.append(part)

    c = lifecycle.Checkpoint(spark, str(tmp_path / "ck"), {"v": 1})
    with pytest.raises(RuntimeError):
        c.run(["a", "b", "c"], work)
    assert c.run(["a", "b", "c"], work) == ["c"] and seen == ["a", "b", "!", "c"]
    assert lifecycle.Checkpoint(spark, str(tmp_path / "ck"), {"v": 2}).done() == set()


def test_imaging_jobs(spark):
    job = config.from_template("marine", "x", "in", "out", shape=(4, 4), spacing=(50.0, 50.0), origin=(400.0, 400.0), dt_ms=4.0, time_max_ms=800.0, aperture_m=200.0)
    assert config.ImagingJob.from_json(job.to_json()) == job and not job.problems()
    assert len(config.ImagingJob("", "a", "b", velocity=0, max_angle_deg=90).problems()) == 3
    traces = synthetic.diffractor(spark, nt=128).withColumn("azimuth", F.lit(10.0))
    bins = {r.bin_name for r in job.run(spark, traces).select("bin_name").distinct().collect()}
    assert bins == {"marine_0000_0500"}


def test_the_survey_image_grows_with_the_survey(spark, monkeypatch):
    from strataflow.operators import imaging
    from strataflow.plans import series

    x = np.random.default_rng(0).standard_normal((900, 64))
    t = spark.createDataFrame([(k % 20 * 25.0, k // 20 * 25.0, k % 40 * 50.0, row.tolist()) for k, row in enumerate(x)], "tx double, ty double, offset double, samples array<double>")
    grid = imaging.survey_grid(t, (50.0, 50.0))
    assert grid == imaging.Grid((0.0, 0.0), (50.0, 50.0), (11, 23))
    far = t.where("ty > 350 + 120")
    assert series.imaged(far, imaging.Grid((0.0, 0.0), (50.0, 50.0), (10, 8)), 2000.0).isEmpty()
    want = {}
    for k, row in enumerate(x):
        for il in range(11):
            for xl in range(23):
                h = np.hypot(il * 50 - k % 20 * 25, xl * 50 - k // 20 * 25)
                out = np.sqrt((np.arange(64) * 0.02) ** 2 + 4 * (h * h + (k % 40 * 25.0) ** 2) / 4e6)
                z = 1000.0 * out
                for i in np.flatnonzero((h < 120) & (out / 0.02 < 63.999) & (out > 0) & (h < z)):
                    key = il, xl, int(np.floor(out[i] / 0.02 + 1e-6))
                    s, n = want.get(key, (0.0, 0))
                    want[key] = s + row[i] * z[i] / (np.hypot(z[i], h) ** 3 + 1e-10), n + 1
    got = {(r.il, r.xl, r.t_index): (r.image, r.fold) for r in series.imaged(t, grid, 2000.0).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in want.items()} and max(k[1] for k in got) == 22
    assert all(got[k][0] == pytest.approx(s / n * 1e6, abs=2e-3) for k, (s, n) in want.items())
    monkeypatch.setattr(imaging, "CELLS", 64 * 9)  # tiles of 3 x 3 points
    small = {(r.il, r.xl, r.t_index): (r.image, r.fold) for r in series.imaged(t, grid, 2000.0).collect()}
    assert small.keys() == got.keys() and all(small[k][1] == got[k][1] and abs(small[k][0] - got[k][0]) < 2e-3 for k in got)
    assert series.imaged(t.limit(0), imaging.survey_grid(t.limit(0), (50.0, 50.0)), 2000.0).isEmpty()
    nulls = t.limit(1).selectExpr("tx", "ty", "CAST(null AS double) AS offset", "samples").unionByName(t.limit(1).withColumn("samples", F.lit(None).cast("array<double>")))
    assert series.imaged(nulls, grid, 2000.0).isEmpty()


def test_sort_order_by_one_sort(spark):
    from strataflow.operators import ensembles

    rows = [(k, (k // 4) % 3, None if k % 5 == 0 else k // 5, "x") for k in range(60)] + [(None, 0, 0, "x")]
    df = spark.createDataFrame(rows, "k long, a long, b long, c string")
    block = F.floor(F.col("k") / 7)
    keys = ["a", "b", "c", "k"]
    got = ensembles.sort_order(df, keys, ["k"], block)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in got.collect():
        values = [x[("k", "a", "b", "c").index(r.key)] for x in ordered]
        n, runs = len({v for v in values if v is not None}), 1 + sum(x != y for x, y in zip(values, values[1:], strict=False))
        penalty = 0.7 if 61 / n < 2 else 0.9 if 61 / n > 61 / 2 else 1.0
        assert (r.n_unique, r.n_runs, round(r.score, 9)) == (n, runs, round(n / runs * penalty, 9))
    assert got.count() == 4 and got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2  # rows and blocks, for all keys
    assert [(r.n_unique, r.n_runs, r.score) for r in ensembles.sort_order(df.where("k < 0"), ["a"], ["k"], block).collect()] == [(0, 0, None)]
