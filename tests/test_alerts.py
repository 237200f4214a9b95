"""Rules by themselves, over a stream with timers, and what is listed of their alerts."""

from datetime import datetime, timedelta

import pytest

from strataflow.streaming import alerts as A


def watched(rules, events):
    watch = A.Watch(rules)
    for at, job, state in events:
        watch.see(at, job, state)
    return [(x[0], *x[3:]) for x in watch.found]


def test_failures_within_a_window_and_cooldown():
    rule = A.JobFailure(least=2, window_s=100, cooldown_s=50)
    events = [(0, "a", "FAILED"), (200, "b", "FAILED"), (260, "c", "COMPLETED"), (290, "d", "FAILED"), (310, "e", "FAILED"), (339, "f", "FAILED"), (340, "g", "FAILED")]
    # e and f fall into the cooldown: they neither trigger nor count
    assert watched((rule,), events) == [("Job Failure", 290, 2, None), ("Job Failure", 340, 2, None)]


def test_consecutive_failures():
    events = [(k, str(k), s) for k, s in enumerate(("FAILED", "RUNNING", "FAILED", "FAILED", "COMPLETED", "FAILED", "FAILED"))]
    assert watched((A.ConsecutiveFailures(threshold=2, cooldown_s=0),), events) == [("Consecutive Failures", 2, 2, None), ("Consecutive Failures", 3, 3, None), ("Consecutive Failures", 6, 2, None)]


def test_error_rates_by_sliding_windows():
    events = [(0, "a", "FAILED"), (0, "b", "COMPLETED"), (5, "r", "RUNNING"), (9, "c", "COMPLETED"), (10, "d", "CANCELLED"), (11, "e", "COMPLETED")]
    assert watched((A.ErrorRate(share=0.5, least=2, window_s=10, cooldown_s=0),), events) == [("High Error Rate", 0, 2, 0.5), ("High Error Rate", 10, 2, 0.5)]


def test_long_running_jobs_are_told_once_when_their_time_is_up():
    rule = A.LongRunning(duration_s=30, cooldown_s=0)
    events = [(0, "a", "RUNNING"), (10, "b", "RUNNING"), (20, "a", "COMPLETED"), (25, "b", "RUNNING"), (100, "c", "RUNNING"), (101, "c", "FAILED"), (500, "d", "QUEUED")]
    assert watched((rule,), events) == [("Long Running Job", 40, 1, None)]
    watch = A.Watch((rule,))
    watch.see(0, "x", "RUNNING")
    assert watch.next_due() == 30
    watch.pass_time(29)
    assert not watch.found
    watch.pass_time(31)
    assert [x[3] for x in watch.found] == [30] and watch.next_due() is None


def test_rules_need_names(spark):
    with pytest.raises(ValueError, match="names"):
        A.alerts(spark.createDataFrame([], "id long, worker string, state string, created_at timestamp"), (A.JobFailure(), A.JobFailure()))


def test_a_stream_keeps_state_fires_timers_and_forgets(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    batches = [
        [(1, "u", "RUNNING", at(0)), (2, "u", "FAILED", at(1)), (3, "v", "FAILED", at(1)), (4, None, "FAILED", at(1)), (5, "v", None, at(1))],
        [(6, "u", "FAILED", at(2)), (7, "w", "COMPLETED", at(90))],
        [(8, "w", "COMPLETED", at(200))],
        [(9, "v", "FAILED", at(201)), (10, "u", "FAILED", at(3))],
    ]
    schema = "id long, worker string, state string, created_at timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/all/{k}")
        (source,) = (tmp_path / "all" / str(k)).glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        source.rename(tmp_path / "in" / f"{k}.parquet")
    rules = (A.ConsecutiveFailures(threshold=2, cooldown_s=0), A.LongRunning(duration_s=1800, cooldown_s=0))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = A.alerts(source, rules, late="1 minute", live=timedelta(minutes=60))
    q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, r.rule, r["at"], r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # u's job is told by a timer though u is silent; v's first failure is forgotten after an hour; u's last event is later than the watermark
    assert got == [("u", "Consecutive Failures", at(2), 2), ("u", "Long Running Job", at(30), 1)]


def test_lists_and_counts(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", "Job Failure", "ERROR", "JOB", t, 1, None), ("a", "Job Failure", "ERROR", "JOB", t, 1, None), ("b", "Job Failure", "ERROR", "JOB", t + timedelta(1), 1, None), ("b", "High Error Rate", "WARNING", "PERFORMANCE", t, 5, 0.4)]
    found = A.identified(spark.createDataFrame(rows, A.ALERTS)).cache()
    assert found.count() == 3
    first = found.where("key = 'a'").first().alert_id
    acks = spark.createDataFrame([(first, t + timedelta(2)), (first, t + timedelta(1)), ("unknown", t)], "alert_id string, at timestamp")
    everything = A.listed(found, acks).collect()
    assert [(r.key, r.rule, r.acknowledged_at) for r in everything] == [("b", "Job Failure", None), ("a", "Job Failure", t + timedelta(1)), ("b", "High Error Rate", None)]
    assert [r.key for r in A.listed(found, acks, severity=["ERROR"], open_only=True).collect()] == ["b"]
    assert [r.rule for r in A.listed(found, category=["PERFORMANCE"]).collect()] == ["High Error Rate"]
    assert len(A.listed(found, limit=2).collect()) == 2
    assert {(r.rule, r.n, r["keys"]) for r in A.counted(found).collect()} == {("Job Failure", 2, 2), ("High Error Rate", 1, 1)}
