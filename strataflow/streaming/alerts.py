"""Alerts by rules over a stream of job events, with cooldowns, timers and time to live; and what is open of them.

Events (id, key, state, created_at) of one key go in order of time, a batch's rows sorted. All times are
the events' own, so that a run again gives the same alerts. A rule that has triggered rests for its cooldown, and doesn't see what happens
meanwhile. State of a key: a failure rule's last failures, a rate's results by the second within its window,
a count, running jobs, and when each rule triggered last. A key without events for the time to live is
forgotten. A job that runs too long is noticed when the watermark passes its time, though nothing arrives for it.

Rows with a null key, state or time are left out; events later than the watermark don't count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINAL = ("COMPLETED", "FAILED", "CANCELLED")
ALERTS = "key string, rule string, severity string, category string, at timestamp, n long, share double"


@dataclass(frozen=True)
class Rule:
    """What all rules have. see(event) is told the key's own state of the rule, the time (seconds), the job's id and state, and returns (state, n, share of failures) for an alert or (state, None, None)."""

    name: str = ""
    severity: str = "WARNING"
    category: str = "JOB"
    cooldown_s: float = 60.0

    def see(self, own: object, at: float, job: str, state: str) -> tuple[object, int | None, float | None]:
        raise NotImplementedError


@dataclass(frozen=True)
class JobFailure(Rule):
    """So many failures within a window."""

    name: str = "Job Failure"
    severity: str = "ERROR"
    least: int = 1
    window_s: float = 3600.0

    def see(self, own, at, job, state):
        if state != "FAILED":
            return own, None, None
        recent = [t for t in [*(own or []), at] if t > at - self.window_s][-self.least :]
        return recent, (self.least if len(recent) >= self.least else None), None


@dataclass(frozen=True)
class ConsecutiveFailures(Rule):
    """So many failures, or more, without a completed job between."""

    name: str = "Consecutive Failures"
    severity: str = "CRITICAL"
    threshold: int = 3

    def see(self, own, at, job, state):
        n = (own or 0) + 1 if state == "FAILED" else 0 if state == "COMPLETED" else own or 0
        return n, (n if state == "FAILED" and n >= self.threshold else None), None


@dataclass(frozen=True)
class ErrorRate(Rule):
    """A share of ended jobs, of at least so many within a window, that didn't complete."""

    name: str = "High Error Rate"
    category: str = "PERFORMANCE"
    share: float = 0.2
    least: int = 5
    window_s: float = 3600.0

    def see(self, own, at, job, state):
        if state not in FINAL:
            return own, None, None
        seconds = {float(k): v for k, v in (own or {}).items() if float(k) > at - self.window_s}
        n, bad = seconds.get(float(at), (0, 0))
        seconds[float(at)] = (n + 1, bad + (state != "COMPLETED"))
        n, bad = (sum(v[k] for v in seconds.values()) for k in (0, 1))
        hit = n >= self.least and bad / n >= self.share
        return {str(k): v for k, v in seconds.items()}, (n if hit else None), (bad / n if hit else None)


@dataclass(frozen=True)
class LongRunning(Rule):
    """A job that has run for so long; each job once."""

    name: str = "Long Running Job"
    duration_s: float = 1800.0

    def see(self, own, at, job, state):
        running = dict(own or {})
        if state == "RUNNING":
            running.setdefault(job, at)
        else:
            running.pop(job, None)
        return running, None, None

    def due(self, own: dict | None, now: float) -> list[tuple[str, float]]:
        """Jobs that have run too long by now, and when their time was up."""
        return sorted(((j, t + self.duration_s) for j, t in (own or {}).items() if t + self.duration_s <= now), key=lambda x: (x[1], x[0]))


DEFAULT = (JobFailure(), ConsecutiveFailures(), ErrorRate(), LongRunning())


class Watch:
    """The rules over one key's events. held: by rule its state and when it triggered last."""

    def __init__(self, rules: tuple[Rule, ...], held: dict | None = None):
        self.rules, self.held, self.found = rules, held or {}, []

    def _tell(self, rule: Rule, at: float, n: int, share: float | None) -> None:
        self.held[rule.name][1] = at
        self.found.append((rule.name, rule.severity, rule.category, at, n, share))

    def _rests(self, rule: Rule, at: float) -> bool:
        last = self.held.setdefault(rule.name, [None, None])[1]
        return last is not None and at - last < rule.cooldown_s

    def pass_time(self, now: float) -> None:
        for rule in self.rules:
            if isinstance(rule, LongRunning):
                own = self.held.setdefault(rule.name, [None, None])
                for job, at in rule.due(own[0], now):
                    own[0].pop(job)
                    if not self._rests(rule, at):
                        self._tell(rule, at, 1, None)

    def see(self, at: float, job: str, state: str) -> None:
        self.pass_time(at)
        for rule in self.rules:
            if not self._rests(rule, at):
                own, n, share = rule.see(self.held[rule.name][0], at, job, state)
                self.held[rule.name][0] = own
                if n is not None:
                    self._tell(rule, at, n, share)

    def next_due(self) -> float | None:
        times = [t + r.duration_s for r in self.rules if isinstance(r, LongRunning) for t in (self.held.get(r.name, [None])[0] or {}).values()]
        return min(times, default=None)


def alerts(events: DataFrame, rules: tuple[Rule, ...] = DEFAULT, by: str = "worker", late: str = "10 minutes", live: timedelta = timedelta(days=30)) -> DataFrame:
    """(key, rule, severity, category, at, n, share) as the rules trigger. events(id, by, state, created_at) is a stream; live: after so long without an event a key's state is removed."""
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("rules need names of their own")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0.0)
        watch, ended = Watch(rules, held), False
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() / 1000
            watch.pass_time(now)
            ended = now >= last + live.total_seconds()
        else:
            rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
            for at, job, what in zip(rows["created_at"].astype("datetime64[us]").astype("int64") / 1e6, rows["id"], rows["state"], strict=True):
                watch.see(at, str(job), what)
                last = max(last, at)
        if ended:
            state.remove()
        else:
            state.update((json.dumps(watch.held), last))
            due = min(x for x in (last + live.total_seconds(), watch.next_due()) if x is not None)
            state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
        found = [(key[0], *x[:3], pd.Timestamp(round(x[3] * 1e6), unit="us"), x[4], x[5]) for x in watch.found]
        yield pd.DataFrame(found, columns=["key", "rule", "severity", "category", "at", "n", "share"])

    rows = events.select(F.col("id").cast("string").alias("id"), F.col(by).cast("string").alias("key"), "state", F.col("created_at").cast("timestamp").alias("created_at")).na.drop()
    return rows.withWatermark("created_at", late).groupBy("key").applyInPandasWithState(run, ALERTS, "held string, last double", "append", GroupStateTimeout.EventTimeTimeout)


def identified(found: DataFrame) -> DataFrame:
    """Alerts with alert_id, the same whenever the same alert is told; told twice, it is one."""
    return found.withColumn("alert_id", F.sha2(F.concat_ws("|", "key", "rule", F.unix_micros("at").cast("string")), 256)).dropDuplicates(["alert_id"])


def listed(found: DataFrame, acknowledged: DataFrame | None = None, severity: list[str] | None = None, category: list[str] | None = None, open_only: bool = False, limit: int | None = 100) -> DataFrame:
    """The latest alerts (identified()) with acknowledged_at: the earliest of acknowledged(alert_id, at), null if there is none."""
    out = found
    for column, wanted in (("severity", severity), ("category", category)):
        if wanted:
            out = out.where(F.col(column).isin(wanted))
    if acknowledged is None:
        out = out.withColumn("acknowledged_at", F.lit(None).cast("timestamp"))
    else:
        out = out.join(acknowledged.groupBy("alert_id").agg(F.min("at").alias("acknowledged_at")), "alert_id", "left")
    if open_only:
        out = out.where("acknowledged_at IS NULL")
    return out.orderBy(F.desc("at"), "key", "rule").limit(limit) if limit else out


def counted(found: DataFrame) -> DataFrame:
    """(rule, severity, n, keys, last) by rule."""
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.max("at").alias("last"))
