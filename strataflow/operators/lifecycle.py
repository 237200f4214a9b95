"""Jobs: states and their transitions, history, checkpoints, and cancellation through Spark's job tags."""

from __future__ import annotations

import dataclasses
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Which state may follow which.
NEXT = {
    "PENDING": {"QUEUED", "RUNNING", "CANCELLED"},
    "QUEUED": {"RUNNING", "CANCELLED"},
    "RUNNING": {"PAUSED", "COMPLETED", "FAILED", "CANCELLED", "TIMEOUT"},
    "PAUSED": {"RUNNING", "CANCELLED"},
    "FAILED": {"RETRYING"},
    "TIMEOUT": {"RETRYING"},
    "RETRYING": {"QUEUED", "RUNNING", "CANCELLED"},
    "COMPLETED": set(),
    "CANCELLED": set(),
}


@dataclasses.dataclass
class Job:
    name: str
    job_type: str
    state: str = "PENDING"
    id: str = dataclasses.field(default_factory=lambda: uuid.uuid4().hex)
    priority: str = "NORMAL"
    created_at: datetime = dataclasses.field(default_factory=lambda: datetime.now(UTC))
    started_at: datetime | None = None
    completed_at: datetime | None = None
    error_message: str | None = None
    retry_count: int = 0
    max_retries: int = 3
    tags: list[str] = dataclasses.field(default_factory=list)
    config: str = "{}"

    def to(self, state: str, error: str | None = None) -> Job:
        """The job in its next state; a state that may not follow is an error."""
        if state not in NEXT[self.state]:
            raise ValueError(f"{self.state} can't become {state}")
        if state == "RETRYING" and self.retry_count >= self.max_retries:
            raise ValueError(f"no retry left of {self.max_retries}")
        now = datetime.now(UTC)
        return dataclasses.replace(
            self, state=state, error_message=error or self.error_message, retry_count=self.retry_count + (state == "RETRYING"),
            started_at=now if state == "RUNNING" and not self.started_at else self.started_at, completed_at=now if not NEXT[state] or state in ("FAILED", "TIMEOUT") else self.completed_at,
        )

    @property
    def duration(self) -> float | None:
        return (self.completed_at - self.started_at).total_seconds() if self.started_at and self.completed_at else None


SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "job_type", "state", "priority", "error_message", "config")]
    + [T.StructField(n, T.TimestampType()) for n in ("created_at", "started_at", "completed_at")]
    + [T.StructField(n, T.IntegerType()) for n in ("retry_count", "max_retries")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("duration", T.DoubleType())]
)


class Manager:
    """Jobs run under a Spark tag of their id, so cancelling one interrupts its tasks wherever they run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, {}

    def submit(self, name: str, job_type: str, config: dict | None = None, tags: list[str] | None = None) -> Job:
        job = Job(name, job_type, tags=tags or [], config=json.dumps(config or {}))
        self.jobs[job.id] = job
        return job

    def set(self, job_id: str, state: str, error: str | None = None) -> Job:
        self.jobs[job_id] = self.jobs[job_id].to(state, error)
        return self.jobs[job_id]

    def run(self, job_id: str, work) -> Job:
        """Runs work(spark) as the job; what it raises makes the job failed, and is raised on."""
        self.set(job_id, "RUNNING")
        self.spark.addTag(job_id)
        try:
            work(self.spark)
        except BaseException as e:
            if self.jobs[job_id].state == "RUNNING":
                self.set(job_id, "FAILED", str(e)[:1000])
            raise
        finally:
            self.spark.removeTag(job_id)
        return self.set(job_id, "COMPLETED")

    def cancel(self, job_id: str) -> Job:
        self.spark.interruptTag(job_id)
        return self.set(job_id, "CANCELLED")

    def history(self) -> DataFrame:
        names = SCHEMA.fieldNames()
        return self.spark.createDataFrame([tuple(getattr(j, n) for n in names) for j in self.jobs.values()], SCHEMA)


def export_json(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, into: DataFrame | None = None) -> DataFrame:
    """A history of a JSON folder; with into, rows of the same id are replaced."""
    read = spark.read.schema(SCHEMA).json(path)
    return read if into is None else into.join(read.select("id"), "id", "left_anti").unionByName(read)


class Checkpoint:
    """Which parts of a job are done, as one small file for each: a part that is begun again overwrites its own output."""

    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.path, self.key = spark, path, json.dumps(config, sort_keys=True)

    def done(self) -> set[str]:
        """Parts done under this configuration; others' marks don't count."""
        try:
            rows = self.spark.read.schema("part string, config string").json(f"{self.path}/done").where("part IS NOT NULL").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return set()
            raise
        return {r["part"] for r in rows if r["config"] == self.key}

    def mark(self, part: str) -> None:
        self.spark.createDataFrame([(part, self.key)], "part string, config string").coalesce(1).write.mode("append").json(f"{self.path}/done")

    def run(self, parts: list[str], work) -> list[str]:
        """work(part) of those parts that aren't done, each marked after; returns what was run."""
        left = [p for p in parts if p not in self.done()]
        for p in left:
            work(p)
            self.mark(p)
        return left
