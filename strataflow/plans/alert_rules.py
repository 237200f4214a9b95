"""Queries of alert rules over the events' stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.plans.files import streamed
from strataflow.plans.job_history import SQL
from strataflow.streaming import alerts

RULES = (alerts.JobFailure(cooldown_s=5 * 86400.0), alerts.ConsecutiveFailures(threshold=2, cooldown_s=0.0), alerts.ErrorRate(share=0.6, least=4, window_s=10 * 86400.0, cooldown_s=0.0))
COLUMNS = ("key", "rule", "severity", "category", "at", "n")


def told(jobs):
    return alerts.alerts(jobs, RULES)


def rules(s, d):
    return streamed(told, "alerts")(s, d).select(*COLUMNS, F.round("share", 6).alias("share"))


def by_rule(s, d):
    return alerts.counted(alerts.identified(streamed(told, "alerts")(s, d)))


_ALERTS = (
    SQL.replace("WITH j AS", "WITH RECURSIVE j AS")
    + """,
f AS (SELECT CAST(worker AS VARCHAR) AS key, created_at AS "at" FROM j WHERE state = 'FAILED'),
c AS (SELECT key, min("at") AS "at" FROM f GROUP BY key UNION ALL SELECT c.key, (SELECT min(f."at") FROM f WHERE f.key = c.key AND f."at" >= c."at" + INTERVAL 5 DAY) AS "at" FROM c WHERE c."at" IS NOT NULL),
b AS (SELECT *, count(*) FILTER (WHERE state = 'COMPLETED') OVER (PARTITION BY worker ORDER BY created_at, CAST(id AS VARCHAR)) AS streak FROM j),
k AS (SELECT worker, created_at, row_number() OVER (PARTITION BY worker, streak ORDER BY created_at, CAST(id AS VARCHAR)) AS n FROM b WHERE state = 'FAILED'),
e AS (SELECT * FROM j WHERE state IN ('COMPLETED', 'FAILED', 'CANCELLED')),
w AS (SELECT x.worker, x.id, x.created_at, count(*) AS n, count(*) FILTER (WHERE y.state <> 'COMPLETED') AS bad FROM e x JOIN e y ON x.worker = y.worker AND y.created_at > x.created_at - INTERVAL 10 DAY
  AND (y.created_at < x.created_at OR (y.created_at = x.created_at AND CAST(y.id AS VARCHAR) <= CAST(x.id AS VARCHAR))) GROUP BY ALL),
a AS (SELECT key, 'Job Failure' AS rule, 'ERROR' AS severity, 'JOB' AS category, "at", CAST(1 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS share FROM c WHERE "at" IS NOT NULL
UNION ALL SELECT CAST(worker AS VARCHAR), 'Consecutive Failures', 'CRITICAL', 'JOB', created_at, n, NULL FROM k WHERE n >= 2
UNION ALL SELECT CAST(worker AS VARCHAR), 'High Error Rate', 'WARNING', 'PERFORMANCE', created_at, n, bad / n FROM w WHERE n >= 4 AND bad / n >= 0.6)
"""
)
QUERIES = {
    "alert_rules": (rules, _ALERTS + 'SELECT key, rule, severity, category, "at", n, round(share, 6) AS share FROM a'),
    "alert_counts": (by_rule, _ALERTS + 'SELECT rule, severity, count(DISTINCT (key, "at")) AS n, count(DISTINCT key) AS keys, max("at") AS last FROM a GROUP BY rule, severity'),
}
