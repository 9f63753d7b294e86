"""Queries: batch twins of the streaming operators; tests run the streams themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweave.operators import scoring as C
from taskweave.operators import text as X
from taskweave.plans import fixtures as V
from taskweave.plans.registry import query
from taskweave.plans.scoring import covered, tokens_sql
from taskweave.streaming import monitor as M

G = "WITH " + V.CTE_LOG
SHARES = {"E0": 0.5, "E1": 0.3, "E23": 0.2}


@query("st_class_mix", G + " SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, cohort, label, count(*)::BIGINT AS n FROM log GROUP BY ALL")
def st_class_mix(spark, sf):
    return M.class_mix(V.scoring_log(spark, sf))


@query("st_review_rate", G + ", w AS (SELECT date_trunc('hour', ts) - to_hours(k) AS s, review_score, coverage FROM log, (SELECT unnest(generate_series(0, 5))::INT AS k)) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n, count(*) FILTER (review_score >= 0.8)::BIGINT AS review, count(*) FILTER (coverage < 0.2)::BIGINT AS low_coverage FROM w GROUP BY s")
def st_review_rate(spark, sf):
    return M.review_rate(V.scoring_log(spark, sf))


@query("st_mix_shift", G + ", d AS (SELECT date_trunc('day', ts) AS s, count(*)::BIGINT AS n, round(greatest(abs(avg((label = 'E0')::INT) - 0.5), abs(avg((label = 'E1')::INT) - 0.3), abs(avg((label = 'E23')::INT) - 0.2)), 6) AS shift FROM log GROUP BY 1) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, n, shift, shift >= 0.1 AS alert FROM d")
def st_mix_shift(spark, sf):
    return M.mix_shift(V.scoring_log(spark, sf), SHARES)


@query("st_quality_sample", G + f", d AS (SELECT event_id, review_score, {V.h(chr(39) + 'quality|' + chr(39) + ' || event_id')} % 1000 AS d FROM log) SELECT event_id, CASE WHEN review_score >= 0.8 THEN 'high' ELSE 'low' END AS stratum FROM d WHERE d < CASE WHEN review_score >= 0.8 THEN 100 ELSE 10 END")
def st_quality_sample(spark, sf):
    return M.quality_sample(V.scoring_log(spark, sf), "event_id").select("event_id", "stratum")


#: A time for each call of the panel.
AT = "(TIMESTAMP '2024-01-01' + to_days((parent % 7)::INT) + to_hours((h1 % 24)::INT))"


def timed(spark, sf):
    return V.responses(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("parent") % 7 * 86400 + F.col("h1") % 24 * 3600))


@query("st_retry_latency", "WITH " + V.CTE_PANEL + f" SELECT strftime(date_trunc('day', {AT}), '%Y-%m-%d %H:%M:%S') AS start, model, count(*)::BIGINT AS calls, sum(attempt_count)::BIGINT AS attempts, round(avg((status = 'error')::INT), 6) AS error_rate, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM responses GROUP BY ALL")
def st_retry_latency(spark, sf):
    return M.retry_latency(timed(spark, sf), "model")


def response_log(spark, sf):
    """The log, with a tenth of its calls answered again an hour later by another label."""
    r = timed(spark, sf).join(V.raw_responses(spark, sf), "call_id").select("call_id", "status", "raw", "h1", "ts")
    return r.unionByName(r.where("h1 < 10").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).withColumn("raw", F.lit("E3 - later")))


@query("st_response_ingest", "WITH " + V.CTE_PANEL + " SELECT call_id, label FROM responses WHERE status = 'success'")
def st_response_ingest(spark, sf):
    """One row a call, its first success, parsed."""
    return M.first_success(response_log(spark, sf)).select("call_id", X.parsed_label(F.col("raw")).alias("label"))


def request_error():
    c = F.col
    return X.request_error(c("task"), c("action"), c("object"), F.coalesce("purpose", F.lit("")), c("jobrole_title"))


def scored(rows, coverage):
    return rows.select("task_id").join(coverage, "task_id").select("task_id", C.review_score(F.lit(0.0), F.col("coverage"), F.col("n_tokens")).alias("review_score"))


FITS = " AND ".join(f"length(coalesce({column}, '')) <= {X.LIMITS[name]}" for name, column in {"task": "task", "title": "jobrole_title", "action": "action", "object": "object", "purpose": "purpose"}.items())


@query("st_score", "WITH " + V.CTE_TASKS + ", " + tokens_sql("labelled") + f" SELECT task_id, round(least(greatest(1 - coverage, CASE WHEN n_tokens < 4 THEN 0.25 ELSE 0 END, 0.5), 1), 4) AS review_score FROM cov JOIN tasks USING (task_id) WHERE (trim(task) <> '' OR (trim(action) <> '' AND trim(object) <> '')) AND {FITS}")
def st_score(spark, sf):
    """Valid requests with a review score at a margin of 0; requests with too long a field are rejects."""
    valid, _ = M.split_valid(V.labelled(spark, sf), request_error())
    return scored(valid, covered(spark, sf))
