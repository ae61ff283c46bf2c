"""Deploy-health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import sinks
from deployrisk.functions import alerts
from deployrisk.operators import health
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic

TOPIC = Topic()

OK_SQL = "coalesce(status >= 200 AND status < 400, false)"


@TOPIC.query("hw_ok", duck.sql(f"SELECT probe_id, {OK_SQL} AS ok FROM probes", "probes"))
def hw_ok(spark, sf):
    return health.with_ok(views.probes(spark, sf)).select("probe_id", "ok")


@TOPIC.query("hw_percentile", duck.sql(f"""
    SELECT deploy_id, coalesce(quantile_cont(latency_ms, 0.5) FILTER (WHERE {OK_SQL}), 0) AS p50,
        coalesce(quantile_cont(latency_ms, 0.95) FILTER (WHERE {OK_SQL}), 0) AS p95 FROM probes GROUP BY deploy_id""", "probes"))
def hw_percentile(spark, sf):
    samples = health.with_ok(views.probes(spark, sf)).withColumn("latency_ms", F.when(F.col("ok"), F.col("latency_ms")))
    return health.percentiles(samples, ["deploy_id"], "latency_ms", {"p50": 0.5, "p95": 0.95})


@TOPIC.query("hw_baseline", duck.sql(f"""
    SELECT deploy_id, quantile_cont(latency_ms, 0.5) AS baseline_p50 FROM probes WHERE phase = 'baseline' AND {OK_SQL} GROUP BY deploy_id""", "probes"))
def hw_baseline(spark, sf):
    return health.baseline(health.with_ok(views.probes(spark, sf)).filter("phase = 'baseline'"))


def evaluated(spark, sf):
    samples = health.with_ok(views.probes(spark, sf))
    deploys = samples.select("deploy_id").distinct()
    return health.evaluate(deploys, samples.filter("phase = 'watch'"),
                           health.baseline(samples.filter("phase = 'baseline'")))


EVAL_SQL = f"""WITH w AS (SELECT deploy_id, count(*) AS total, count(*) FILTER (WHERE NOT {OK_SQL}) AS errors,
        quantile_cont(latency_ms, 0.5) FILTER (WHERE {OK_SQL}) AS p50, quantile_cont(latency_ms, 0.95) FILTER (WHERE {OK_SQL}) AS p95
      FROM probes WHERE phase = 'watch' GROUP BY deploy_id),
    b AS (SELECT deploy_id, quantile_cont(latency_ms, 0.5) AS baseline_p50 FROM probes WHERE phase = 'baseline' AND {OK_SQL} GROUP BY deploy_id),
    j AS (SELECT deploy_id, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, p50, p95, baseline_p50,
        CASE WHEN total > 0 THEN errors / CAST(total AS DOUBLE) ELSE 1.0::DOUBLE END AS error_rate
      FROM (SELECT DISTINCT deploy_id FROM probes) LEFT JOIN w USING (deploy_id) LEFT JOIN b USING (deploy_id)),
    r AS (SELECT *, total = 0 AS dead, total > 0 AND error_rate > 0.2::DOUBLE AS failing, coalesce(baseline_p50 > 0 AND p50 > baseline_p50 * 2, false) AS slow FROM j),
    e AS (SELECT *, CASE WHEN dead OR failing OR slow THEN 'DEGRADED' ELSE 'HEALTHY' END AS verdict,
        CASE WHEN NOT (dead OR failing OR slow) THEN 'error rate and latency stayed within thresholds' ELSE concat_ws('; ',
          CASE WHEN dead THEN 'no samples collected — service unreachable' END,
          CASE WHEN failing THEN 'error rate ' || CAST(round_even(error_rate * 100, 0) AS INTEGER) || '% exceeds 20% threshold (' || errors || '/' || total || ' probes failed)' END,
          CASE WHEN slow THEN 'latency p50 ' || CAST(round_even(p50, 0) AS INTEGER) || 'ms is over 2x the baseline (' || CAST(round_even(baseline_p50, 0) AS INTEGER) || 'ms)' END) END AS reasons FROM r)"""


@TOPIC.query("hw_evaluate", duck.sql(EVAL_SQL + """
    SELECT deploy_id, total, errors, error_rate, coalesce(p50, 0) AS latency_p50, coalesce(p95, 0) AS latency_p95, baseline_p50, verdict, reasons FROM e""", "probes"))
def hw_evaluate(spark, sf):
    return evaluated(spark, sf).select(
        "deploy_id", "total", "errors", "error_rate", "latency_p50", "latency_p95", "baseline_p50", "verdict",
        F.array_join("reasons", "; ").alias("reasons"))


@TOPIC.query("hw_actions", duck.sql(EVAL_SQL + """
    SELECT deploy_id, verdict, CASE WHEN verdict = 'HEALTHY' THEN '' ELSE concat_ws(',', CASE WHEN total % 2 = 1 THEN 'slack' END,
        CASE WHEN errors % 2 = 1 THEN 'rollback' END) END AS actions FROM e""", "probes"))
def hw_actions(spark, sf):
    reports = evaluated(spark, sf)
    taken = health.actions(reports, F.when(F.col("total") % 2 == 1, "https://hooks.example"),
                           F.when(F.col("errors") % 2 == 1, "make rollback"))
    return taken.select("deploy_id", "verdict", F.array_join("actions", ",").alias("actions"))


@TOPIC.query("hw_label", duck.sql(EVAL_SQL + """
    SELECT 'b-' || deploy_id AS build_id, CASE WHEN verdict = 'HEALTHY' THEN 0 ELSE 1 END AS label,
        CASE WHEN verdict = 'HEALTHY' THEN 'sentinel_healthy' ELSE 'sentinel_degraded' END AS label_source FROM e WHERE total % 5 <> 0""", "probes"))
def hw_label(spark, sf):
    reports = evaluated(spark, sf).withColumn("build_id", F.when(
        F.col("total") % 5 != 0, F.concat(F.lit("b-"), F.col("deploy_id"))))
    return health.to_label_events(reports)


@TOPIC.query("alert_health", duck.sql(EVAL_SQL + """
    SELECT deploy_id, ':rotating_light: *Deploy DEGRADED*' || chr(10) || reasons AS text FROM e WHERE verdict = 'DEGRADED'""", "probes"))
def alert_health(spark, sf):
    """A message for each degraded deploy, appended to the alert table."""
    path = sinks.new_table(spark, "health-alerts")
    bad = evaluated(spark, sf).filter("verdict = 'DEGRADED'")
    sinks.append_rows(bad.select("deploy_id", alerts.health_text(F.col("reasons")).alias("text")), path)
    return spark.read.schema("deploy_id string, text string").parquet(path)
