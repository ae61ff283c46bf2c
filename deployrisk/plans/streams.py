"""Streaming queries, each compared with the same result computed in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import scalars as S
from deployrisk.operators import health, impute, scoring
from deployrisk.plans import duck, views
from deployrisk.plans.labelling import ASSUMED_SQL
from deployrisk.plans.registry import Topic
from deployrisk.plans.scoring import fleet_sql
from deployrisk.session import materialize
from deployrisk.streaming import jobs

TOPIC = Topic()


def event_stream(spark, sf):
    return jobs.file_stream(spark, f"{sf}/events.parquet", jobs.EVENTS)


@TOPIC.query("st_label_state", duck.sql("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY observed DESC, event_ts DESC, seq DESC) AS k FROM label_events)
    SELECT build_id, label, label_source, sample_weight, observed FROM r WHERE k = 1""", "label_events"))
def st_label_state(spark, sf):
    events = views.label_events(spark, sf, event_stream(spark, sf))
    return jobs.merge_labels(jobs.drain_partials(events, jobs.label_partials, jobs.merge_labels, "label-state")).drop("event_ts", "seq")


@TOPIC.query("st_score_stream", duck.sql(fleet_sql("27") + """
    SELECT build_id, tenant_id, score, CASE WHEN score <= coalesce(threshold_yellow, 40) THEN 'SAFE' WHEN score <= red THEN 'WARNING' ELSE 'BLOCKED' END AS verdict
    FROM s LEFT JOIN tenants USING (tenant_id)""", "builds", "tenants"))
def st_score_stream(spark, sf):
    """Arriving orders scored with static settings and medians, appended.

    Lines and medians are written once, so that a micro-batch only joins them.
    """
    orders = jobs.file_stream(spark, f"{sf}/orders.parquet", jobs.ORDERS)
    lines = materialize(views.order_lines(spark, sf), "order-lines")
    arriving = views.builds(spark, sf, views.build_heads(spark, sf, orders), lines=lines)
    medians = materialize(impute.tenant_medians(views.recent_builds(spark, sf, K.MEDIAN_HISTORY)), "medians")
    filled = impute.impute_serving(arriving, medians, F.col("hour_of_day"), F.col("day_of_week"))
    settled = scoring.with_settings(filled, views.tenants(spark, sf))
    scored = scoring.score_rows(settled, S.rule_risk(), F.col("threshold_yellow"), F.col("threshold_red"))
    return jobs.drain(scored.select("build_id", "tenant_id", "score", "verdict"), "scored")


OK_SQL = "coalesce(status >= 200 AND status < 400, false)"


@TOPIC.query("st_health_window", duck.sql(f"""
    WITH b AS (SELECT deploy_id, quantile_cont(latency_ms, 0.5) AS baseline_p50 FROM probes WHERE phase = 'baseline' AND {OK_SQL} GROUP BY deploy_id),
    w AS (SELECT deploy_id, count(*) AS total, count(*) FILTER (WHERE NOT {OK_SQL}) AS errors,
        quantile_cont(latency_ms, 0.5) FILTER (WHERE {OK_SQL}) AS p50, quantile_cont(latency_ms, 0.95) FILTER (WHERE {OK_SQL}) AS p95
      FROM probes GROUP BY deploy_id)
    SELECT deploy_id, total, errors, coalesce(p50, 0) AS latency_p50, coalesce(p95, 0) AS latency_p95, baseline_p50,
        CASE WHEN errors / CAST(total AS DOUBLE) > 0.2::DOUBLE OR coalesce(baseline_p50 > 0 AND p50 > 2 * baseline_p50, false) THEN 'DEGRADED' ELSE 'HEALTHY' END AS verdict
    FROM w LEFT JOIN b USING (deploy_id)""", "probes"))
def st_health_window(spark, sf):
    """A window per deploy and day (the sample events are sparse)."""
    baselines = health.baseline(health.with_ok(views.probes(spark, sf)).filter("phase = 'baseline'"))
    probes = views.probes(spark, sf, event_stream(spark, sf))
    parts = jobs.drain_partials(probes, lambda batch: jobs.health_partials(batch, "1 day"), jobs.merge_probes, "health")
    return jobs.merge_health(parts, baselines).select(
        "deploy_id", "total", "errors", "latency_p50", "latency_p95", "baseline_p50", "verdict")


@TOPIC.query("st_rate_limit", duck.sql("""
    SELECT 'k:' || substr(sha256(api_key), 1, 32) AS limiter_key, CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, count(*) AS requests
    FROM access_log GROUP BY ALL HAVING count(*) > 4""", "access_log"))
def st_rate_limit(spark, sf):
    """Day windows with a limit of four, as the sample log is sparse; the default is 120 a minute."""
    log = views.access_log(spark, sf, event_stream(spark, sf))
    parts = jobs.drain_partials(log, lambda batch: jobs.request_partials(batch, jobs.limiter_key(), "1 day"), jobs.merge_requests, "over-limit")
    return jobs.merge_over_limit(parts, 4).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@TOPIC.query("rate_limit_batch", duck.sql("""
    SELECT 'k:' || substr(sha256(api_key), 1, 32) AS limiter_key, CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, count(*) AS requests
    FROM access_log GROUP BY ALL HAVING count(*) > 4""", "access_log"))
def rate_limit_batch(spark, sf):
    over = jobs.over_limit(views.access_log(spark, sf), jobs.limiter_key(), window="1 day", limit=4)
    return over.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@TOPIC.query("st_actor_count", duck.sql("SELECT tenant_id, actor, count(*) AS builds FROM heads GROUP BY ALL", "heads"))
def st_actor_count(spark, sf):
    orders = jobs.file_stream(spark, f"{sf}/orders.parquet", jobs.ORDERS)
    return jobs.merge_actors(jobs.drain_partials(views.build_heads(spark, sf, orders), jobs.actor_partials, jobs.merge_actors, "actor-builds"))


@TOPIC.query("st_access_metrics", duck.sql("""
    SELECT endpoint, status, CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, count(*) AS requests, sum(seconds) AS seconds,
        count(*) FILTER (WHERE seconds <= 0.1::DOUBLE) AS le_0_1, count(*) FILTER (WHERE seconds <= 1.0::DOUBLE) AS le_1_0
    FROM access_log GROUP BY ALL""", "access_log"))
def st_access_metrics(spark, sf):
    log = views.access_log(spark, sf, event_stream(spark, sf))
    return jobs.merge_access(jobs.drain_partials(log, jobs.access_partials, jobs.merge_access, "access")).select(
        "endpoint", "status", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
        "seconds", "le_0_1", "le_1_0")


ITEMS = "l_orderkey bigint"


@TOPIC.query("st_assumed_ok_stream", duck.sql(ASSUMED_SQL, "heads"))
def st_assumed_ok_stream(spark, sf):
    """Arriving orders and lines: an order is assumed fine once it is 30 days old and no line ever came."""
    builds = views.build_heads(spark, sf, jobs.file_stream(spark, f"{sf}/orders.parquet", jobs.ORDERS)).select("build_id", "tenant_id", "timestamp")
    lines = jobs.file_stream(spark, f"{sf}/lineitem.parquet", ITEMS).select(
        views.build_id_of("l_orderkey").alias("build_id"), F.lit(None).cast("string").alias("tenant_id"), F.lit(None).cast("long").alias("timestamp"))
    parts = jobs.drain_partials(builds.unionByName(lines), jobs.quiet_partials, jobs.merge_quiet, "quiet-builds")
    return jobs.assumed_ok(parts, F.lit(996624000))
