"""KPI, counter and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators import drift, reports, training
from deployrisk.plans import duck, scoring, views
from deployrisk.plans.registry import Topic

TOPIC = Topic()


@TOPIC.query("agg_kpi", duck.sql("""
    SELECT tenant_id, builds, labelled, blocked, CAST(least(100, floor(labelled / 200.0::DOUBLE * 100)) AS INTEGER) AS progress_pct FROM (
      SELECT tenant_id, count(*) AS builds, count(*) FILTER (WHERE label IN (0, 1)) AS labelled,
             count(*) FILTER (WHERE score > 70) AS blocked FROM scored GROUP BY tenant_id)""", "scored"))
def agg_kpi(spark, sf):
    return reports.kpis(scoring.scored(spark, sf))


@TOPIC.query("agg_counters", duck.sql("""
    SELECT tenant_id, actor, count(*) AS actor_builds, sum(count(*)) OVER (PARTITION BY tenant_id)::BIGINT AS build_count,
           sum(count(*) FILTER (WHERE label IN (0, 1))) OVER (PARTITION BY tenant_id)::BIGINT AS labelled_count
    FROM heads GROUP BY tenant_id, actor""", "heads"))
def agg_counters(spark, sf):
    return reports.counters(views.build_heads(spark, sf))


@TOPIC.query("agg_label_dist", duck.sql("""
    SELECT tenant_id, label, count(*) AS rows, count(*) / sum(count(*)) OVER (PARTITION BY tenant_id) AS share
    FROM heads GROUP BY tenant_id, label""", "heads"))
def agg_label_dist(spark, sf):
    return reports.label_distribution(views.build_heads(spark, sf))


@TOPIC.query("agg_segment_risk", duck.sql("WITH d AS (SELECT * FROM filled WHERE label IN (0, 1)) " + " UNION ALL ".join(
    f"SELECT '{name}' AS segment, count(*) AS rows, avg(label) AS risky_share FROM d WHERE {where}" for name, where in {
        "hotfix": "is_hotfix = 1", "high_failure": "recent_failure_rate > 0.2::DOUBLE",
        "friday_afternoon": "day_of_week = 4 AND hour_of_day BETWEEN 16 AND 19",
        "tuesday_morning": "day_of_week = 1 AND hour_of_day BETWEEN 9 AND 12"}.items()), "filled"))
def agg_segment_risk(spark, sf):
    return reports.segment_risk(scoring.scored(spark, sf).filter(F.col("label").isin(0, 1)))


STATS_SQL = " UNION ALL ".join(f"""SELECT '{f}' AS feature, count({f}) AS "count", avg({f}) AS mean, stddev_samp({f}) AS std,
    CAST(min({f}) AS DOUBLE) AS "min", CAST(max({f}) AS DOUBLE) AS "max", quantile_cont(CAST({f} AS DOUBLE), 0.25) AS q25,
    quantile_cont(CAST({f} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({f} AS DOUBLE), 0.75) AS q75 FROM builds""" for f in K.FEATURES)


@TOPIC.query("agg_feature_stats", duck.sql(STATS_SQL, "builds"))
def agg_feature_stats(spark, sf):
    return reports.feature_stats(views.builds(spark, sf))


@TOPIC.query("agg_score_bands", duck.sql("""
    SELECT CASE WHEN s <= 20 THEN '0-20' WHEN s <= 40 THEN '21-40' WHEN s <= 60 THEN '41-60' WHEN s <= 80 THEN '61-80' ELSE '81-100' END AS band,
        count(*) AS builds FROM (SELECT CAST(floor(p * 100) AS INTEGER) AS s FROM scored) GROUP BY 1""", "scored"))
def agg_score_bands(spark, sf):
    return reports.score_bands(scoring.scored(spark, sf))


@TOPIC.query("agg_request_counter", duck.sql("""
    SELECT endpoint, status, count(*) AS requests FROM access_log GROUP BY ALL""", "access_log"))
def agg_request_counter(spark, sf):
    return reports.request_counter(views.access_log(spark, sf))


HIST_SQL = " UNION ALL ".join(
    [f"SELECT endpoint, count(*) AS \"count\", sum(seconds) AS \"sum\", '{b}' AS le, count(*) FILTER (WHERE seconds <= {b}::DOUBLE) AS bucket FROM access_log GROUP BY endpoint"
     for b in K.LATENCY_BOUNDS]
    + ["SELECT endpoint, count(*), sum(seconds), '+Inf', count(*) FROM access_log GROUP BY endpoint"])


@TOPIC.query("agg_latency_hist", duck.sql(HIST_SQL, "access_log"))
def agg_latency_hist(spark, sf):
    return reports.latency_histogram(views.access_log(spark, sf))


@TOPIC.query("agg_retrain_summary", duck.sql(f"""
    SELECT CASE WHEN labelled < {K.MIN_BUILDS} THEN 'skipped' ELSE 'trained' END AS outcome,
           CASE WHEN labelled < {K.MIN_BUILDS} THEN 'only ' || labelled || ' labelled builds' ELSE '' END AS reason, count(*) AS tenants
    FROM (SELECT tenant_id, count(*) AS labelled FROM heads WHERE label >= 0 AND tenant_id <> 'demo' GROUP BY tenant_id)
    GROUP BY ALL""", "heads"))
def agg_retrain_summary(spark, sf):
    """Outcomes of a nightly run; promoted and rejected fits count as trained, as which is which depends on the forest."""
    from deployrisk.plans.training import nightly
    paths, gated = nightly(spark, sf)
    found = training.outcomes(spark, paths, gated)
    skipped = F.col("outcome") == "skipped"
    return reports.outcome_summary(found.select(
        F.when(skipped, "skipped").otherwise("trained").alias("outcome"), F.when(skipped, F.col("reason")).otherwise("").alias("reason")))


from deployrisk.plans.evaluation import DRIFT_SQL  # noqa: E402


@TOPIC.query("agg_drift_summary", duck.sql(DRIFT_SQL + """
    SELECT verdict AS outcome, '' AS reason, count(*) AS tenants FROM verdicts GROUP BY verdict""", "builds"))
def agg_drift_summary(spark, sf):
    found = drift.verdicts(views.recent_builds(spark, sf, 2 * K.DRIFT_RUN), heads=views.build_heads(spark, sf))
    return reports.outcome_summary(found.select(F.col("verdict").alias("outcome"), F.lit("").alias("reason")))
