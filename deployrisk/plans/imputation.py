"""Imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators import history, impute
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic
from deployrisk.plans.scoring import MEDIANS_SQL
from deployrisk.session import materialize

TOPIC = Topic()


@TOPIC.query("imp_tenant_median", duck.sql("WITH " + MEDIANS_SQL + " SELECT * FROM medians", "builds"))
def imp_tenant_median(spark, sf):
    return impute.tenant_medians(views.recent_builds(spark, sf, K.MEDIAN_HISTORY))


def _serving(f: str) -> str:
    guess = f"coalesce({f}_median, {K.TRAINING_MEDIANS[f]}::DOUBLE)"
    if f in K.INT_FEATURES:
        guess = f"CAST(round_even({guess}, 0) AS INTEGER)"
    return f"coalesce(b.{f}, {guess}) AS {f}"


@TOPIC.query("imp_serving", duck.sql("WITH " + MEDIANS_SQL + """
    SELECT build_id, CASE WHEN label < 0 THEN 9 ELSE hour_of_day END AS hour_of_day, day_of_week, """ + ", ".join(
    _serving(f) for f in K.FEATURES if f not in K.CLOCK_FEATURES) + """,
        array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN {'label < 0' if f == 'hour_of_day' else f'b.{f} IS NULL'} THEN '{f}' END" for f in K.FEATURES) + """],
            lambda x: x IS NOT NULL), ',') AS imputed,
        CASE WHEN label < 0 THEN 'clock' ELSE 'provided' END AS hour_source,
        CASE WHEN b.test_pass_rate IS NOT NULL THEN 'provided' WHEN test_pass_rate_median IS NOT NULL THEN 'tenant_median' ELSE 'training_median' END AS pass_rate_source
    FROM builds b LEFT JOIN medians USING (tenant_id)""", "builds"))
def imp_serving(spark, sf):
    rows = views.builds(spark, sf)
    medians = impute.tenant_medians(views.recent_builds(spark, sf, K.MEDIAN_HISTORY))
    # pending builds lost their hour, so the clock has to fill it
    sent = rows.withColumn("hour_of_day", F.when(F.col("label") >= 0, F.col("hour_of_day")))
    filled = impute.impute_serving(sent, medians, F.lit(9), F.lit(3))
    return filled.select("build_id", *K.FEATURES, F.array_join("imputed", ",").alias("imputed"),
                         F.col("sources")["hour_of_day"].alias("hour_source"),
                         F.col("sources")["test_pass_rate"].alias("pass_rate_source"))


def _as_of(f: str) -> str:
    guess = f"coalesce(CASE WHEN {f}_n >= {K.MEDIAN_MIN_ROWS} THEN {f}_before END, {f}_model, {K.TRAINING_MEDIANS[f]}::DOUBLE)"
    if f in K.INT_FEATURES:
        guess = f"CAST(round_even({guess}, 0) AS INTEGER)"
    return f"coalesce({f}, {guess}) AS {f}"


@TOPIC.query("imp_serving_as_of", duck.sql("WITH w AS (SELECT *, " + ", ".join(
    f"quantile_cont(CAST({f} AS DOUBLE), 0.5) OVER before AS {f}_before, count({f}) OVER before AS {f}_n" for f in K.FEATURES) + f"""
        FROM builds WINDOW before AS (PARTITION BY tenant_id ORDER BY timestamp, build_id ROWS BETWEEN {K.MEDIAN_HISTORY} PRECEDING AND 1 PRECEDING)),
    m AS (SELECT tenant_id, """ + ", ".join(f"quantile_cont(CAST({f} AS DOUBLE), 0.5) AS {f}_model" for f in K.FEATURES) + """ FROM builds WHERE label >= 0 GROUP BY tenant_id)
    SELECT build_id, """ + ", ".join(_as_of(f) for f in K.FEATURES) + f""",
        CASE WHEN test_pass_rate IS NOT NULL THEN 'provided' WHEN test_pass_rate_n >= {K.MEDIAN_MIN_ROWS} THEN 'tenant_median' ELSE 'training_median' END AS pass_rate_source
    FROM w LEFT JOIN m USING (tenant_id)""", "builds"))
def imp_serving_as_of(spark, sf):
    """Every build filled with the medians of the builds before it, then of the rows its tenant's model learns from."""
    rows = materialize(views.builds(spark, sf).select("tenant_id", "build_id", "timestamp", "label", *K.FEATURES), "builds")
    learned = impute.column_medians(rows.filter("label >= 0"), ["tenant_id"])
    filled = impute.impute_as_of(rows, learned, F.lit(9), F.lit(3))
    return filled.select("build_id", *K.FEATURES, F.col("sources")["test_pass_rate"].alias("pass_rate_source"))


@TOPIC.query("join_medians", duck.sql("WITH " + MEDIANS_SQL + """
    SELECT build_id, diff_size_median, test_pass_rate_median FROM builds LEFT JOIN medians USING (tenant_id)""", "builds"))
def join_medians(spark, sf):
    medians = impute.tenant_medians(views.recent_builds(spark, sf, K.MEDIAN_HISTORY)).select(
        "tenant_id", "diff_size_median", "test_pass_rate_median")
    return views.build_heads(spark, sf).join(medians, "tenant_id", "left").select(
        "build_id", "diff_size_median", "test_pass_rate_median")


def _training(f: str) -> str:
    guess = f"coalesce({f}_m, {K.TRAINING_MEDIANS[f]}::DOUBLE)"
    if f in K.INT_FEATURES:
        guess = f"round_even({guess}, 0)"
    return f"coalesce(CAST({f} AS DOUBLE), {guess}) AS {f}"


def _all_medians() -> str:
    return ", ".join(f"quantile_cont(CAST({f} AS DOUBLE), 0.5) AS {f}_m" for f in K.FEATURES)


@TOPIC.query("imp_training", duck.sql("WITH m AS (SELECT tenant_id, " + _all_medians() + """ FROM builds WHERE label >= 0 GROUP BY tenant_id)
    SELECT build_id, """ + ", ".join(_training(f) for f in K.FEATURES) + " FROM builds JOIN m USING (tenant_id) WHERE label >= 0", "builds"))
def imp_training(spark, sf):
    decided = views.builds(spark, sf).filter(F.col("label") >= 0)
    return impute.impute_training(decided).select("build_id", *K.FEATURES)


@TOPIC.query("imp_global_median", duck.sql("WITH m AS (SELECT " + _all_medians() + """ FROM builds)
    SELECT build_id, """ + ", ".join(f"coalesce(CAST({f} AS DOUBLE), {f}_m) AS {f}" for f in K.FEATURES) + " FROM builds, m", "builds"))
def imp_global_median(spark, sf):
    return impute.impute_global(views.builds(spark, sf)).select("build_id", *K.FEATURES)


@TOPIC.query("imp_train_only", duck.sql("WITH b AS (SELECT *, year(to_timestamp(timestamp) AT TIME ZONE 'UTC') <= 1999 AS train FROM builds), m AS (SELECT "
    + _all_medians() + """ FROM b WHERE train)
    SELECT build_id, CASE WHEN train THEN 'train' ELSE 'test' END AS part, """ + ", ".join(
    f"coalesce(CAST({f} AS DOUBLE), {f}_m, {K.TRAINING_MEDIANS[f]}::DOUBLE) AS {f}" for f in K.FEATURES) + " FROM b, m", "builds"))
def imp_train_only(spark, sf):
    rows = history.split_by_year(views.builds(spark, sf).withColumn(
        "year", F.year(F.timestamp_seconds("timestamp"))), 1999)
    train, test = impute.impute_train_only(rows.filter("part = 'train'"), rows.filter("part = 'test'"))
    return train.unionByName(test).select("build_id", "part", *K.FEATURES)


@TOPIC.query("imp_zero", duck.sql("SELECT build_id, " + ", ".join(f"coalesce({f}, 0) AS {f}" for f in K.FEATURES) + " FROM builds", "builds"))
def imp_zero(spark, sf):
    return impute.impute_zero(views.builds(spark, sf)).select("build_id", *K.FEATURES)
