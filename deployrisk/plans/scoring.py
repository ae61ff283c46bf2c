"""End-to-end scoring of all builds of all tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import scalars as S
from deployrisk.operators import impute, scoring
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic
from deployrisk.session import materialize

TOPIC = Topic()


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Builds with unknowns at their fixed medians, rule risk as the probability."""
    return scoring.score_rows(scoring.fill_fixed(views.builds(spark, sf)), S.rule_risk())


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Decided builds with a probability and the true outcome."""
    return scored(spark, sf).filter(F.col("label").isin(0, 1)).select(
        "tenant_id", "build_id", "timestamp", "p", F.col("label").alias("y"))


def score_all(spark: SparkSession, sf: str) -> DataFrame:
    """The whole request path in batch: history, medians, fill, score, tenant verdict.

    Builds are put together once and written; history, medians and scores read that table.
    """
    base = materialize(views.builds(spark, sf), "score-base")
    medians = impute.tenant_medians(base)
    rows = scoring.with_actor_history(base).withColumn(
        "deployer_exp", F.when(F.col("server_exp") > 0, F.col("server_exp").cast("int")))
    filled = impute.impute_serving(rows, medians, F.col("hour_of_day"), F.col("day_of_week"))
    settled = scoring.with_settings(filled, views.tenants(spark, sf))
    return scoring.score_rows(settled, S.rule_risk(), F.col("threshold_yellow"), F.col("threshold_red"))


MEDIANS_SQL = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS r FROM builds),
    medians AS (SELECT tenant_id, """ + ", ".join(
    f"CASE WHEN count({f}) >= 8 THEN quantile_cont(CAST({f} AS DOUBLE), 0.5) END AS {f}_median" for f in K.FEATURES) + """
        FROM ranked WHERE r <= 50 GROUP BY tenant_id)"""


FLEET_SQL = """WITH """ + MEDIANS_SQL + """,
    hist AS (SELECT build_id, row_number() OVER (PARTITION BY tenant_id, actor ORDER BY timestamp, build_id) - 1 AS server_exp FROM builds),
    f AS (SELECT b.tenant_id, b.build_id,
        coalesce(b.diff_size, CAST(round_even(coalesce(diff_size_median, 105), 0) AS INTEGER)) AS diff_size,
        coalesce(b.files_changed, CAST(round_even(coalesce(files_changed_median, 4), 0) AS INTEGER)) AS files_changed,
        hour_of_day, day_of_week,
        coalesce(b.recent_failure_rate, recent_failure_rate_median, 0.261::DOUBLE) AS recent_failure_rate,
        coalesce(b.test_pass_rate, test_pass_rate_median, 0.819::DOUBLE) AS test_pass_rate,
        coalesce(b.is_hotfix, CAST(round_even(coalesce(is_hotfix_median, 0), 0) AS INTEGER)) AS is_hotfix,
        EXP AS deployer_exp,
        coalesce(b.days_since_deploy, days_since_deploy_median, 2.7::DOUBLE) AS days_since_deploy,
        CASE WHEN b.diff_size IS NULL THEN 1 ELSE 0 END + CASE WHEN b.files_changed IS NULL THEN 1 ELSE 0 END
          + CASE WHEN b.recent_failure_rate IS NULL THEN 1 ELSE 0 END + CASE WHEN b.test_pass_rate IS NULL THEN 1 ELSE 0 END
          + CASE WHEN b.is_hotfix IS NULL THEN 1 ELSE 0 END + CASE WHEN server_exp = 0 THEN 1 ELSE 0 END
          + CASE WHEN b.days_since_deploy IS NULL THEN 1 ELSE 0 END + CASE WHEN b.build_time_delta IS NULL THEN 1 ELSE 0 END AS guesses
      FROM builds b JOIN hist USING (build_id) LEFT JOIN medians USING (tenant_id)),
    s AS (SELECT f.*, coalesce(threshold_red, 70) AS red, CAST(round_even(100 * least(1.0::DOUBLE,
            CASE WHEN recent_failure_rate > 0.20::DOUBLE THEN 0.27::DOUBLE WHEN recent_failure_rate > 0.10::DOUBLE THEN 0.15::DOUBLE ELSE 0 END
          + CASE WHEN is_hotfix = 1 THEN 0.22::DOUBLE ELSE 0 END
          + CASE WHEN test_pass_rate < 0.60::DOUBLE THEN 0.20::DOUBLE WHEN test_pass_rate < 0.75::DOUBLE THEN 0.10::DOUBLE ELSE 0 END
          + CASE WHEN diff_size > 400 THEN 0.18::DOUBLE WHEN diff_size > 150 THEN 0.08::DOUBLE ELSE 0 END
          + CASE WHEN hour_of_day BETWEEN 16 AND 19 THEN 0.12::DOUBLE ELSE 0 END
          + CASE WHEN hour_of_day >= 22 OR hour_of_day <= 5 THEN 0.10::DOUBLE ELSE 0 END
          + CASE WHEN day_of_week = 4 THEN 0.10::DOUBLE WHEN day_of_week >= 5 THEN 0.07::DOUBLE ELSE 0 END
          + CASE WHEN days_since_deploy > 14 THEN 0.08::DOUBLE ELSE 0 END
          + CASE WHEN days_since_deploy > 30 THEN 0.05::DOUBLE ELSE 0 END
          + CASE WHEN deployer_exp <= 5 THEN 0.05::DOUBLE ELSE 0 END
          + CASE WHEN files_changed > 20 THEN 0.03::DOUBLE ELSE 0 END
          + CASE WHEN day_of_week = 4 AND diff_size > 200 THEN 0.08::DOUBLE ELSE 0 END
          + CASE WHEN is_hotfix = 1 AND hour_of_day >= 16 THEN 0.06::DOUBLE ELSE 0 END
          + CASE WHEN recent_failure_rate > 0.15::DOUBLE AND test_pass_rate < 0.80::DOUBLE THEN 0.06::DOUBLE ELSE 0 END
          + CASE WHEN diff_size > 300 AND test_pass_rate < 0.85::DOUBLE THEN 0.06::DOUBLE ELSE 0 END), 0) AS INTEGER) AS score
      FROM f LEFT JOIN tenants USING (tenant_id))"""


def fleet_sql(experience: str) -> str:
    """The scoring path in SQL with the given expression for deployer experience."""
    return FLEET_SQL.replace("EXP AS", f"{experience} AS")


@TOPIC.query("score_fleet", duck.sql(fleet_sql("CASE WHEN server_exp > 0 THEN server_exp ELSE 27 END") + """
    SELECT tenant_id, count(*) AS builds, sum(CASE WHEN score > red THEN 1 ELSE 0 END)::BIGINT AS blocked,
           sum(guesses)::BIGINT AS guessed_features, sum(score)::BIGINT AS score_sum, max(score) AS score_max
    FROM s GROUP BY tenant_id""", "builds", "tenants"))
def score_fleet(spark: SparkSession, sf: str) -> DataFrame:
    return score_all(spark, sf).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("builds"),
        F.sum((F.col("verdict") == "BLOCKED").cast("long")).alias("blocked"),
        F.sum(F.size("imputed")).alias("guessed_features"),
        F.sum(F.col("score").cast("long")).alias("score_sum"),
        F.max("score").alias("score_max"))
