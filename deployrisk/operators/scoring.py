"""From build rows to scores, verdicts and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import scalars as S
from deployrisk.operators.impute import whole
from deployrisk.operators.ordered import with_position


def with_actor_history(heads: DataFrame) -> DataFrame:
    """``server_exp``: builds the same actor triggered in the tenant before this one."""
    return with_position(heads, ["tenant_id", "actor"], ["timestamp", "build_id"]).withColumnRenamed(
        "pos", "server_exp").drop("n")


def resolve_experience(df: DataFrame, median: Column) -> DataFrame:
    """History wins. Without it a hint counts only when it is not above the baseline.

    Reads ``server_exp`` and the client's ``hint``; ``median`` is the tenant's median
    experience or null. Adds ``deployer_exp``, ``exp_source`` and ``exp_imputed``.
    """
    baseline = whole("deployer_exp", F.coalesce(median, F.lit(K.TRAINING_MEDIANS["deployer_exp"])))
    seen, hint = F.col("server_exp") > 0, F.col("hint")
    believed = hint.isNotNull() & (hint <= baseline)
    source = (F.when(seen, "server_history").when(believed, "client_hint")
              .when(median.isNotNull(), "tenant_median").otherwise("training_median"))
    value = F.when(seen, F.col("server_exp")).when(believed, hint).otherwise(baseline).cast("int")
    return (df.withColumn("_value", value).withColumn("exp_source", source)
            .withColumn("exp_imputed", ~(seen | believed))
            .withColumn("deployer_exp", F.col("_value")).drop("_value"))


def fill_fixed(builds: DataFrame) -> DataFrame:
    """Every unknown feature takes its fixed median."""
    rest = [c for c in builds.columns if c not in K.FEATURES]
    return builds.select(*rest, *[
        F.coalesce(F.col(f), whole(f, F.lit(K.TRAINING_MEDIANS[f]))).alias(f) for f in K.FEATURES])


def with_settings(df: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenant thresholds, defaults where unset."""
    settings = tenants.select("tenant_id", "threshold_yellow", "threshold_red")
    return (df.join(settings, "tenant_id", "left")
            .withColumn("threshold_yellow", F.coalesce("threshold_yellow", F.lit(K.YELLOW)))
            .withColumn("threshold_red", F.coalesce("threshold_red", F.lit(K.RED))))


def score_rows(df: DataFrame, p: Column, yellow: Column | int = K.YELLOW, red: Column | int = K.RED) -> DataFrame:
    return (df.withColumn("p", p).withColumn("score", S.score(F.col("p")))
            .withColumn("verdict", S.verdict(F.col("score"), yellow, red))
            .withColumn("colour", S.colour(F.col("verdict"))))
