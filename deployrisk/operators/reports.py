"""Fleet KPIs, counters and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators.impute import unpivot_features
from deployrisk.operators.ordered import exact_quantiles


def kpis(scored: DataFrame) -> DataFrame:
    """Per tenant: builds, labelled, blocked and progress toward an own model."""
    counted = scored.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("builds"),
        F.sum(F.col("label").isin(0, 1).cast("long")).alias("labelled"),
        F.sum((F.col("score") > K.RED).cast("long")).alias("blocked"))
    return counted.withColumn("progress_pct", F.least(
        F.lit(100), F.floor(F.col("labelled") / K.MIN_BUILDS * 100)).cast("int"))


def counters(builds: DataFrame) -> DataFrame:
    """Build, label and per-actor counts: one row per tenant and actor.

    A row per actor instead of one map per tenant, so a tenant with any number of
    actors never has to fit in one row.
    """
    by_actor = builds.groupBy("tenant_id", "actor").agg(
        F.count(F.lit(1)).alias("actor_builds"),
        F.sum(F.col("label").isin(0, 1).cast("long")).alias("_labelled"))
    totals = by_actor.groupBy("tenant_id").agg(
        F.sum("actor_builds").alias("build_count"), F.sum("_labelled").alias("labelled_count"))
    return by_actor.drop("_labelled").join(totals, "tenant_id")


def label_distribution(builds: DataFrame) -> DataFrame:
    """Rows and share per label within each tenant."""
    counted = builds.groupBy("tenant_id", "label").agg(F.count(F.lit(1)).alias("rows"))
    # three labels at most, so this window sees three rows per tenant
    return counted.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("tenant_id")))


def segment_risk(builds: DataFrame) -> DataFrame:
    """Rows and risky share of four segments, one pass."""
    segments = {
        "hotfix": F.col("is_hotfix") == 1,
        "high_failure": F.col("recent_failure_rate") > 0.20,
        "friday_afternoon": (F.col("day_of_week") == 4) & F.col("hour_of_day").between(16, 19),
        "tuesday_morning": (F.col("day_of_week") == 1) & F.col("hour_of_day").between(9, 12),
    }
    risky = (F.col("label") == 1).cast("double")
    one = builds.agg(*[a for name, c in segments.items() for a in (
        F.count(F.when(c, 1)).alias(f"{name}_rows"), F.avg(F.when(c, risky)).alias(f"{name}_risk"))])
    stacked = ", ".join(f"'{name}', {name}_rows, {name}_risk" for name in segments)
    return one.selectExpr(f"stack({len(segments)}, {stacked}) as (segment, rows, risky_share)")


def feature_stats(df: DataFrame, features: Sequence[str] = K.FEATURES) -> DataFrame:
    """count, mean, std, min, quartiles and max of every feature.

    Values are counted once; everything else follows from the counts of distinct values.
    """
    counts = unpivot_features(df, [], features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    total, value = F.sum(known), F.col("value")
    mean = F.sum(value * F.col("n")) / total
    square = F.sum(value * value * F.col("n"))
    spread = F.when(total > 1, F.sqrt(F.greatest(F.lit(0.0), (square - total * mean * mean) / (total - 1))))
    basic = counts.groupBy("feature").agg(
        F.coalesce(total, F.lit(0).cast("long")).alias("count"), mean.alias("mean"), spread.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(counts, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, weight="n")
    return basic.join(quartiles, "feature", "left")


def score_bands(predicted: DataFrame) -> DataFrame:
    """Builds per band of the truncated score."""
    score = F.floor(F.col("p") * 100).cast("int")
    band = (F.when(score <= 20, "0-20").when(score <= 40, "21-40").when(score <= 60, "41-60")
            .when(score <= 80, "61-80").otherwise("81-100"))
    return predicted.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("builds"))


def request_counter(log: DataFrame) -> DataFrame:
    return log.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(log: DataFrame, bounds: Sequence[float] = K.LATENCY_BOUNDS) -> DataFrame:
    """Cumulative ``le`` buckets with count and sum per endpoint.

    One conditional count per bound in a single pass; the rows are never multiplied.
    """
    wide = log.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("count"), F.sum("seconds").alias("sum"),
        *[F.count(F.when(F.col("seconds") <= b, 1)).alias(f"le_{i}") for i, b in enumerate(bounds)])
    stacked = ", ".join([f"'{b}', le_{i}" for i, b in enumerate(bounds)] + ["'+Inf', count"])
    return wide.selectExpr("endpoint", "count", "sum",
                           f"stack({len(bounds) + 1}, {stacked}) as (le, bucket)")


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Tenants per outcome and reason (retrain and drift runs)."""
    return outcomes.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("tenants"))
