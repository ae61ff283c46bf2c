"""Two-sample Kolmogorov-Smirnov drift per tenant and feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators.impute import unpivot_features
from deployrisk.operators.ordered import newest


def recent_and_previous(builds: DataFrame, run: int = K.DRIFT_RUN) -> DataFrame:
    """The newest ``run`` builds and the ``run`` before them, tenants with enough only.

    At most ``2 * run`` rows per tenant pass the shuffle.
    """
    last = newest(builds, ["tenant_id"], ["timestamp", "build_id"], 2 * run)
    sized = last.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("tenant_id")))
    return (sized.filter(F.col("_rows") >= 2 * run).drop("_rows")
            .withColumn("side", F.when(F.col("rank") <= run, "recent").otherwise("previous")))


def ks_statistic(builds: DataFrame, features: Sequence[str] = K.FEATURES, run: int = K.DRIFT_RUN) -> DataFrame:
    """Statistic and sample sizes per tenant and feature, nulls dropped.

    Both distribution functions are stepped by value, so equal values move together.
    """
    split = recent_and_previous(builds, run)
    long = unpivot_features(split, ["tenant_id", "side"], features).filter(F.col("value").isNotNull())
    steps = long.groupBy("tenant_id", "feature", "value").agg(
        F.sum((F.col("side") == "previous").cast("int")).alias("_p"),
        F.sum((F.col("side") == "recent").cast("int")).alias("_r"))
    # at most 2 * run steps per tenant and feature
    each = Window.partitionBy("tenant_id", "feature")
    upto = each.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    curves = steps.select(
        "tenant_id", "feature",
        F.sum("_p").over(upto).alias("_cp"), F.sum("_r").over(upto).alias("_cr"),
        F.sum("_p").over(each).alias("n_previous"), F.sum("_r").over(each).alias("n_recent"))
    gap = F.abs(F.col("_cp") * F.col("n_recent") - F.col("_cr") * F.col("n_previous"))
    return (curves.filter((F.col("n_previous") > 0) & (F.col("n_recent") > 0))
            .groupBy("tenant_id", "feature", "n_previous", "n_recent")
            .agg(F.max(gap).alias("_h"))
            .withColumn("statistic", F.col("_h") / (F.col("n_previous") * F.col("n_recent"))))


def exact_p(n: Column, m: Column, h: Column) -> Column:
    """Chance of a gap of at least ``h / (n m)`` when both samples come from one source.

    Walks the share of orderings whose gap has stayed below ``h``, one drawn value at a
    time; entry ``i`` holds the orderings with ``i`` values of the first sample so far.
    """
    places = F.sequence(F.lit(0), n.cast("int"))
    start = F.transform(places, lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def draw(share: Column, k: Column) -> Column:
        def at(i: Column) -> Column:
            j = k - i
            inside = (j >= 0) & (j <= m) & (F.abs(i * m - j * n) < h)
            first = F.when(i > 0, F.get(share, i - 1) * i / k).otherwise(0.0)
            second = F.when(j > 0, F.get(share, i) * j / k).otherwise(0.0)
            return F.when(inside, first + second).otherwise(0.0)
        return F.transform(places, at)

    stayed = F.aggregate(F.sequence(F.lit(1), (n + m).cast("int")), start, draw, lambda q: F.get(q, n.cast("int")))
    return F.when(h <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - stayed)))


def drifted(builds: DataFrame, run: int = K.DRIFT_RUN, limit: float = K.DRIFT_P_VALUE) -> DataFrame:
    """Statistic, exact p-value and flag per tenant and feature."""
    return (ks_statistic(builds, run=run)
            .withColumn("p_value", exact_p(F.col("n_previous"), F.col("n_recent"), F.col("_h")))
            .withColumn("drifted", F.col("p_value") < limit).drop("_h"))


def verdicts(builds: DataFrame, run: int = K.DRIFT_RUN, needed: int = K.DRIFT_MIN_FEATURES,
             heads: DataFrame | None = None) -> DataFrame:
    """drifted / stable / skipped per tenant; ``demo`` is left out.

    ``heads`` may give the full list of builds when ``builds`` only has the newest ones.
    """
    real = builds.filter(F.col("tenant_id") != "demo")
    flagged = drifted(real, run).groupBy("tenant_id").agg(
        F.sum(F.col("drifted").cast("long")).alias("drifted_features"))
    every = real if heads is None else heads.filter(F.col("tenant_id") != "demo")
    sizes = every.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("builds"))
    found = F.coalesce("drifted_features", F.lit(0).cast("long"))
    return sizes.join(flagged, "tenant_id", "left").select(
        "tenant_id", "builds", found.alias("drifted_features"),
        verdict(F.col("builds"), found, run, needed).alias("verdict"))


def verdict(builds: Column, found: Column, run: int = K.DRIFT_RUN, needed: int = K.DRIFT_MIN_FEATURES) -> Column:
    return F.when(builds < 2 * run, "skipped").when(found >= needed, "drifted").otherwise("stable")


def reports(builds: DataFrame, run: int = K.DRIFT_RUN, heads: DataFrame | None = None) -> DataFrame:
    """Rows for the drift report table: one per tenant with its drifted features as text."""
    named = drifted(builds.filter(F.col("tenant_id") != "demo"), run).filter("drifted")
    # ten features at most per tenant
    listed = named.groupBy("tenant_id").agg(F.array_sort(F.collect_list(
        F.struct("feature", "p_value", "statistic"))).alias("features"))
    return verdicts(builds, run, heads=heads).join(listed, "tenant_id", "left")
