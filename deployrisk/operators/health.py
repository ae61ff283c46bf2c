"""Judging a deploy from health probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.operators.ordered import exact_quantiles

# watch defaults (fixed values)
ERROR_RATE_LIMIT = 0.20
LATENCY_MULT = 2.0
BASELINE_ROUNDS = 5
WINDOW_SECONDS = 120


def probe_ok(status: Column) -> Column:
    """2xx and 3xx pass; no status is an error."""
    return F.coalesce((status >= 200) & (status < 400), F.lit(False))


def with_ok(probes: DataFrame) -> DataFrame:
    return probes.withColumn("ok", probe_ok(F.col("status")))


def percentiles(samples: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per key, 0.0 for a key without values."""
    found = exact_quantiles(samples, keys, value, wanted)
    every = samples.select(*keys).distinct()
    return every.join(found, keys, "left").select(
        *keys, *[F.coalesce(name, F.lit(0.0)).alias(name) for name in wanted])


def baseline(samples: DataFrame) -> DataFrame:
    """Median latency of the successful baseline probes per deploy; no row without any."""
    return exact_quantiles(samples.filter("ok"), ["deploy_id"], "latency_ms", {"baseline_p50": 0.5})


def evaluate(deploys: DataFrame, samples: DataFrame, baselines: DataFrame,
             error_limit: float = ERROR_RATE_LIMIT, latency_mult: float = LATENCY_MULT) -> DataFrame:
    """One report per deploy, also for deploys nobody could probe.

    Degraded without samples, with an error rate strictly above the limit, or a median
    latency strictly above ``latency_mult`` times a known, non-zero baseline.
    """
    counted = samples.groupBy("deploy_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum((~F.col("ok")).cast("long")).alias("errors"))
    latency = exact_quantiles(samples.filter("ok"), ["deploy_id"], "latency_ms", {"p50": 0.5, "p95": 0.95})
    joined = (deploys.select("deploy_id").join(counted, "deploy_id", "left")
              .join(latency, "deploy_id", "left").join(baselines, "deploy_id", "left"))
    return judge(joined, error_limit, latency_mult)


def judge(df: DataFrame, error_limit: float = ERROR_RATE_LIMIT, latency_mult: float = LATENCY_MULT) -> DataFrame:
    """Verdict and reasons from ``total, errors, p50, p95, baseline_p50``."""
    df = (df.withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
          .withColumn("errors", F.coalesce("errors", F.lit(0).cast("long")))
          .withColumn("error_rate", F.when(F.col("total") > 0, F.col("errors") / F.col("total")).otherwise(1.0)))
    total, base = F.col("total"), F.col("baseline_p50")
    too_many = (total > 0) & (F.col("error_rate") > error_limit)
    too_slow = (base > 0) & F.col("p50").isNotNull() & (F.col("p50") > base * latency_mult)
    percent = F.bround(F.col("error_rate") * 100, 0).cast("int").cast("string")
    reasons = F.array_compact(F.array(
        F.when(total == 0, "no samples collected — service unreachable"),
        F.when(too_many, F.concat(F.lit("error rate "), percent,
                                  F.lit(f"% exceeds {error_limit:.0%} threshold ("), F.col("errors").cast("string"),
                                  F.lit("/"), total.cast("string"), F.lit(" probes failed)"))),
        F.when(F.coalesce(too_slow, F.lit(False)), F.concat(
            F.lit("latency p50 "), F.bround("p50", 0).cast("long").cast("string"),
            F.lit(f"ms is over {latency_mult:g}x the baseline ("),
            F.bround("baseline_p50", 0).cast("long").cast("string"), F.lit("ms)")))))
    return (df.withColumn("_found", reasons)
            .withColumn("verdict", F.when(F.size("_found") > 0, "DEGRADED").otherwise("HEALTHY"))
            .withColumn("reasons", F.when(F.size("_found") > 0, F.col("_found")).otherwise(
                F.array(F.lit("error rate and latency stayed within thresholds"))))
            .withColumn("latency_p50", F.coalesce("p50", F.lit(0.0)))
            .withColumn("latency_p95", F.coalesce("p95", F.lit(0.0)))
            .drop("_found", "p50", "p95"))


def actions(reports: DataFrame, webhook: Column, rollback: Column) -> DataFrame:
    """What to do about a degraded deploy; decided here, carried out elsewhere."""
    bad = F.col("verdict") == "DEGRADED"
    present = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    return reports.withColumn("actions", F.array_compact(F.array(
        F.when(bad & present(webhook), "slack"), F.when(bad & present(rollback), "rollback"))))


def to_label_events(reports: DataFrame) -> DataFrame:
    """Verdicts as observed outcomes; reports without a build id are left out."""
    healthy = F.col("verdict") == "HEALTHY"
    return reports.filter(F.length(F.coalesce("build_id", F.lit(""))) > 0).select(
        "build_id", F.when(healthy, 0).otherwise(1).alias("label"),
        F.when(healthy, "sentinel_healthy").otherwise("sentinel_degraded").alias("label_source"))
