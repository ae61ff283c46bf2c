"""Joins between requests, tenants, labels, models and deploys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions.text import strip


def authenticate(requests: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the hash of the trimmed key; ``demo`` needs no key."""
    keyed = requests.withColumn("_hash", F.sha2(strip("api_key"), 256)).withColumn(
        "_given", (F.length(F.coalesce("tenant_id", F.lit(""))) > 0) & (F.length(F.coalesce("api_key", F.lit(""))) > 0))
    known = tenants.select("tenant_id", F.col("api_key_hash").alias("_stored"))
    checked = keyed.join(known, "tenant_id", "left").withColumn(
        "_ok", (F.col("tenant_id") == "demo") | (F.col("_given") & F.coalesce(F.col("_stored") == F.col("_hash"), F.lit(False))))
    ok = F.coalesce("_ok", F.lit(False))
    hidden = ["_hash", "_given", "_stored", "_ok"]
    return checked.filter(ok).drop(*hidden), checked.filter(~ok).drop(*hidden)


def label_builds(builds: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(builds with their label event, events whose build is unknown)."""
    known = builds.select("build_id")
    return builds.join(labels, "build_id"), labels.join(known, "build_id", "left_anti")


def model_for_tenant(builds: DataFrame, live: DataFrame, base_version: str = K.DEFAULT_PHASE) -> DataFrame:
    """The tenant's live model version, else the base one; ``base`` and ``demo`` always base."""
    own = live.filter(~F.col("tenant_id").isin("base", "demo")).select("tenant_id", "version")
    return (builds.join(own, "tenant_id", "left")
            .withColumn("model_phase", F.when(F.col("version").isNotNull(), "tenant").otherwise("base"))
            .withColumn("version", F.coalesce("version", F.lit(base_version))))


def followed_up(deploys: DataFrame, fixes: DataFrame, hours: int) -> DataFrame:
    """Deploys followed in the same tenant by a fix within ``hours``.

    Time is cut into steps of that length. A fix later in the deploy's own step is always
    close enough, so its newest time decides; in the next step the oldest time decides.
    Both come from one small aggregate per (tenant, step): no range join, no row pairs.
    """
    span = hours * 3600
    step = F.floor(F.col("timestamp") / F.lit(span))
    steps = fixes.groupBy("tenant_id", step.alias("_step")).agg(
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    own = steps.select("tenant_id", "_step", "_last")
    following = steps.select("tenant_id", (F.col("_step") - 1).alias("_step"), "_first")
    near = own.join(following, ["tenant_id", "_step"], "full")
    hit = F.coalesce(F.col("_last") > F.col("timestamp"), F.lit(False)) | F.coalesce(
        F.col("_first") <= F.col("timestamp") + span, F.lit(False))
    return (deploys.withColumn("_step", step).join(near, ["tenant_id", "_step"])
            .filter(hit).drop("_step", "_first", "_last"))


def against_incumbent(candidate: DataFrame, incumbent: DataFrame, keys: list[str]) -> DataFrame:
    """Both models' probabilities on the same held-out rows."""
    return candidate.join(incumbent.select(*keys, F.col("p").alias("p_old")), keys, "left")


def promoted(registry: DataFrame) -> DataFrame:
    """Newest promoted version per tenant."""
    return registry.filter("promoted").groupBy("tenant_id").agg(
        F.max_by(F.struct("version", "precision", "trained_at"), F.struct("trained_at", "version")).alias("_m")
    ).select("tenant_id", "_m.*")


def tenant_meta(tenants: DataFrame, registry: DataFrame) -> DataFrame:
    """Phase, precision and last retrain, derived from the model registry."""
    live = promoted(registry).select("tenant_id", F.col("precision").alias("_p"), F.col("trained_at").alias("_t"))
    return tenants.select("tenant_id").join(live, "tenant_id", "left").select(
        "tenant_id",
        F.when(F.col("_t").isNotNull(), "tenant").otherwise(K.DEFAULT_PHASE).alias("model_phase"),
        F.coalesce("_p", F.lit(K.DEFAULT_PRECISION)).alias("model_precision"),
        F.col("_t").alias("last_retrain"))


