"""Nightly training of every eligible tenant: prepare once, fit all forests together, gate, promote.

Models are rows: a forest is its trees in a table, and scoring meets them by a join. No step runs once per tenant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk import sinks
from deployrisk.operators import balance, forests, metrics, models, selection, validation
from deployrisk.operators.impute import column_medians, fill_with
from deployrisk.session import materialize


def prepare(builds: DataFrame, as_of: Column, window_days: int = K.TRAIN_WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """(rows of eligible tenants, eligibility report).

    Rows are labelled, recent, filled from their tenant's medians and marked ``held_out``; they keep their
    ``sample_weight``, 1 where they have none.
    """
    own = F.coalesce(F.col("sample_weight").cast("double"), F.lit(1.0)) if "sample_weight" in builds.columns else F.lit(1.0)
    # written, as counts, split and medians all read them
    marked = materialize(validation.labelled(builds).select(
        "tenant_id", "build_id", "timestamp", "label", own.alias("sample_weight"), *K.FEATURES, validation.is_recent(builds, as_of, window_days).alias("_recent")), "labelled-builds")
    recent = marked.filter("_recent").drop("_recent")
    counts = marked.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("labelled"))
    usable = recent.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("usable"))
    report = validation.eligibility(counts, usable)
    report = materialize(report, "eligibility")
    chosen = recent.join(report.filter("eligible").select("tenant_id"), "tenant_id", "left_semi")
    return fill_with(selection.tail_split(chosen), column_medians(chosen, ["tenant_id"]), ["tenant_id"]), report


def fit_keys(train: DataFrame, keys: Sequence[str], trees: int = models.TREES, id_column: str = "build_id") -> DataFrame:
    """A forest for each key: trees of rows whose classes weigh the same, times their own weight if they have one."""
    own = ["sample_weight"] if "sample_weight" in train.columns else []
    rows = materialize(train.select(*keys, id_column, "label", *own, *K.FEATURES), "forest-rows")
    rows = models.balanced_weights(rows, keys, F.col("sample_weight") if own else None)
    growth = forests.Growth(models.DEPTH, models.LEAF_ROWS, models.SEED)
    return forests.fit(rows.select(*keys, id_column, "label", "weight", *K.FEATURES), keys, id_column, trees, growth)


def fit_all(train: DataFrame, trees: int = models.TREES, id_column: str = "build_id") -> DataFrame:
    """One forest over all rows, as the trees of the key ``forest``."""
    return materialize(fit_keys(train.withColumn("forest", F.lit("all")), ["forest"], trees, id_column), "forest-of-all")


def predict_all(grown: DataFrame, rows: DataFrame, id_column: str = "build_id") -> DataFrame:
    """All rows with ``p`` from the forest over all rows."""
    return forests.predict(grown, rows.withColumn("forest", F.lit("all")), ["forest"], id_column).drop("forest")


def retrain_all(builds: DataFrame, as_of: Column, version: str, window_days: int = K.TRAIN_WINDOW_DAYS,
                trees: int = models.TREES, incumbents: DataFrame | None = None) -> dict[str, str]:
    """Train, gate and register every eligible tenant.

    ``incumbents`` holds the trees (tenant_id and arrays) of the models that new ones are held against, as
    :func:`live_trees` reads them.

    Everything runs for all tenants at once: preparation, balancing, the growth of all forests, and both models'
    probabilities on the held-out rows. Returns the paths of the tables written.
    """
    spark = builds.sparkSession
    paths = {name: sinks.new_table(spark, name) for name in ("report", "rows", "models", "predictions")} | {"version": version}
    prepared, report = prepare(builds, as_of, window_days)
    report.write.parquet(paths["report"])
    prepared.hint("rebalance").write.partitionBy("held_out").parquet(paths["rows"])
    rows = spark.read.schema(prepared.schema).parquet(paths["rows"])
    balanced = balance.balance(rows.filter("NOT held_out"), ["tenant_id"], "build_id")
    grown = fit_keys(balanced, ["tenant_id"], trees)
    grown.withColumn("version", F.lit(version)).write.parquet(paths["models"])
    fresh = spark.read.parquet(paths["models"])
    held = rows.filter("held_out").select("tenant_id", "build_id", F.col("label").alias("y"), *K.FEATURES)
    scored = materialize(forests.predict(fresh, held, ["tenant_id"], "build_id"), "held-out-scores")
    if incumbents is None:
        both = scored.withColumn("p_old", F.lit(None).cast("double"))
    else:
        old = forests.predict(incumbents, held, ["tenant_id"], "build_id", as_="p_old").select("tenant_id", "build_id", "p_old")
        both = scored.join(old, ["tenant_id", "build_id"], "left")
    both.select("tenant_id", "build_id", "p", "p_old", "y").write.parquet(paths["predictions"])
    return paths


def gate_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Held-out quality, checks and the promotion decision per trained tenant."""
    summary = metrics.held_out_summary(spark.read.parquet(paths["predictions"]), ["tenant_id"], old=True)
    sizes = spark.read.parquet(paths["report"]).select("tenant_id", F.col("usable").alias("dataset_size"))
    return metrics.gate(summary.join(sizes, "tenant_id"))


def live_models(registry: DataFrame) -> DataFrame:
    """(tenant_id, path, version) of each tenant's newest promoted model."""
    newest = F.max_by(F.struct("path", "version"), F.struct("trained_at", "version"))
    return registry.filter("promoted").groupBy("tenant_id").agg(newest.alias("_m")).select("tenant_id", "_m.*")


def live_trees(registry: DataFrame, trees: DataFrame) -> DataFrame:
    """The trees of each tenant's live model; ``trees`` holds those of all versions."""
    return trees.join(live_models(registry).select("tenant_id", "version"), ["tenant_id", "version"], "left_semi")


def registry_rows(gated: DataFrame, paths: dict[str, str], trained_at: Column) -> DataFrame:
    """Rows for the append-only model registry; the live model is the newest promoted one."""
    return gated.select(
        "tenant_id", F.lit(paths["models"]).alias("path"), F.lit(paths["version"]).alias("version"), trained_at.alias("trained_at"), F.lit("tenant").alias("phase"),
        "precision", "recall", "auc_roc", "dataset_size", F.array(*[F.lit(f) for f in K.FEATURES]).alias("feature_columns"),
        F.col("passed").alias("promoted"))


def outcomes(spark: SparkSession, paths: dict[str, str], gated: DataFrame) -> DataFrame:
    """retrained / skipped / failed with a reason, one row per tenant; ``demo`` left out."""
    report = spark.read.parquet(paths["report"]).filter("tenant_id <> 'demo'")
    joined = report.join(gated.select("tenant_id", "passed"), "tenant_id", "left")
    return joined.select(
        "tenant_id",
        F.when(~F.col("eligible"), "skipped").when(F.col("passed"), "retrained").otherwise("failed").alias("outcome"),
        F.when(~F.col("eligible"), F.col("reason")).when(F.col("passed").isNull(), "no model")
        .when(~F.col("passed"), "validation failed").otherwise("").alias("reason"))


def compare(parts: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Headline metrics of several models on the same test rows, one row per model."""
    named = [df.withColumn("model", F.lit(name)) for name, df in parts.items()]
    rows = named[0]
    for part in named[1:]:
        rows = rows.unionByName(part)
    return metrics.evaluate(rows, ["model", *keys])
