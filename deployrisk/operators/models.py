"""Forest training, balancing, calibration, scoring and importances with MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators import forests
from deployrisk.session import materialize, scratch_path

# forest settings (fixed values)
TREES = 100
TREES_REAL = 200
DEPTH = 8
LEAF_ROWS = 3
SEED = 42


def assemble(df: DataFrame) -> DataFrame:
    """Add the feature vector in contract order."""
    return VectorAssembler(inputCols=list(K.FEATURES), outputCol="features").transform(df)


def balanced_weights(df: DataFrame, keys: Sequence[str] = (), sample_weight: Column | None = None) -> DataFrame:
    """Class weight n / (2 n_class) times the row's own weight.

    Class sizes come from one small aggregate that is joined back, not from a window over
    the whole class.
    """
    sizes = df.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_nc"))
    totals = sizes.groupBy(*keys).agg(F.sum("_nc").alias("_n"))
    if keys:
        weights = sizes.join(totals, list(keys))
    else:
        weights = sizes.withColumn("_k", F.lit(0)).join(
            F.broadcast(totals.withColumn("_k", F.lit(0))), "_k").drop("_k")
    own = F.lit(1.0) if sample_weight is None else F.coalesce(sample_weight, F.lit(1.0))
    weights = weights.select(*keys, "label", (F.col("_n") / (2 * F.col("_nc"))).alias("class_weight"))
    if keys:    # written, so that Spark knows how few they are and the rows stay where they lie
        weights = materialize(weights, "class-weights")
    return df.join(weights, [*keys, "label"]).withColumn("weight", own * F.col("class_weight"))


def fit_forest(train: DataFrame, trees: int = TREES, keys: Sequence[str] = ()) -> RandomForestClassificationModel:
    """A balanced forest on rows with the ten features, ``label`` and maybe ``weight``."""
    rows = train if "weight" in train.columns else balanced_weights(train, keys)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", probabilityCol="probability",
        rawPredictionCol="raw", predictionCol="predicted", numTrees=trees, maxDepth=DEPTH,
        minInstancesPerNode=LEAF_ROWS, featureSubsetStrategy="sqrt", seed=SEED)
    typed = assemble(rows.withColumn("label", F.col("label").cast("double")))
    return forest.fit(typed.select("features", "label", "weight"))


def predict(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """Add ``p``, the chance that the build is risky."""
    scored = model.transform(assemble(df))
    rest = [c for c in df.columns]
    return scored.select(*rest, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def fit_calibration(scored: DataFrame, label: str = "label") -> IsotonicRegressionModel:
    """Isotonic map from raw to observed probability."""
    rows = scored.select(F.col(label).cast("double").alias("label"), F.col("p").alias("features"), F.lit(1.0).alias("weight"))
    return IsotonicRegression(isotonic=True).fit(rows)


def calibrate(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    """Replace ``p`` by its calibrated value; the raw one stays as ``p_raw``."""
    renamed = scored.withColumnRenamed("p", "p_raw").withColumn("features", F.col("p_raw"))
    return model.transform(renamed).withColumnRenamed("prediction", "p").drop("features")


def importance_array(model: object) -> list[float]:
    """Importances in contract order, also through a wrapper; zeros when absent."""
    if isinstance(model, PipelineModel):
        for stage in model.stages:
            if hasattr(stage, "featureImportances"):
                return [float(v) for v in stage.featureImportances.toArray()]
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    return [0.0] * len(K.FEATURES)


def importance_rows(importances: DataFrame, array: str = "importances") -> DataFrame:
    """One row per feature from a column of importance arrays."""
    rest = [c for c in importances.columns if c != array]
    names = F.array(*[F.lit(f) for f in K.FEATURES])
    return importances.select(*rest, F.posexplode(array).alias("place", "importance")).select(
        *rest, "place", F.get(names, F.col("place")).alias("feature"), "importance")


def trees_of(model: RandomForestClassificationModel, spark: SparkSession) -> DataFrame:
    """A forest fitted by MLlib as a table of trees."""
    path = scratch_path(spark, "forest")
    model.save(path)
    return forests.from_saved(spark.read.parquet(f"{path}/data"))


def predict_by_version(trees: DataFrame, builds: DataFrame) -> DataFrame:
    """Score each build with the forest named in ``version``; builds of unknown versions use ``base``.

    ``trees`` holds all forests with their ``version``; builds meet them by a join on it, in blocks.
    """
    known = trees.select(F.col("version").alias("_use")).distinct()
    named = builds.join(known, builds.version == known._use, "left").withColumn("_use", F.coalesce("_use", F.lit("base")))
    return forests.predict(trees.withColumnRenamed("version", "_use"), named, ["_use"], "build_id").select(*builds.columns, "p")


def scenarios(spark: SparkSession) -> DataFrame:
    """Four fixed builds with the band their score must land in (fixed values)."""
    rows = [
        ("friday_evening_large", "high", 847, 12, 17, 4, 0.4, 0.85, 0, 10, 3.0, 0.1),
        ("tuesday_morning_small", "low", 45, 3, 10, 1, 0.0, 1.0, 0, 50, 1.0, -0.05),
        ("hotfix_end_of_day", "medium", 200, 8, 17, 2, 0.1, 0.9, 1, 20, 1.0, 0.0),
        ("friday_night_large", "high", 900, 20, 21, 4, 0.3, 0.7, 0, 5, 7.0, 0.5),
    ]
    types = ", ".join(f"{f} int" if f in K.INT_FEATURES else f"{f} double" for f in K.FEATURES)
    return spark.createDataFrame(rows, f"name string, expect string, {types}")


def scenario_check(scored: DataFrame) -> DataFrame:
    """Whether each scenario's score lies in its band."""
    score = F.bround(F.col("p") * 100, 0).cast("int")
    ok = (F.when(F.col("expect") == "high", score >= 60).when(F.col("expect") == "low", score <= 40)
          .otherwise(score.between(20, 80)))
    return scored.select("name", "expect", score.alias("score"), ok.alias("ok"))
