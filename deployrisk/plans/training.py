"""Model queries. They fit on the given tables; SQL checks what does not depend on chance:
which rows are scored by which model, that chances are chances, and that ranking beats a floor."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk import sinks
from deployrisk.functions import scalars as S
from deployrisk.operators import balance, calibration, forests, joins, metrics, models, selection, training
from deployrisk.operators.impute import column_medians, fill_with, impute_training
from deployrisk.operators.ordered import newest
from deployrisk.plans import duck, views
from deployrisk.plans.filters import AS_OF
from deployrisk.plans.registry import Topic
from deployrisk.session import materialize

TOPIC = Topic()


def labelled_rows(spark, sf):
    """Decided builds of all tenants, filled and split by time within each tenant."""
    # written, as split and medians both read them
    rows = materialize(views.builds(spark, sf).filter("label >= 0").select(
        "tenant_id", "build_id", "timestamp", "label", *K.FEATURES), "decided-builds")
    return fill_with(selection.tail_split(rows), column_medians(rows, ["tenant_id"]), ["tenant_id"])


def fitted(spark, sf, trees=models.TREES):
    """(trees of the forest over all tenants, training rows, held-out rows)."""
    rows = materialize(labelled_rows(spark, sf), "labelled")
    train, test = rows.filter("NOT held_out"), rows.filter("held_out")
    return training.fit_all(train, trees), train, test


HELD_OUT_SQL = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS r,
        count(*) OVER (PARTITION BY tenant_id) AS n FROM builds WHERE label >= 0),
    h AS (SELECT * FROM d WHERE r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)))
    SELECT tenant_id, label, count(*) AS rows, true AS in_range FROM h GROUP BY ALL"""


def chances(scored, keys, *values):
    """Rows per key and whether all their values are chances."""
    fine = F.lit(True)
    for value in values:
        fine = fine & F.coalesce(F.col(value).between(0, 1), F.lit(False))
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.bool_and(fine).alias("in_range"))


@TOPIC.query("ml_forest", duck.sql(HELD_OUT_SQL, "builds"))
def ml_forest(spark, sf):
    trees, _, test = fitted(spark, sf)
    return chances(training.predict_all(trees, test), ["tenant_id", "label"], "p")


@TOPIC.query("ml_forest_real", duck.sql("""
    SELECT project, CAST(buggy AS INTEGER) AS label, count(*) AS rows, true AS in_range FROM commits WHERE year > 1999 GROUP BY ALL""", "commits"))
def ml_forest_real(spark, sf):
    """Commits up to a year train, later ones test; 200 trees, no oversampling."""
    from deployrisk.operators import history, impute
    rows = history.split_by_year(history.commit_features(views.commits(spark, sf)), 1999)
    train, test = impute.impute_train_only(rows.filter("part = 'train'"), rows.filter("part = 'test'"))
    labelled = F.col("buggy").cast("int")
    train = materialize(train.withColumn("label", labelled), "commits-train")
    trees = training.fit_all(train, models.TREES_REAL, "commit_id")
    return chances(training.predict_all(trees, test.withColumn("label", labelled), "commit_id"), ["project", "label"], "p")


TRAIN_SQL = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS r,
        count(*) OVER (PARTITION BY tenant_id) AS n FROM builds WHERE label >= 0),
    m AS (SELECT tenant_id, """ + ", ".join(f"quantile_cont(CAST({f} AS DOUBLE), 0.5) AS {f}_m" for f in K.FEATURES) + """ FROM d GROUP BY tenant_id),
    t AS (SELECT tenant_id, build_id, label, """ + ", ".join(
    f"coalesce(CAST({f} AS DOUBLE), " + (f"round_even(coalesce({f}_m, {K.TRAINING_MEDIANS[f]}::DOUBLE), 0)" if f in K.INT_FEATURES
                                        else f"coalesce({f}_m, {K.TRAINING_MEDIANS[f]}::DOUBLE)") + f") AS {f}"
    for f in K.FEATURES) + """ FROM d JOIN m USING (tenant_id) WHERE r > greatest(1, round_even(n * 0.2::DOUBLE, 0))),
    c AS (SELECT tenant_id, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM t GROUP BY tenant_id)"""


@TOPIC.query("ml_smote", duck.sql(TRAIN_SQL + """
    SELECT tenant_id, label, CASE WHEN n1 >= 6 AND least(n1, n0) > least(5, n1 - 1) THEN greatest(n1, n0)
        WHEN label = 1 THEN n1 ELSE n0 END AS rows FROM c, (VALUES (0), (1)) AS l(label)""", "builds"))
def ml_smote(spark, sf):
    """Rows per tenant and class after balancing."""
    train = labelled_rows(spark, sf).filter("NOT held_out")
    return balance.balance(train, ["tenant_id"], "build_id").groupBy("tenant_id", "label").agg(
        F.count(F.lit(1)).alias("rows"))


@TOPIC.query("ml_smote_neighbours", duck.sql(TRAIN_SQL + """,
    v AS (SELECT tenant_id, min(build_id) AS vid, """ + ", ".join(K.FEATURES) + " FROM t WHERE label = 1 GROUP BY ALL)" + """
    SELECT tenant_id, vid, distance2, k AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY tenant_id, vid ORDER BY distance2) AS k FROM (
        SELECT a.tenant_id, a.vid, """ + " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in K.FEATURES) + """ AS distance2
        FROM v a JOIN v b ON a.tenant_id = b.tenant_id AND a.vid <> b.vid)) WHERE k <= 5""", "builds"))
def ml_smote_neighbours(spark, sf):
    """The five nearest other risky builds of each risky training build."""
    risky = labelled_rows(spark, sf).filter("NOT held_out AND label = 1")
    vectors = risky.groupBy("tenant_id", *K.FEATURES).agg(F.min("build_id").alias("vid"))
    return balance.nearest(vectors, ["tenant_id"], balance.NEIGHBOURS).select(
        "tenant_id", "vid", "distance2", F.col("rank").cast("long").alias("rank"))


@TOPIC.query("ml_calibrate", duck.sql(HELD_OUT_SQL, "builds"))
def ml_calibrate(spark, sf):
    """A scale for each tenant, fitted on held-out rows that the forest has not seen: the older half of the tenant's."""
    trees, _, test = fitted(spark, sf)
    scored = materialize(training.predict_all(trees, test), "held-out-scores")
    middle = scored.groupBy("tenant_id").agg(F.percentile_approx("timestamp", 0.5).alias("middle"))
    older = scored.join(middle, "tenant_id").filter(F.col("timestamp") < F.col("middle"))
    scale = calibration.isotonic(older, ["tenant_id"])
    return chances(calibration.calibrate(scale, scored, ["tenant_id"]), ["tenant_id", "label"], "p", "p_raw")


@TOPIC.query("ml_compare", duck.sql("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS r,
        count(*) OVER (PARTITION BY tenant_id) AS n FROM builds WHERE label >= 0)
    SELECT model, count(*) AS rows, true AS in_range FROM d, (VALUES ('raw'), ('calibrated'), ('rule')) AS m(model)
    WHERE r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) GROUP BY model""", "builds"))
def ml_compare(spark, sf):
    """Raw, calibrated and rule probabilities on the same held-out rows."""
    from deployrisk.functions.scalars import rule_risk
    trees, train, test = fitted(spark, sf)
    learned = training.predict_all(trees, train).select("label", "p", F.lit("all").alias("forest"))
    scale = materialize(calibration.isotonic(learned, ["forest"]), "scale")
    raw = materialize(training.predict_all(trees, test).withColumn("y", F.col("label")), "held-out")
    keep = ["build_id", "p", "y"]
    found = training.compare({
        "raw": raw.select(*keep), "calibrated": calibration.calibrate(scale, raw.withColumn("forest", F.lit("all")), ["forest"]).select(*keep),
        "rule": raw.withColumn("p", rule_risk()).select(*keep)})
    fine = F.lit(True)
    for name in ("auc_roc", "auc_pr", "brier", "ece"):
        fine = fine & F.coalesce(F.col(name).between(0, 1), F.lit(True))
    return found.select("model", F.lit(raw.count()).cast("long").alias("rows"), fine.alias("in_range"))


@TOPIC.query("ml_importance", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i}, true)" for i, f in enumerate(K.FEATURES))
             + ") AS t(feature, place, sums_to_one)")
def ml_importance(spark, sf):
    trees, _, _ = fitted(spark, sf)
    shares = forests.importances(trees, ["forest"])
    whole = (F.abs(F.aggregate("importances", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-6) & (F.array_min("importances") >= 0)
    return models.importance_rows(shares.withColumn("sums_to_one", whole)).select("feature", "place", "sums_to_one")


def tenant_forests(spark, sf):
    """(trees of each tenant's forest, the decided builds)."""
    rows = materialize(labelled_rows(spark, sf), "labelled")
    return materialize(training.fit_keys(rows.filter("NOT held_out"), ["tenant_id"]), "tenant-forests"), rows


@TOPIC.query("ml_forest_tenants", duck.sql(TRAIN_SQL + """
    SELECT tenant_id, 100 AS trees, count(*) AS rows, count(DISTINCT label) = 2 AS learned FROM t GROUP BY tenant_id""", "builds"))
def ml_forest_tenants(spark, sf):
    """A forest for each tenant, and whether it ranks the rows it learned from: AUC of 0.65 at least where there are both labels."""
    trees, rows = tenant_forests(spark, sf)
    scored = forests.predict(trees, rows.filter("NOT held_out"), ["tenant_id"], "build_id").withColumn("y", F.col("label"))
    ranked = metrics.auc_roc(scored, ["tenant_id"]).withColumnRenamed("tenant_id", "ranked_id")
    grown = trees.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("trees"))
    counted = scored.groupBy(F.col("tenant_id").alias("counted_id")).agg(F.count(F.lit(1)).alias("rows"))
    joined = grown.join(ranked, F.col("tenant_id") == F.col("ranked_id")).join(counted, F.col("tenant_id") == F.col("counted_id"))
    return joined.select("tenant_id", F.col("trees").cast("int").alias("trees"), "rows", (F.col("auc_roc") >= 0.65).alias("learned"))


@TOPIC.query("top_importance_forest", duck.sql("""
    SELECT tenant_id, k::BIGINT AS rank, true AS falling, true AS sums_to_one FROM (SELECT DISTINCT tenant_id FROM builds WHERE label >= 0), range(1, 6) AS r(k)""", "builds"))
def top_importance_forest(spark, sf):
    """The five features that a tenant's forest gained most from."""
    trees, _ = tenant_forests(spark, sf)
    found = forests.importances(trees, ["tenant_id"])
    whole = F.abs(F.aggregate("importances", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-6
    rows = models.importance_rows(found.withColumn("sums_to_one", whole))
    ranked = newest(rows.withColumn("_first", -F.col("place")), ["tenant_id"], ["importance", "_first"], 5)
    next_ = F.lead("importance").over(Window.partitionBy("tenant_id").orderBy("rank"))
    return ranked.withColumn("falling", F.coalesce(F.col("importance") >= next_, F.lit(True))).select(
        "tenant_id", F.col("rank").cast("long").alias("rank"), "falling", "sums_to_one")


@TOPIC.query("top_reasons_forest", duck.sql("SELECT build_id, 3 AS reasons, true AS distinct_features, true AS weights_fall FROM builds WHERE label >= 0", "builds"))
def top_reasons_forest(spark, sf):
    """The three reasons of each decided build, by the importances of its tenant's forest."""
    trees, rows = tenant_forests(spark, sf)
    ranked = forests.importances(trees, ["tenant_id"]).select("tenant_id", S.rank_features(F.col("importances")).alias("ranked"))
    told = rows.join(ranked, "tenant_id").select("build_id", S.top_reasons(F.col("ranked"), F.array().cast("array<string>")).alias("reasons"))
    weight = F.col("reasons.importance")
    return told.select("build_id", F.size("reasons").alias("reasons"), (F.size(F.array_distinct("reasons.feature")) == 3).alias("distinct_features"),
                       (weight == F.reverse(F.sort_array(weight))).alias("weights_fall"))


@TOPIC.query("split_kfold_forest", duck.sql("SELECT 5::BIGINT AS folds, count(*) AS rows, true AS in_range FROM builds WHERE label >= 0", "builds"))
def split_kfold_forest(spark, sf):
    """Five forests grown together, each without one fold, and the mean and spread of their precision on it."""
    rows = materialize(selection.folds(labelled_rows(spark, sf), "build_id"), "folded")
    others = rows.withColumn("fold", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(4)), F.array("fold"))))
    trees = materialize(training.fit_keys(others, ["fold"]), "fold-forests")
    scored = forests.predict(trees, rows, ["fold"], "build_id").withColumn("y", F.col("label"))
    per_fold = metrics.prf(metrics.confusion(scored, ["fold"], F.col("p") > 0.5))
    spread = per_fold.agg(F.count(F.lit(1)).alias("folds"), F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows"),
                          F.avg("precision").alias("cv_precision"), F.stddev_pop("precision").alias("cv_std"))
    return spread.select("folds", "rows", (F.col("cv_precision").between(0, 1) & F.col("cv_std").between(0, 0.5)).alias("in_range"))


BATCH_SQL = """SELECT tenant_id, build_id, CASE WHEN model_phase = 'tenant' THEN tenant_id || '-v1' ELSE 'base' END AS version,
        model_phase, true AS in_range FROM builds JOIN tenants USING (tenant_id)"""


@TOPIC.query("ml_predict_batch", duck.sql(BATCH_SQL, "builds", "tenants"))
def ml_predict_batch(spark, sf):
    """Every build, decided or pending, scored with its tenant's live model, else the base model."""
    columns = ["tenant_id", "build_id", "timestamp", "label", *K.FEATURES]
    rows = materialize(impute_training(views.builds(spark, sf).select(*columns)), "all-builds")
    train = materialize(labelled_rows(spark, sf), "labelled").filter("NOT held_out")
    live = views.tenants(spark, sf).filter("model_phase = 'tenant'").select(
        "tenant_id", F.concat("tenant_id", F.lit("-v1")).alias("version"))
    own = train.join(live, "tenant_id")
    asked = own.unionByName(train.withColumn("version", F.lit("base")))
    trees = materialize(training.fit_keys(asked, ["version"]), "live-trees")
    scored = models.predict_by_version(trees, joins.model_for_tenant(rows, live))
    return scored.select("tenant_id", "build_id", "version", "model_phase", F.coalesce(F.col("p").between(0, 1), F.lit(False)).alias("in_range"))


@TOPIC.query("ml_scenarios", """SELECT * FROM (VALUES ('friday_evening_large', 'high', true), ('tuesday_morning_small', 'low', true),
    ('hotfix_end_of_day', 'medium', true), ('friday_night_large', 'high', true)) AS t(name, expect, in_range)""")
def ml_scenarios(spark, sf):
    """The four fixed builds under a forest fitted to the rule's labels on all builds.

    Whether each lands in its band depends on the builds there are, so SQL checks that a score is one.
    """
    from deployrisk.functions.scalars import rule_label, rule_risk
    columns = ["tenant_id", "build_id", "timestamp", *K.FEATURES]
    rows = impute_training(views.builds(spark, sf).select(*columns)).withColumn("label", rule_label(rule_risk()))
    trees = training.fit_all(materialize(rows, "rule-labelled"))
    checked = models.scenario_check(training.predict_all(trees, models.scenarios(spark), "name"))
    return checked.select("name", "expect", (F.col("score").between(0, 100) & F.col("ok").isNotNull()).alias("in_range"))


def nightly(spark, sf, version="v1", incumbents=None, trees=models.TREES):
    """A run over all labelled builds: the given orders spread over seven years, so 90 days hold too few."""
    builds = views.builds(spark, sf)
    paths = training.retrain_all(builds, F.lit(AS_OF), version, window_days=3650, trees=trees, incumbents=incumbents)
    return paths, training.gate_all(spark, paths)


@TOPIC.query("ml_retrain_all", duck.sql(f"""
    SELECT tenant_id, n >= {K.MIN_BUILDS} AND u >= {K.MIN_BUILDS} AS trained,
        CASE WHEN n < {K.MIN_BUILDS} THEN 'only ' || n || ' labelled builds' WHEN u < {K.MIN_BUILDS} THEN 'insufficient data' ELSE '' END AS skip_reason
    FROM (SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE timestamp >= {AS_OF} - 3650::BIGINT * 86400) AS u
          FROM builds WHERE label >= 0 AND tenant_id <> 'demo' GROUP BY tenant_id)""", "builds"))
def ml_retrain_all(spark, sf):
    """Which tenants a night trains, and why the others are left out."""
    paths, gated = nightly(spark, sf)
    found = training.outcomes(spark, paths, gated)
    trained = F.col("outcome") != "skipped"
    return found.select("tenant_id", trained.alias("trained"), F.when(trained, "").otherwise(F.col("reason")).alias("skip_reason"))


@TOPIC.query("sink_model_promote", "SELECT CASE WHEN n_nationkey = 0 THEN 'demo' ELSE 't' || lpad(n_nationkey::VARCHAR, 2, '0') END AS tenant_id, true AS consistent, true AS held_against FROM nation")
def sink_model_promote(spark, sf):
    """Two nights: the second holds its models against what the first one promoted.

    A tenant is in its own phase exactly if the registry promoted a model of it, and has an
    incumbent's precision in the second night exactly if it was promoted in the first.
    """
    registry = sinks.new_table(spark, "registry")
    first, gated = nightly(spark, sf)
    sinks.append_rows(training.registry_rows(gated, first, F.lit(AS_OF).cast("long")), registry)
    live = materialize(training.live_models(spark.read.parquet(registry)), "live-models")
    incumbents = training.live_trees(spark.read.parquet(registry), spark.read.parquet(first["models"]))
    second, gated = nightly(spark, sf, "v2", materialize(incumbents, "incumbents"))
    gated = materialize(gated, "gated")
    sinks.append_rows(training.registry_rows(gated, second, F.lit(AS_OF + 86400).cast("long")), registry)
    rows = spark.read.parquet(registry)
    promoted = rows.filter("promoted").select(F.col("tenant_id").alias("t")).distinct()
    old = gated.select(F.col("tenant_id").alias("g"), F.col("old_precision").isNotNull().alias("compared"))
    meta = joins.tenant_meta(views.tenants(spark, sf), rows)
    joined = (meta.join(promoted, meta.tenant_id == promoted.t, "left").join(old, meta.tenant_id == old.g, "left")
              .join(live.select(F.col("tenant_id").alias("l")), F.col("l") == meta.tenant_id, "left"))
    return joined.select(
        "tenant_id", ((F.col("model_phase") == "tenant") == F.col("t").isNotNull()).alias("consistent"),
        (F.coalesce("compared", F.lit(False)) == F.col("l").isNotNull()).alias("held_against"))
