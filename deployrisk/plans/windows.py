"""Window, top-k and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import scalars as S
from deployrisk.operators import drift, selection
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic
from deployrisk.plans.scoring import scored

TOPIC = Topic()

RANKED = "(SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS r, count(*) OVER (PARTITION BY tenant_id) AS n FROM heads)"


@TOPIC.query("win_newest_n", duck.sql(f"""
    SELECT tenant_id, build_id, least(n, 30) - r + 1 AS place FROM {RANKED} WHERE r <= 30""", "heads"))
def win_newest_n(spark, sf):
    return selection.newest_builds(views.build_heads(spark, sf), 30).select(
        "tenant_id", "build_id", F.col("place").cast("long").alias("place"))


@TOPIC.query("win_tail_split", duck.sql(f"""
    SELECT tenant_id, build_id, r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) AND r < n AS held_out FROM (
        SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS r, count(*) OVER (PARTITION BY tenant_id) AS n
        FROM heads WHERE label >= 0)""", "heads"))
def win_tail_split(spark, sf):
    return selection.tail_split(views.build_heads(spark, sf).filter("label >= 0")).select(
        "tenant_id", "build_id", "held_out")


@TOPIC.query("win_recent_prev", duck.sql(f"""
    SELECT tenant_id, build_id, CASE WHEN r <= 30 THEN 'recent' ELSE 'previous' END AS side FROM {RANKED} WHERE r <= 60 AND n >= 60""", "heads"))
def win_recent_prev(spark, sf):
    return drift.recent_and_previous(views.build_heads(spark, sf)).select("tenant_id", "build_id", "side")


@TOPIC.query("win_build_seq", duck.sql(f"""
    SELECT tenant_id, build_id, n - r + 1 AS build_number FROM {RANKED}""", "heads"))
def win_build_seq(spark, sf):
    return selection.numbered(views.build_heads(spark, sf)).select("tenant_id", "build_id", "build_number")


@TOPIC.query("top_recent10", duck.sql(f"""
    SELECT tenant_id, build_id, timestamp, r AS rank FROM {RANKED} WHERE r <= 10""", "heads"))
def top_recent10(spark, sf):
    return selection.recent_ten(views.build_heads(spark, sf)).select(
        "tenant_id", "build_id", "timestamp", F.col("rank").cast("long").alias("rank"))


DIGEST = "substr(md5(build_id || '-42'), 1, 15)"


@TOPIC.query("split_stratified", duck.sql(f"""
    SELECT label, build_id, row_number() OVER (PARTITION BY label ORDER BY {DIGEST}, build_id)
        <= round_even(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE, 0) AS held_out FROM heads WHERE label >= 0""", "heads"))
def split_stratified(spark, sf):
    return selection.stratified_split(views.build_heads(spark, sf).filter("label >= 0"), ["label"], "build_id").select(
        "label", "build_id", "held_out")


@TOPIC.query("split_kfold", duck.sql(f"""
    SELECT count(*) AS folds, avg(precision) AS cv_precision, stddev_pop(precision) AS cv_std FROM (
      SELECT CAST('0x' || {DIGEST} AS BIGINT) % 5 AS fold, sum(CASE WHEN p > 0.44::DOUBLE AND label = 1 THEN 1 ELSE 0 END)
          / CAST(sum(CASE WHEN p > 0.44::DOUBLE THEN 1 ELSE 0 END) AS DOUBLE) AS precision FROM scored WHERE label >= 0 GROUP BY 1)""", "scored"))
def split_kfold(spark, sf):
    """Precision of the rule at its own threshold on each of five folds, with mean and spread."""
    from deployrisk.operators import metrics
    rows = selection.folds(scored(spark, sf).filter(F.col("label") >= 0).withColumn("y", F.col("label")), "build_id")
    per_fold = metrics.prf(metrics.confusion(rows, ["fold"], F.col("p") > 0.44))
    return per_fold.agg(F.count(F.lit(1)).alias("folds"), F.avg("precision").alias("cv_precision"),
                        F.stddev_pop("precision").alias("cv_std"))


# --- explanation: importances stand in as normalised |corr(feature, label)| per tenant

def importances(spark, sf):
    rows = scored(spark, sf).filter(F.col("label") >= 0)
    corr = rows.groupBy("tenant_id").agg(*[
        F.coalesce(F.abs(F.corr(F.col(f).cast("double"), F.col("label").cast("double"))), F.lit(0.0)).alias(f)
        for f in K.FEATURES if f != "deployer_exp"])
    total = sum((F.col(f) for f in K.FEATURES if f != "deployer_exp"), F.lit(0.0))
    return corr.select("tenant_id", F.array(*[
        (F.col(f) / total if f != "deployer_exp" else F.lit(0.0)) for f in K.FEATURES]).alias("importances"))


IMP_SQL = """c AS (SELECT tenant_id, """ + ", ".join(
    f"coalesce(abs(corr(CAST({f} AS DOUBLE), CAST(label AS DOUBLE))), 0) AS {f}" for f in K.FEATURES if f != "deployer_exp") + """
        FROM filled WHERE label >= 0 GROUP BY tenant_id),
    i AS (""" + " UNION ALL ".join(
    f"SELECT tenant_id, '{f}' AS feature, {place} AS place, '{K.DISPLAY_LABELS[f]}' AS label, "
    + (f"{f} / (" + " + ".join(g for g in K.FEATURES if g != 'deployer_exp') + ")" if f != "deployer_exp" else "0.0::DOUBLE")
    + " AS importance FROM c" for place, f in enumerate(K.FEATURES)) + """),
    top AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY round(importance, 3) DESC, place) AS k FROM i)"""


@TOPIC.query("top_reasons", duck.sql("WITH " + IMP_SQL + """
    SELECT b.build_id, string_agg(feature, ',' ORDER BY k) AS features, string_agg(top.label, ',' ORDER BY k) AS labels,
        sum(round(importance, 3)) AS weight, max(CASE WHEN k = 1 AND ((feature = 'diff_size' AND diff_size IS NULL) OR (feature = 'files_changed' AND files_changed IS NULL)
            OR (feature = 'recent_failure_rate' AND recent_failure_rate IS NULL) OR (feature = 'test_pass_rate' AND test_pass_rate IS NULL)
            OR (feature = 'is_hotfix' AND is_hotfix IS NULL) OR (feature = 'days_since_deploy' AND days_since_deploy IS NULL)
            OR (feature = 'build_time_delta' AND build_time_delta IS NULL)) THEN 1 ELSE 0 END) AS first_estimated
    FROM builds b JOIN top USING (tenant_id) WHERE k <= 3 GROUP BY b.build_id""", "builds", "filled"))
def top_reasons(spark, sf):
    raw = views.builds(spark, sf)
    imputed = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in K.FEATURES]))
    from deployrisk.operators.scoring import fill_fixed
    models = importances(spark, sf).select("tenant_id", S.rank_features(F.col("importances")).alias("ranked"))
    rows = fill_fixed(raw.withColumn("imputed", imputed)).join(models, "tenant_id")
    found = rows.select("build_id", S.top_reasons(F.col("ranked"), F.col("imputed")).alias("reasons"))
    return found.select(
        "build_id", F.array_join("reasons.feature", ",").alias("features"),
        F.array_join("reasons.label", ",").alias("labels"),
        F.aggregate("reasons", F.lit(0.0), lambda a, r: a + r["importance"]).alias("weight"),
        F.col("reasons")[0]["value_str"].endswith(" — estimated").cast("int").alias("first_estimated"))


@TOPIC.query("top_importance", duck.sql("WITH " + IMP_SQL + """
    , top5 AS (SELECT tenant_id, feature, importance, row_number() OVER (PARTITION BY tenant_id ORDER BY importance DESC, place) AS k FROM i)
    SELECT tenant_id, feature, round(importance * 100, 1) AS percent, k AS rank FROM top5 WHERE k <= 5""", "filled"))
def top_importance(spark, sf):
    from deployrisk.operators.models import importance_rows
    from deployrisk.operators.ordered import newest
    long = importance_rows(importances(spark, sf))
    ranked = newest(long.withColumn("_first", -F.col("place")), ["tenant_id"], ["importance", "_first"], 5)
    return ranked.select("tenant_id", "feature", F.round(F.col("importance") * 100, 1).alias("percent"),
                         F.col("rank").cast("long").alias("rank"))


@TOPIC.query("sort_signal", duck.sql("""
    SELECT build_id, CASE WHEN label = 1 THEN 'failure' WHEN regexp_matches(lower(branch_name), 'hotfix|fix/|patch/|revert/') THEN 'hotfix_branch'
        WHEN order_key % 4 = 0 THEN 'revert_commit' ELSE 'success' END AS signal FROM heads""", "heads"))
def sort_signal(spark, sf):
    from deployrisk.plans.scalars import outcome_signals
    return outcome_signals(spark, sf).select("build_id", F.col("found.source").alias("signal"))


@TOPIC.query("fn_status", duck.sql("""
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS r, count(*) OVER (PARTITION BY tenant_id) AS build_count FROM scored)
    SELECT tenant_id, ci_platform, coalesce(build_count, 0) AS build_count, coalesce(build_count, 0) > 0 AS connected, build_id, score,
        CASE WHEN score <= 40 THEN 'SAFE' WHEN score <= 70 THEN 'WARNING' WHEN score IS NOT NULL THEN 'BLOCKED' END AS verdict, job_name, branch_name
    FROM tenants LEFT JOIN (SELECT * FROM l WHERE r = 1) USING (tenant_id)""", "scored", "tenants"))
def fn_status(spark, sf):
    return selection.latest(scored(spark, sf), views.tenants(spark, sf))
