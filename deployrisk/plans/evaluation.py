"""Model-quality, gate and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import alerts
from deployrisk.operators import drift, metrics
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic
from deployrisk.plans.scoring import predictions, scored

TOPIC = Topic()
BY = ["tenant_id"]

COUNTS_SQL = """c AS (SELECT tenant_id, count(*) FILTER (WHERE NOT f AND y = 0) AS tn, count(*) FILTER (WHERE f AND y = 0) AS fp,
      count(*) FILTER (WHERE NOT f AND y = 1) AS fn, count(*) FILTER (WHERE f AND y = 1) AS tp
    FROM (SELECT *, p > {0}::DOUBLE AS f FROM predictions) GROUP BY tenant_id)"""


def counted(threshold: float) -> str:
    return "WITH " + COUNTS_SQL.format(threshold)


@TOPIC.query("met_confusion", duck.sql(counted(0.3) + " SELECT * FROM c", "predictions"))
def met_confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf), BY, F.col("p") > 0.3)


PRF_SQL = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall"""


@TOPIC.query("met_prf", duck.sql(counted(0.3) + f"""
    SELECT tenant_id, {PRF_SQL}, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM c""", "predictions"))
def met_prf(spark, sf):
    return metrics.prf(metrics.confusion(predictions(spark, sf), BY, F.col("p") > 0.3)).select(
        "tenant_id", "precision", "recall", "f1")


AUC_SQL = """a AS (SELECT tenant_id, CASE WHEN np * nn = 0 THEN 0.5::DOUBLE ELSE (rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn) END AS auc_roc FROM (
    SELECT tenant_id, sum(y) AS np, sum(1 - y) AS nn, sum(CASE WHEN y = 1 THEN r END) AS rs FROM (
      SELECT tenant_id, y, rank() OVER (PARTITION BY tenant_id ORDER BY p) + (count(*) OVER (PARTITION BY tenant_id, p) - 1) / 2.0::DOUBLE AS r
      FROM predictions) GROUP BY tenant_id))"""


@TOPIC.query("met_auc_roc", duck.sql("WITH " + AUC_SQL + " SELECT tenant_id, auc_roc FROM a", "predictions"))
def met_auc_roc(spark, sf):
    return metrics.auc_roc(predictions(spark, sf), BY)


AP_SQL = """s AS (SELECT tenant_id, p, sum(y) AS pos, count(*) AS n FROM predictions GROUP BY tenant_id, p),
    cum AS (SELECT tenant_id, p, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY tenant_id) AS total
        FROM s WINDOW w AS (PARTITION BY tenant_id ORDER BY p DESC)),
    ap AS (SELECT tenant_id, sum((tp - prev) / CAST(total AS DOUBLE) * tp / flagged) AS auc_pr FROM (
        SELECT *, lag(tp, 1, 0) OVER (PARTITION BY tenant_id ORDER BY p DESC) AS prev FROM cum) GROUP BY tenant_id)"""


@TOPIC.query("met_auc_pr", duck.sql("WITH " + AP_SQL + " SELECT tenant_id, auc_pr FROM ap", "predictions"))
def met_auc_pr(spark, sf):
    return metrics.auc_pr(predictions(spark, sf), BY)


MCC_SQL = """CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
    ELSE (tp * tn - fp * fn) / sqrt(CAST((tp + fp) * (tp + fn) AS DOUBLE) * ((tn + fp) * (tn + fn))) END AS mcc"""


@TOPIC.query("met_mcc", duck.sql(counted(0.7) + f" SELECT tenant_id, {MCC_SQL} FROM c", "predictions"))
def met_mcc(spark, sf):
    return metrics.mcc(metrics.confusion(predictions(spark, sf), BY, F.col("p") > metrics.BLOCK)).select("tenant_id", "mcc")


BLOCK_SQL = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision_at_block,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall_at_block,
    (tp + fp) / CAST(tp + fp + tn + fn AS DOUBLE) AS blocked_share"""


@TOPIC.query("met_block", duck.sql(counted(0.7) + f" SELECT tenant_id, {BLOCK_SQL} FROM c", "predictions"))
def met_block(spark, sf):
    return metrics.block_quality(predictions(spark, sf), BY)


@TOPIC.query("met_brier", duck.sql("SELECT tenant_id, avg((p - y) * (p - y)) AS brier FROM predictions GROUP BY tenant_id", "predictions"))
def met_brier(spark, sf):
    return metrics.brier(predictions(spark, sf), BY)


ECE_SQL = """e AS (SELECT tenant_id, sum(abs(gap) * n) / sum(n) AS ece FROM (
    SELECT tenant_id, least(9, greatest(0, floor(p * 10))) AS b, avg(p) - avg(y) AS gap, count(*) AS n FROM predictions GROUP BY 1, 2) GROUP BY tenant_id)"""


@TOPIC.query("met_ece", duck.sql("WITH " + ECE_SQL + " SELECT tenant_id, ece FROM e", "predictions"))
def met_ece(spark, sf):
    return metrics.calibration_error(predictions(spark, sf), BY)


@TOPIC.query("met_reliability", duck.sql("""
    SELECT tenant_id, CASE WHEN p >= 0.8::DOUBLE THEN 4 WHEN p >= 0.6::DOUBLE THEN 3 WHEN p >= 0.4::DOUBLE THEN 2 WHEN p >= 0.2::DOUBLE THEN 1 ELSE 0 END AS band,
        count(*) AS rows, avg(p) AS predicted, avg(y) AS observed FROM predictions GROUP BY 1, 2 HAVING count(*) >= 10""", "predictions"))
def met_reliability(spark, sf):
    return metrics.reliability(predictions(spark, sf), BY)


LIFT_SQL = """(tp + fn) / CAST(tp + fp + fn + tn AS DOUBLE) AS base_rate"""
LIFTED_SQL = f"""l AS (SELECT *, CASE WHEN base_rate > 0 THEN precision / base_rate ELSE 0 END AS precision_lift,
    greatest(0.10::DOUBLE, base_rate * 1.5::DOUBLE) AS precision_required FROM (SELECT *, {PRF_SQL}, {LIFT_SQL} FROM c))"""


@TOPIC.query("met_lift", duck.sql(counted(0.3) + ", " + LIFTED_SQL + """
    SELECT tenant_id, precision, base_rate, precision_lift, precision_required FROM l""", "predictions"))
def met_lift(spark, sf):
    return metrics.lift(metrics.confusion(predictions(spark, sf), BY, F.col("p") > 0.3)).select(
        "tenant_id", "precision", "base_rate", "precision_lift", "precision_required")


@TOPIC.query("met_plain", duck.sql(counted(0.3) + """
    SELECT tenant_id, tp + fp AS flagged, tp AS correct, fp AS false_alarms, tp + fn AS truly_risky, fn AS missed FROM c""", "predictions"))
def met_plain(spark, sf):
    return metrics.plain(predictions(spark, sf), BY, F.col("p") > 0.3)


@TOPIC.query("met_evaluate", duck.sql(counted(0.7) + f", {AUC_SQL}, {AP_SQL}, {ECE_SQL}" + f"""
    SELECT tenant_id, {MCC_SQL}, {BLOCK_SQL}, auc_roc, auc_pr, ece,
        (SELECT avg((p - y) * (p - y)) FROM predictions q WHERE q.tenant_id = c.tenant_id) AS brier
    FROM c JOIN a USING (tenant_id) JOIN ap USING (tenant_id) JOIN e USING (tenant_id)""", "predictions"))
def met_evaluate(spark, sf):
    return metrics.evaluate(predictions(spark, sf), BY)


# --- gates: the rule is the candidate, the complement of the pass rate the incumbent

def gate_rows(spark, sf):
    rows = scored(spark, sf).filter(F.col("label").isin(0, 1)).select(
        "tenant_id", "build_id", "p", F.col("label").alias("y"), (1 - F.col("test_pass_rate")).alias("p_old"))
    return metrics.held_out_summary(rows, BY, old=True).withColumn("dataset_size", F.col("test_rows"))


GATE_SQL = counted(0.5) + f", {AUC_SQL}, {LIFTED_SQL}" + """,
    o AS (SELECT tenant_id, coalesce(sum(CASE WHEN f AND label = 1 THEN 1 ELSE 0 END) / CAST(nullif(sum(CASE WHEN f THEN 1 ELSE 0 END), 0) AS DOUBLE), 0) AS old_precision
        FROM (SELECT *, 1 - test_pass_rate > 0.5::DOUBLE AS f FROM scored WHERE label IN (0, 1)) GROUP BY tenant_id),
    g AS (SELECT *, tp + fp + fn + tn AS dataset_size, tp + fp + fn + tn AS test_rows, tp + fn AS test_risky,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
        FROM l JOIN a USING (tenant_id) JOIN o USING (tenant_id))"""


@TOPIC.query("ml_gate", duck.sql(GATE_SQL + """
    SELECT *, ok_dataset_size AND ok_test_rows AND ok_test_risky AND ok_precision AND ok_auc_roc AND ok_risky_ratio AND ok_not_regressing AS passed FROM (
      SELECT tenant_id, dataset_size, test_rows, test_risky, precision, auc_roc, precision_required, old_precision,
        dataset_size >= 200 AS ok_dataset_size, test_rows >= 40 AS ok_test_rows, test_risky >= 5 AS ok_test_risky,
        precision >= precision_required AS ok_precision, auc_roc >= 0.70::DOUBLE AS ok_auc_roc,
        base_rate >= 0.05::DOUBLE AS ok_risky_ratio, precision >= old_precision - 0.05::DOUBLE AS ok_not_regressing FROM g)""", "predictions"))
def ml_gate(spark, sf):
    return metrics.gate(gate_rows(spark, sf)).select(
        "tenant_id", "dataset_size", "test_rows", "test_risky", "precision", "auc_roc", "precision_required", "old_precision",
        "ok_dataset_size", "ok_test_rows", "ok_test_risky", "ok_precision", "ok_auc_roc", "ok_risky_ratio",
        "ok_not_regressing", "passed")


@TOPIC.query("alert_retrain", duck.sql(GATE_SQL + """,
    k AS (SELECT *, array_to_string(list_filter([CASE WHEN dataset_size < 200 THEN 'dataset_size' END, CASE WHEN test_rows < 40 THEN 'test_rows' END,
        CASE WHEN test_risky < 5 THEN 'test_risky' END, CASE WHEN precision < precision_required THEN 'precision' END,
        CASE WHEN auc_roc < 0.70::DOUBLE THEN 'auc_roc' END, CASE WHEN base_rate < 0.05::DOUBLE THEN 'risky_ratio' END,
        CASE WHEN precision < old_precision - 0.05::DOUBLE THEN 'not_regressing' END], lambda x: x IS NOT NULL), ', ') AS failed FROM g)
    SELECT tenant_id, CASE WHEN failed = '' THEN ':white_check_mark: *Deploy risk — Model Updated*' || chr(10) || 'Tenant `' || tenant_id
            || '` has a new personalised model.' || chr(10) || 'Precision: *' || printf('%.1f', round(precision * 100, 1)) || '%*  |  AUC-ROC: *'
            || printf('%.3f', round(auc_roc, 3)) || '*  |  Trained on *' || dataset_size || '* builds'
        ELSE ':warning: *Deploy risk — Retrain Failed*' || chr(10) || 'Tenant `' || tenant_id || '` — keeping old model.' || chr(10) || 'Failed checks: ' || failed END AS message FROM k""", "predictions"))
def alert_retrain(spark, sf):
    """The message about each tenant's retraining."""
    gated = metrics.gate(gate_rows(spark, sf))
    text = alerts.retrain_text(F.col("tenant_id"), F.col("passed"), F.col("precision"), F.col("auc_roc"), F.col("dataset_size"), metrics.failed_checks(gated))
    return gated.select("tenant_id", text.alias("message"))


@TOPIC.query("ml_gate_v1", duck.sql(GATE_SQL + """
    SELECT tenant_id, precision, auc_roc, base_rate,
        dataset_size >= 80 AND precision >= 0.75::DOUBLE AND auc_roc >= 0.70::DOUBLE AND base_rate >= 0.05::DOUBLE AS passed FROM g""", "predictions"))
def ml_gate_v1(spark, sf):
    return metrics.gate_v1(gate_rows(spark, sf)).select("tenant_id", "precision", "auc_roc", "base_rate", "passed")


@TOPIC.query("ml_gate_base", duck.sql(GATE_SQL + """
    SELECT tenant_id, precision, recall, f1, precision >= 0.55::DOUBLE AND auc_roc >= 0.65::DOUBLE AND recall >= 0.40::DOUBLE AS passed,
        precision >= 0.75::DOUBLE AS ok_precision_target, auc_roc >= 0.70::DOUBLE AS ok_auc_separation, f1 >= 0.60::DOUBLE AS ok_f1_balanced FROM g""", "predictions"))
def ml_gate_base(spark, sf):
    return metrics.gate_base(gate_rows(spark, sf)).select(
        "tenant_id", "precision", "recall", "f1", "passed", "ok_precision_target", "ok_auc_separation", "ok_f1_balanced")


# --- drift

KS_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS k,
        count(*) OVER (PARTITION BY tenant_id) AS size FROM builds WHERE tenant_id <> 'demo'),
    v AS (""" + " UNION ALL ".join(
    f"SELECT tenant_id, '{f}' AS feature, k <= 30 AS recent, CAST({f} AS DOUBLE) AS value FROM r WHERE k <= 60 AND size >= 60 AND {f} IS NOT NULL"
    for f in K.FEATURES) + """),
    sizes AS (SELECT tenant_id, feature, count(*) FILTER (WHERE NOT recent) AS n, count(*) FILTER (WHERE recent) AS m FROM v GROUP BY ALL),
    points AS (SELECT DISTINCT tenant_id, feature, value FROM v),
    ks AS (SELECT tenant_id, feature, n, m, max(abs(below_p * m - below_r * n)) AS h FROM (
        SELECT p.tenant_id, p.feature, n, m, (SELECT count(*) FROM v WHERE v.tenant_id = p.tenant_id AND v.feature = p.feature AND v.value <= p.value AND NOT recent) AS below_p,
          (SELECT count(*) FROM v WHERE v.tenant_id = p.tenant_id AND v.feature = p.feature AND v.value <= p.value AND recent) AS below_r
        FROM points p JOIN sizes USING (tenant_id, feature)) WHERE n > 0 AND m > 0 GROUP BY ALL)"""

PATHS_SQL = """cases AS (SELECT DISTINCT n, m, h FROM ks WHERE h > 0),
    paths AS (SELECT n, m, h, 0 AS k, CAST(0 AS BIGINT) AS i, 1.0::DOUBLE AS q FROM cases
      UNION ALL
      SELECT n, m, h, k + 1, i2, sum(q * CASE WHEN i2 > i THEN i2 ELSE k + 1 - i2 END / CAST(k + 1 AS DOUBLE)) FROM (
        SELECT *, i + d AS i2 FROM paths, (VALUES (0), (1)) AS step(d) WHERE k < n + m)
      WHERE i2 <= n AND k + 1 - i2 <= m AND abs(i2 * m - (k + 1 - i2) * n) < h
      GROUP BY n, m, h, k, i2),
    pv AS (SELECT c.n, c.m, c.h, 1 - coalesce(max(q), 0) AS p_value FROM cases c
      LEFT JOIN paths p ON p.n = c.n AND p.m = c.m AND p.h = c.h AND p.k = c.n + c.m GROUP BY ALL),
    d AS (SELECT tenant_id, feature, ks.n AS n_previous, ks.m AS n_recent, ks.h / CAST(ks.n * ks.m AS DOUBLE) AS statistic,
        coalesce(p_value, 1.0::DOUBLE) AS p_value, coalesce(p_value, 1.0::DOUBLE) < 0.05::DOUBLE AS drifted
      FROM ks LEFT JOIN pv USING (n, m, h))"""

DRIFT_SQL = "WITH RECURSIVE " + KS_SQL + ", " + PATHS_SQL + """,
    verdicts AS (SELECT tenant_id, count(*) AS builds, any_value(coalesce(f, 0)) AS drifted_features,
        CASE WHEN count(*) < 60 THEN 'skipped' WHEN any_value(coalesce(f, 0)) >= 3 THEN 'drifted' ELSE 'stable' END AS verdict
      FROM builds LEFT JOIN (SELECT tenant_id, count(*) FILTER (WHERE drifted) AS f FROM d GROUP BY tenant_id) USING (tenant_id)
      WHERE tenant_id <> 'demo' GROUP BY tenant_id)"""


def drift_input(spark, sf):
    return views.recent_builds(spark, sf, 2 * K.DRIFT_RUN).filter(F.col("tenant_id") != "demo")


@TOPIC.query("drift_ks", duck.sql("WITH " + KS_SQL + """
    SELECT tenant_id, feature, n AS n_previous, m AS n_recent, h / CAST(n * m AS DOUBLE) AS statistic FROM ks""", "builds"))
def drift_ks(spark, sf):
    return drift.ks_statistic(drift_input(spark, sf)).drop("_h")


@TOPIC.query("drift_pvalue", duck.sql(DRIFT_SQL + """
    SELECT tenant_id, feature, n_previous, n_recent, statistic, p_value, drifted FROM d""", "builds"))
def drift_pvalue(spark, sf):
    return drift.drifted(drift_input(spark, sf))


@TOPIC.query("drift_verdict", duck.sql(DRIFT_SQL + """
    SELECT tenant_id, builds, drifted_features, verdict FROM verdicts""", "builds"))
def drift_verdict(spark, sf):
    return drift.verdicts(views.recent_builds(spark, sf, 2 * K.DRIFT_RUN), heads=views.build_heads(spark, sf))


@TOPIC.query("alert_drift", duck.sql(DRIFT_SQL + """
    SELECT tenant_id, ':chart_with_upwards_trend: *Deploy risk — Feature Drift Detected*' || chr(10) || 'Tenant `' || tenant_id
        || '` — build patterns have shifted.' || chr(10) || 'Drifted features:' AS head, drifted_features AS lines
    FROM verdicts WHERE verdict = 'drifted'""", "builds"))
def alert_drift(spark, sf):
    """A message for each drifted tenant: its first lines, and how many features it lists."""
    found = drift.reports(views.recent_builds(spark, sf, 2 * K.DRIFT_RUN), heads=views.build_heads(spark, sf)).filter("verdict = 'drifted'")
    text = alerts.drift_text(F.col("tenant_id"), F.col("features"))
    made = found.select("tenant_id", "drifted_features", text.alias("text"))
    listed = F.size(F.filter(F.split("text", "\n"), lambda line: line.startswith("  • "))).cast("long")
    return made.select("tenant_id", F.substring_index("text", "\n", 3).alias("head"), listed.alias("lines"))
