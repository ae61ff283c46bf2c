"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import alerts
from deployrisk.functions import labels as L
from deployrisk.functions import scalars as S
from deployrisk.operators.models import balanced_weights
from deployrisk.operators.scoring import fill_fixed, with_settings
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic
from deployrisk.plans.scoring import scored

TOPIC = Topic()


@TOPIC.query("fn_score", """
    SELECT l_orderkey AS build, l_linenumber AS line, l_partkey AS part, CAST(round_even(l_quantity / 200 * 100, 0) AS INTEGER) AS score FROM lineitem""")
def fn_score(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("build"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        S.score(F.col("l_quantity") / 200).alias("score"))


VERDICT_SQL = "CASE WHEN score <= coalesce(threshold_yellow, 40) THEN 'SAFE' WHEN score <= coalesce(threshold_red, 70) THEN 'WARNING' ELSE 'BLOCKED' END"


@TOPIC.query("fn_verdict", duck.sql(f"""
    SELECT build_id, score, verdict, CASE verdict WHEN 'SAFE' THEN 'green' WHEN 'WARNING' THEN 'yellow' ELSE 'red' END AS colour
    FROM (SELECT build_id, score, {VERDICT_SQL} AS verdict FROM scored LEFT JOIN tenants USING (tenant_id))""", "scored", "tenants"))
def fn_verdict(spark, sf):
    rows = with_settings(scored(spark, sf).drop("verdict", "colour"), views.tenants(spark, sf))
    said = rows.withColumn("verdict", S.verdict(F.col("score"), F.col("threshold_yellow"), F.col("threshold_red")))
    return said.select("build_id", "score", "verdict", S.colour(F.col("verdict")).alias("colour"))


@TOPIC.query("fn_gate_decision", duck.sql(f"""
    SELECT build_id, CASE WHEN v = 'UNAVAILABLE' THEN 'proceed_unavailable' WHEN v = 'BLOCKED' AND hour_of_day % 2 = 0 THEN 'proceed_fail_open'
        WHEN v = 'BLOCKED' THEN 'stop' ELSE 'proceed' END AS decision, CASE WHEN v = 'BLOCKED' AND hour_of_day % 2 = 1 THEN 1 ELSE 0 END AS exit_code
    FROM (SELECT build_id, hour_of_day, CASE WHEN label < 0 AND score % 3 = 0 THEN 'UNAVAILABLE' ELSE {VERDICT_SQL} END AS v FROM scored LEFT JOIN tenants USING (tenant_id))""", "scored", "tenants"))
def fn_gate_decision(spark, sf):
    rows = with_settings(scored(spark, sf), views.tenants(spark, sf))
    verdict = F.when(~((F.col("label") < 0) & (F.col("score") % 3 == 0)), S.verdict(
        F.col("score"), F.col("threshold_yellow"), F.col("threshold_red")))
    fail_open = F.col("hour_of_day") % 2 == 0
    return rows.select("build_id", S.gate_decision(verdict, fail_open).alias("decision"),
                       S.gate_exit_code(verdict, fail_open).alias("exit_code"))


@TOPIC.query("fn_value_str", duck.sql("""
    SELECT build_id,
        diff_size || CASE WHEN diff_size > 500 THEN ' lines (very large)' WHEN diff_size > 200 THEN ' lines (large)' ELSE ' lines' END AS diff_size,
        CASE WHEN hour_of_day = 0 THEN 12 WHEN hour_of_day <= 12 THEN hour_of_day ELSE hour_of_day - 12 END || CASE WHEN hour_of_day < 12 THEN ':00 AM' ELSE ':00 PM' END
          || CASE WHEN hour_of_day BETWEEN 16 AND 19 THEN ' (end of day)' ELSE '' END AS hour_of_day,
        ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][day_of_week + 1] || CASE WHEN day_of_week >= 4 THEN ' (risky!)' ELSE '' END AS day_of_week,
        CASE WHEN fr = 0 THEN '0% (all recent builds passed)' ELSE fr || '% of last 10 builds failed' END AS recent_failure_rate,
        CAST(round_even(test_pass_rate * 100, 0) AS INTEGER) || '% tests passing' AS test_pass_rate,
        CASE WHEN is_hotfix = 1 THEN 'Yes (hotfix branch)' ELSE 'No' END AS is_hotfix, deployer_exp || ' past deploys' AS deployer_exp,
        CASE WHEN d > 0 THEN '+' || d || '% slower than average' WHEN d < 0 THEN d || '% faster than average' ELSE 'normal' END AS build_time_delta,
        CAST(files_changed AS VARCHAR) AS files_changed, CAST(CAST(days_since_deploy AS DOUBLE) AS VARCHAR) || ' days' AS days_since_deploy
    FROM (SELECT *, CAST(round_even(recent_failure_rate * 100, 0) AS INTEGER) AS fr, CAST(round_even(build_time_delta * 100, 0) AS INTEGER) AS d FROM filled)""", "filled"))
def fn_value_str(spark, sf):
    texts = S.value_texts()
    shown = ["diff_size", "hour_of_day", "day_of_week", "recent_failure_rate", "test_pass_rate", "is_hotfix",
             "deployer_exp", "build_time_delta", "files_changed", "days_since_deploy"]
    return fill_fixed(views.builds(spark, sf)).select("build_id", *[texts[f].alias(f) for f in shown])


@TOPIC.query("fn_feature_label", duck.sql(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{K.CONTRACT_LABELS[f]}' AS contract_label, '{K.DISPLAY_LABELS[f]}' AS display_label, count({f}) AS measured FROM builds" for f in K.FEATURES), "builds"))
def fn_feature_label(spark, sf):
    from deployrisk.operators.impute import unpivot_features
    long = unpivot_features(views.builds(spark, sf), [])
    counted = long.groupBy("feature").agg(F.count("value").alias("measured"))
    return counted.select("feature", S.lookup(K.CONTRACT_LABELS, F.col("feature")).alias("contract_label"),
                          S.lookup(K.DISPLAY_LABELS, F.col("feature")).alias("display_label"), "measured")


@TOPIC.query("fn_rule_risk", duck.sql("""
    SELECT build_id, round(p, 6) AS risk, CASE WHEN p > 0.44::DOUBLE THEN 1 ELSE 0 END AS rule_label FROM scored""", "scored"))
def fn_rule_risk(spark, sf):
    return scored(spark, sf).select("build_id", F.round("p", 6).alias("risk"), S.rule_label(F.col("p")).alias("rule_label"))


@TOPIC.query("fn_rule_risk_v2", duck.sql("""
    SELECT build_id, round(least(1.0::DOUBLE,
        CASE WHEN recent_failure_rate > 0.20::DOUBLE THEN 0.28::DOUBLE WHEN recent_failure_rate > 0.10::DOUBLE THEN 0.14::DOUBLE ELSE 0 END
      + CASE WHEN is_hotfix = 1 THEN 0.22::DOUBLE ELSE 0 END
      + CASE WHEN test_pass_rate < 0.60::DOUBLE THEN 0.20::DOUBLE WHEN test_pass_rate < 0.75::DOUBLE THEN 0.10::DOUBLE ELSE 0 END
      + CASE WHEN diff_size > 400 THEN 0.18::DOUBLE WHEN diff_size > 150 THEN 0.08::DOUBLE ELSE 0 END
      + CASE WHEN hour_of_day BETWEEN 16 AND 19 THEN 0.12::DOUBLE WHEN hour_of_day >= 22 OR hour_of_day <= 5 THEN 0.10::DOUBLE ELSE 0 END
      + CASE WHEN day_of_week = 4 THEN 0.10::DOUBLE WHEN day_of_week >= 5 THEN 0.07::DOUBLE ELSE 0 END
      + CASE WHEN days_since_deploy > 14 THEN 0.08::DOUBLE ELSE 0 END), 6) AS risk FROM filled""", "filled"))
def fn_rule_risk_v2(spark, sf):
    return fill_fixed(views.builds(spark, sf)).select("build_id", F.round(S.rule_risk_v2(), 6).alias("risk"))


@TOPIC.query("fn_label_norm", duck.sql("SELECT seq, label_source FROM label_events", "label_events"))
def fn_label_norm(spark, sf):
    return views.label_events(spark, sf).select("seq", L.normalise(F.col("raw_source")).alias("label_source"))


@TOPIC.query("fn_label_weight", duck.sql("SELECT seq, sample_weight FROM label_events", "label_events"))
def fn_label_weight(spark, sf):
    return views.label_events(spark, sf).select("seq", L.weight(F.col("raw_source")).alias("sample_weight"))


@TOPIC.query("fn_label_observed", duck.sql("SELECT seq, observed FROM label_events", "label_events"))
def fn_label_observed(spark, sf):
    return views.label_events(spark, sf).select("seq", L.observed(F.col("raw_source")).alias("observed"))


def outcome_signals(spark, sf):
    result = F.when(F.col("label") == 1, "FAILURE").otherwise("SUCCESS")
    message = F.when(F.col("order_key") % 4 == 0, "Revert of the last change").otherwise("add page")
    return views.build_heads(spark, sf).select("build_id", S.detect_label(result, F.col("branch_name"), message).alias("found"))


@TOPIC.query("fn_detect_label", duck.sql("""
    SELECT build_id, CASE WHEN a + b + c = 0 THEN 0 ELSE 1 END AS label,
        CASE WHEN a = 1 THEN 'failure' WHEN b = 1 THEN 'hotfix_branch' WHEN c = 1 THEN 'revert_commit' ELSE 'success' END AS source,
        CASE WHEN a + b + c <> 1 OR a = 1 THEN 1.0::DOUBLE WHEN b = 1 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS weight
    FROM (SELECT build_id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS a, CASE WHEN regexp_matches(lower(branch_name), 'hotfix|fix/|patch/|revert/') THEN 1 ELSE 0 END AS b,
        CASE WHEN order_key % 4 = 0 THEN 1 ELSE 0 END AS c FROM heads)""", "heads"))
def fn_detect_label(spark, sf):
    return outcome_signals(spark, sf).select("build_id", "found.*")


@TOPIC.query("fn_epoch_iso", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN floor(epoch_us(ts) / 1e6) WHEN 1 THEN epoch_us(ts) / 1e6 - 7200
        WHEN 2 THEN CAST(event_id AS DOUBLE) + 0.5::DOUBLE END AS epoch FROM events""")
def fn_epoch_iso(spark, sf):
    kind = F.col("event_id") % 4
    text = (F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(kind == 1, F.date_format("ts", "' '''yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0200'"))
            .when(kind == 2, F.concat((F.col("event_id") + 0.5).cast("string"), F.lit(" ")))
            .otherwise(F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd"))))
    return views.events(spark, sf).select("event_id", S.epoch_seconds(F.regexp_replace(text, "'", "")).alias("epoch"))


@TOPIC.query("fn_ms_to_s", """
    SELECT event_id, CAST(value * 1000 AS BIGINT) / 1000.0::DOUBLE AS duration_secs,
        (epoch_us(ts) // 1000) / 1000.0::DOUBLE + CAST(value * 1000 AS BIGINT) / 1000.0::DOUBLE AS finished_at FROM events""")
def fn_ms_to_s(spark, sf):
    from deployrisk.sources.ci import ms_times
    duration, finished = ms_times(F.unix_millis(F.col("ts").cast("timestamp")), F.round(F.col("value") * 1000, 0).cast("long"))
    return views.events(spark, sf).select("event_id", duration.alias("duration_secs"), finished.alias("finished_at"))


@TOPIC.query("fn_hash_key", duck.sql("""
    SELECT event_id, CASE WHEN endpoint = 'signup' THEN 'ops' WHEN endpoint = 'view' THEN 'ip:' || split_part(forwarded_for, ',', 1)
        ELSE 'k:' || substr(sha256(api_key), 1, 32) END AS limiter_key FROM access_log""", "access_log"))
def fn_hash_key(spark, sf):
    key = F.when(F.col("endpoint") == "view", "").otherwise(F.col("api_key"))
    return views.access_log(spark, sf).select("event_id", S.limiter_key(
        key, F.col("forwarded_for"), F.col("endpoint"), ["signup"]).alias("limiter_key"))


@TOPIC.query("fn_class_weight", duck.sql("""
    SELECT build_id, n / (2.0::DOUBLE * nc) AS class_weight FROM (SELECT build_id, count(*) OVER (PARTITION BY tenant_id) AS n,
        count(*) OVER (PARTITION BY tenant_id, label) AS nc FROM heads WHERE label >= 0)""", "heads"))
def fn_class_weight(spark, sf):
    rows = views.build_heads(spark, sf).filter("label >= 0")
    return balanced_weights(rows, ["tenant_id"]).select("build_id", "class_weight")


@TOPIC.query("fn_alert_payload", duck.sql(f"""
    SELECT build_id, v.verdict, CASE v.verdict WHEN 'SAFE' THEN ':white_check_mark:' WHEN 'WARNING' THEN ':warning:' ELSE ':no_entry:' END || '  *Deploy risk — ' || v.verdict || '*'
          || CASE WHEN v.verdict = 'BLOCKED' THEN '  _(add `DEPLOY_FORCE=true` to override)_' ELSE '' END AS header,
        '*Risk Score*' || chr(10) || '`[' || repeat('█', score // 5) || repeat('░', 20 - score // 5) || ']`  *' || score || '/100*' AS score_text,
        'Thresholds: green <' || y || '  |  yellow ' || y || '-' || r || '  |  red >' || r AS limits
    FROM (SELECT build_id, score, coalesce(threshold_yellow, 40) AS y, coalesce(threshold_red, 70) AS r, {VERDICT_SQL} AS verdict
          FROM scored LEFT JOIN tenants USING (tenant_id)) v""", "scored", "tenants"))
def fn_alert_payload(spark, sf):
    rows = with_settings(scored(spark, sf).drop("verdict"), views.tenants(spark, sf)).withColumn(
        "verdict", S.verdict(F.col("score"), F.col("threshold_yellow"), F.col("threshold_red")))
    reasons = F.array(F.struct(F.lit("Diff size").alias("label"), S.value_texts()["diff_size"].alias("value_str")))
    payload = alerts.score_payload(
        F.col("job_name"), F.substring("build_id", 2, 20), F.col("score"), F.col("verdict"), F.lit("base"), reasons,
        F.col("threshold_yellow"), F.col("threshold_red"))
    made = rows.select("build_id", "verdict", payload.alias("payload"))
    at = "$.attachments[0].blocks"
    return made.select(
        "build_id", "verdict", F.get_json_object("payload", "$.text").alias("header"),
        F.get_json_object("payload", f"{at}[0].fields[1].text").alias("score_text"),
        F.get_json_object("payload", f"{at}[2].elements[0].text").alias("limits"))
