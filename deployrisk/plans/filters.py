"""Projection, validation, filter and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import scalars as S
from deployrisk.operators import validation
from deployrisk.plans import duck, scoring, views
from deployrisk.plans.registry import Topic

TOPIC = Topic()

AS_OF = 996624000  # 2001-08-01, the day of the newest build


@TOPIC.query("proj_contract", duck.sql("SELECT build_id, " + ", ".join(K.FEATURES) + " FROM builds", "builds"))
def proj_contract(spark, sf):
    return validation.contract_columns(views.builds(spark, sf), ["build_id"])


def model_rows(spark, sf):
    """One registry row per tenant, some with a damaged column list."""
    n, good = F.col("n_nationkey"), F.array(*[F.lit(f) for f in K.FEATURES])
    columns = (F.when(n % 5 == 1, F.slice(good, 1, 9))
               .when(n % 5 == 2, F.concat(F.slice(good, 1, 9), F.array(F.lit("noise"))))
               .when(n % 5 == 3, F.concat(F.slice(good, 2, 1), F.slice(good, 1, 1), F.slice(good, 3, 8)))
               .otherwise(good))
    nations = views.table(spark, sf, "nation").select(views.tenant_of("n_nationkey").alias("tenant_id"),
                                                      columns.alias("feature_columns"))
    used = views.build_heads(spark, sf).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("builds"))
    return nations.join(used, "tenant_id")


@TOPIC.query("chk_model_contract", duck.sql("""
    SELECT tenant_id, count(*) AS builds, any_value(CASE n % 5
        WHEN 1 THEN 'model expects 9 features, contract defines 10'
        WHEN 2 THEN 'feature set mismatch (extra=noise, missing=build_time_delta)'
        WHEN 3 THEN 'feature ORDER mismatch at index 0: contract=diff_size model=files_changed'
        ELSE 'ok' END) AS message, bool_and(n % 5 IN (0, 4)) AS ok
    FROM (SELECT tenant_id, CASE WHEN tenant_id = 'demo' THEN 0 ELSE CAST(substr(tenant_id, 2) AS INTEGER) END AS n FROM heads)
    GROUP BY tenant_id""", "heads"))
def chk_model_contract(spark, sf):
    return validation.model_contract(model_rows(spark, sf)).select("tenant_id", "builds", "message", "ok")


@TOPIC.query("set_except", duck.sql("""
    SELECT tenant_id, count(*) AS builds, any_value(CASE WHEN n % 5 = 2 THEN 'noise' ELSE '' END) AS extra,
        any_value(CASE WHEN n % 5 IN (1, 2) THEN 'build_time_delta' ELSE '' END) AS missing
    FROM (SELECT tenant_id, CASE WHEN tenant_id = 'demo' THEN 0 ELSE CAST(substr(tenant_id, 2) AS INTEGER) END AS n FROM heads)
    GROUP BY tenant_id""", "heads"))
def set_except(spark, sf):
    want = F.array(*[F.lit(f) for f in K.FEATURES])
    return model_rows(spark, sf).select(
        "tenant_id", "builds", F.array_join(F.array_except("feature_columns", want), ",").alias("extra"),
        F.array_join(F.array_except(want, "feature_columns"), ",").alias("missing"))


def wild(spark, sf):
    """Builds with some values pushed out of range."""
    return views.builds(spark, sf).withColumns({
        "diff_size": F.col("diff_size") * 200 - 1000,
        "test_pass_rate": F.col("test_pass_rate") * 1.5,
        "files_changed": F.col("files_changed") - 2})


@TOPIC.query("val_ranges", duck.sql("""
    SELECT build_id, array_to_string(list_filter([
        CASE WHEN d < 0 THEN 'diff_size: must be >= 0' END, CASE WHEN d > 50000 THEN 'diff_size: must be <= 50000' END,
        CASE WHEN f < 0 THEN 'files_changed: must be >= 0' END, CASE WHEN t > 1 THEN 'test_pass_rate: must be <= 1' END],
        lambda x: x IS NOT NULL), '; ') AS errors, NOT coalesce(d < 0 OR d > 50000 OR f < 0 OR t > 1, false) AS accepted
    FROM (SELECT build_id, diff_size * 200 - 1000 AS d, files_changed - 2 AS f, test_pass_rate * 1.5 AS t FROM builds)""", "builds"))
def val_ranges(spark, sf):
    return validation.validate_ranges(wild(spark, sf)).select(
        "build_id", F.array_join("errors", "; ").alias("errors"), "accepted")


@TOPIC.query("val_nonempty_ids", duck.sql("""
    SELECT build_id, trim(branch_name) AS branch_name, trim(triggered_by) AS triggered_by FROM heads
    WHERE length(trim(branch_name)) > 0 AND length(trim(triggered_by)) > 0""", "heads"))
def val_nonempty_ids(spark, sf):
    return validation.nonempty_ids(views.build_heads(spark, sf), ["branch_name", "triggered_by"]).select(
        "build_id", "branch_name", "triggered_by")



@TOPIC.query("val_clean_number", """
    SELECT l_orderkey AS build, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
           CASE WHEN l_suppkey % 10 < 4 THEN NULL WHEN l_suppkey % 10 = 4 THEN 0
                ELSE CAST(trunc(l_quantity * 1.75::DOUBLE) AS INTEGER) END AS diff_size FROM lineitem""")
def val_clean_number(spark, sf):
    kind = F.col("l_suppkey") % 10
    text = (F.when(kind == 0, "NaN").when(kind == 1, "").when(kind == 2, "inf").when(kind == 3, "12abc")
            .when(kind == 4, F.concat(F.lit("-"), (F.col("l_quantity") * 1.75).cast("string")))
            .otherwise(F.concat(F.lit(" "), (F.col("l_quantity") * 1.75).cast("string"))))
    return views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("build"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"), S.clean_count(text).alias("diff_size"))



@TOPIC.query("flt_labelled", duck.sql("""
    SELECT tenant_id, label, count(*) AS builds FROM heads WHERE label IN (0, 1) GROUP BY ALL""", "heads"))
def flt_labelled(spark, sf):
    stored = F.when(F.col("label") == 1, "1.0").when(F.col("label") == 0, "0").otherwise("pending")
    return validation.labelled(views.build_heads(spark, sf).withColumn("label", stored)).groupBy(
        "tenant_id", "label").agg(F.count(F.lit(1)).alias("builds"))


@TOPIC.query("flt_window90", duck.sql(f"""
    SELECT build_id, timestamp FROM heads WHERE label >= 0 AND timestamp >= {AS_OF} - 7776000""", "heads"))
def flt_window90(spark, sf):
    stored = F.when(F.col("label") < 0, "soon").otherwise(F.col("timestamp").cast("string"))
    return validation.recent_window(
        views.build_heads(spark, sf).withColumn("stored", F.col("timestamp")).withColumn("timestamp", stored),
        F.lit(AS_OF)).select("build_id", F.col("stored").alias("timestamp"))


@TOPIC.query("flt_eligible", duck.sql(f"""
    SELECT tenant_id, labelled, usable, reason, reason = 'eligible' AS eligible FROM (
      SELECT *, CASE WHEN tenant_id = 'demo' THEN 'demo' WHEN labelled < 200 THEN 'only ' || labelled || ' labelled builds'
          WHEN usable < 200 THEN 'insufficient data' ELSE 'eligible' END AS reason
      FROM (SELECT tenant_id, count(*) FILTER (WHERE label IN (0, 1)) AS labelled,
              count(*) FILTER (WHERE label IN (0, 1) AND timestamp >= {AS_OF} - 1500 * 86400) AS usable
            FROM heads GROUP BY tenant_id))""", "heads"))
def flt_eligible(spark, sf):
    heads = views.build_heads(spark, sf)
    marked = validation.labelled(heads)
    every = marked.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("labelled"))
    usable = validation.recent_window(marked, F.lit(AS_OF), 1500).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("usable"))
    return validation.eligibility(every, usable)


@TOPIC.query("flt_email", duck.sql("""
    SELECT tenant_id, trim(email) AS email, count(*) AS builds FROM tenants JOIN heads USING (tenant_id)
    WHERE lower(trim(email)) = 'ops@nation_7.example' GROUP BY ALL""", "tenants", "heads"))
def flt_email(spark, sf):
    found = validation.by_email(views.tenants(spark, sf), F.lit(" OPS@Nation_7.example "))
    return found.join(views.build_heads(spark, sf), "tenant_id").groupBy("tenant_id", F.trim("email").alias("email")).agg(
        F.count(F.lit(1)).alias("builds"))


@TOPIC.query("proj_override", duck.sql("""
    SELECT b.build_id, coalesce(CASE WHEN order_key % 3 = 0 THEN CAST(order_key % 500 AS INTEGER) END, b.diff_size) AS diff_size,
           CASE WHEN order_key % 3 = 0 THEN 'override' WHEN b.diff_size IS NOT NULL THEN 'measured' END AS diff_size_source,
           coalesce(CASE WHEN order_key % 2 = 0 THEN 0.5::DOUBLE END, b.test_pass_rate) AS test_pass_rate,
           CASE WHEN order_key % 2 = 0 THEN 'override' WHEN b.test_pass_rate IS NOT NULL THEN 'measured' END AS test_pass_rate_source
    FROM builds b JOIN heads USING (build_id)""", "builds", "heads"))
def proj_override(spark, sf):
    given = views.build_heads(spark, sf).select(
        "build_id", *[F.lit(None).cast("double").alias(f) for f in K.FEATURES
                      if f not in ("diff_size", "test_pass_rate")],
        F.when(F.col("order_key") % 3 == 0, (F.col("order_key") % 500).cast("int")).alias("diff_size"),
        F.when(F.col("order_key") % 2 == 0, 0.5).alias("test_pass_rate"))
    return validation.apply_overrides(views.builds(spark, sf), given, ["build_id"]).select(
        "build_id", "diff_size", "diff_size_source", "test_pass_rate", "test_pass_rate_source")


@TOPIC.query("dq_expectations", duck.sql("""
    WITH d AS (SELECT * FROM filled WHERE label IN (0, 1)),
    one AS (SELECT count(*) AS n, min(diff_size) AS diff_min, avg(label) AS risky,
        count(*) FILTER (WHERE recent_failure_rate NOT BETWEEN 0 AND 1 OR test_pass_rate NOT BETWEEN 0 AND 1) AS outside,
        avg(label) FILTER (WHERE is_hotfix = 1) AS hotfix, avg(label) FILTER (WHERE recent_failure_rate > 0.2::DOUBLE) AS high,
        count(*) FILTER (WHERE recent_failure_rate > 0.2::DOUBLE) AS n_high,
        avg(label) FILTER (WHERE day_of_week = 4 AND hour_of_day BETWEEN 16 AND 19) AS fri,
        avg(label) FILTER (WHERE day_of_week = 1 AND hour_of_day BETWEEN 9 AND 12) AS tue FROM d)
    SELECT 'row_count' AS "check", CAST(n AS DOUBLE) AS value, n > 0 AS passed FROM one
    UNION ALL SELECT 'no_nulls', 0.0, true FROM one UNION ALL SELECT 'ranges', CAST(outside AS DOUBLE), outside = 0 FROM one
    UNION ALL SELECT 'diff_size_min', CAST(diff_min AS DOUBLE), diff_min >= 1 FROM one
    UNION ALL SELECT 'risky_share', risky, risky BETWEEN 0.15::DOUBLE AND 0.45::DOUBLE FROM one
    UNION ALL SELECT 'hotfix_risky', hotfix, hotfix >= 0.55::DOUBLE FROM one
    UNION ALL SELECT 'high_failure_risky', high, n_high <= 10 OR high >= 0.55::DOUBLE FROM one
    UNION ALL SELECT 'friday_over_tuesday', fri - tue, fri > tue FROM one""", "filled"))
def dq_expectations(spark, sf):
    return validation.expectations(validation.labelled(scoring.scored(spark, sf)))


@TOPIC.query("dq_median_drift", duck.sql("WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(quantile_cont(CAST({f} AS DOUBLE), 0.5), 3) AS measured, {m}::DOUBLE AS stored FROM builds"
    for f, m in K.TRAINING_MEDIANS.items()) + """)
    SELECT *, abs(stored - measured) / greatest(abs(stored), abs(measured), 1e-6) AS relative,
        abs(stored - measured) / greatest(abs(stored), abs(measured), 1e-6) > 0.02 AS drifted FROM l
    WHERE measured IS NOT NULL""", "builds"))
def dq_median_drift(spark, sf):
    return validation.median_drift(views.builds(spark, sf)).filter(F.col("measured").isNotNull())


@TOPIC.query("redact", """
    SELECT event_id, '[REDACTED]' AS "API_Key", event_type AS endpoint, '[REDACTED]' AS slack_webhook_url,
        '[REDACTED]' AS nested_token, props AS nested_props, '[REDACTED]' AS listed_password, event_type AS listed_kind FROM events""")
def redact(spark, sf):
    """A log entry with maps inside a list inside a struct."""
    flat = F.create_map(F.lit("API_Key"), F.concat(F.lit("k"), F.col("user_id")), F.lit("endpoint"), F.col("event_type"),
                        F.lit("slack_webhook_url"), F.lit("https://hooks.example"))
    nested = F.create_map(F.lit("session-token"), F.col("user_id").cast("string"), F.lit("props"), F.col("props"))
    entry = F.struct(flat.alias("head"), nested.alias("body"), F.array(F.struct(
        F.create_map(F.lit("deep"), F.struct(F.lit("x").alias("password"), F.col("event_type").alias("kind"))).alias("inner"))).alias("list"))
    made = views.events(spark, sf).select("event_id", entry.alias("entry"))
    clean = made.select("event_id", S.redact(F.col("entry"), made.schema["entry"].dataType).alias("e"))
    inner = F.col("e.list")[0]["inner"]["deep"]
    return clean.select(
        "event_id", F.col("e.head")["API_Key"].alias("API_Key"), F.col("e.head")["endpoint"].alias("endpoint"),
        F.col("e.head")["slack_webhook_url"].alias("slack_webhook_url"), F.col("e.body")["session-token"].alias("nested_token"),
        F.col("e.body")["props"].alias("nested_props"), inner["password"].alias("listed_password"), inner["kind"].alias("listed_kind"))
