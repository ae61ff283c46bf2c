"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators import health, joins, labelling, scoring
from deployrisk.plans import duck, views
from deployrisk.plans.filters import AS_OF
from deployrisk.plans.registry import Topic

TOPIC = Topic()


def requests(spark, sf):
    """One scoring request per build; some carry a wrong or no key."""
    k = F.col("order_key")
    nation = F.when(F.col("tenant_id") == "demo", "0").otherwise(
        F.substring("tenant_id", 2, 9).cast("int").cast("string"))
    key = (F.when(k % 7 == 0, "wrong").when(k % 11 == 0, "").otherwise(F.concat(F.lit(" key-"), nation, F.lit(" "))))
    return views.build_heads(spark, sf).select("build_id", "tenant_id", key.alias("api_key"))


AUTH_SQL = """
    SELECT build_id, tenant_id FROM heads WHERE {0} (tenant_id = 'demo' OR (order_key % 7 <> 0 AND order_key % 11 <> 0))"""


@TOPIC.query("join_auth", duck.sql(AUTH_SQL.format(""), "heads"))
def join_auth(spark, sf):
    accepted, _ = joins.authenticate(requests(spark, sf), views.tenants(spark, sf))
    return accepted.select("build_id", "tenant_id")


@TOPIC.query("join_auth_rejected", duck.sql(AUTH_SQL.format("NOT"), "heads"))
def join_auth_rejected(spark, sf):
    _, rejected = joins.authenticate(requests(spark, sf), views.tenants(spark, sf))
    return rejected.select("build_id", "tenant_id")


@TOPIC.query("join_settings", duck.sql("""
    SELECT build_id, coalesce(threshold_yellow, 40) AS threshold_yellow, coalesce(threshold_red, 70) AS threshold_red
    FROM heads LEFT JOIN tenants USING (tenant_id)""", "heads", "tenants"))
def join_settings(spark, sf):
    return scoring.with_settings(views.build_heads(spark, sf), views.tenants(spark, sf)).select(
        "build_id", "threshold_yellow", "threshold_red")


def outcome_events(spark, sf):
    """An outcome per order line; lines of every ninth order name an unknown build."""
    k = F.col("l_orderkey")
    return views.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("outcome")).select(
        F.when(k % 9 == 0, F.concat(F.lit("x"), k)).otherwise(views.build_id_of("l_orderkey")).alias("build_id"), "outcome")


OUTCOMES_SQL = """WITH o AS (SELECT CASE WHEN l_orderkey % 9 = 0 THEN 'x' || l_orderkey ELSE 'b' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') END AS build_id,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS outcome FROM lineitem GROUP BY l_orderkey)"""


@TOPIC.query("join_label", duck.sql(OUTCOMES_SQL + """
    SELECT build_id, tenant_id, outcome FROM heads JOIN o USING (build_id)""", "heads"))
def join_label(spark, sf):
    found, _ = joins.label_builds(views.build_heads(spark, sf), outcome_events(spark, sf))
    return found.select("build_id", "tenant_id", "outcome")


@TOPIC.query("join_label_unknown", duck.sql(OUTCOMES_SQL + """
    SELECT build_id, outcome FROM o WHERE build_id NOT IN (SELECT build_id FROM heads)""", "heads"))
def join_label_unknown(spark, sf):
    _, unknown = joins.label_builds(views.build_heads(spark, sf), outcome_events(spark, sf))
    return unknown


@TOPIC.query("join_phase", duck.sql("""
    SELECT build_id, CASE WHEN model_phase = 'tenant' AND tenant_id <> 'demo' THEN 'v-' || tenant_id ELSE 'base' END AS version,
           CASE WHEN model_phase = 'tenant' AND tenant_id <> 'demo' THEN 'tenant' ELSE 'base' END AS model_phase
    FROM heads LEFT JOIN tenants USING (tenant_id)""", "heads", "tenants"))
def join_phase(spark, sf):
    live = views.tenants(spark, sf).filter("model_phase = 'tenant' OR tenant_id = 'demo'").select(
        "tenant_id", F.concat(F.lit("v-"), F.col("tenant_id")).alias("version"))
    return joins.model_for_tenant(views.build_heads(spark, sf), live).select("build_id", "version", "model_phase")


@TOPIC.query("join_baseline", duck.sql("""
    WITH b AS (SELECT deploy_id, quantile_cont(latency_ms, 0.5) AS baseline_p50 FROM probes
        WHERE phase = 'baseline' AND status >= 200 AND status < 400 GROUP BY deploy_id)
    SELECT probe_id, deploy_id, latency_ms, baseline_p50 FROM probes LEFT JOIN b USING (deploy_id) WHERE phase = 'watch'""", "probes"))
def join_baseline(spark, sf):
    samples = health.with_ok(views.probes(spark, sf))
    baseline = health.baseline(samples.filter("phase = 'baseline'"))
    return samples.filter("phase = 'watch'").join(baseline, "deploy_id", "left").select(
        "probe_id", "deploy_id", "latency_ms", "baseline_p50")


@TOPIC.query("join_incumbent", duck.sql(f"""
    WITH c AS (SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE timestamp >= {AS_OF} - 3650::BIGINT * 86400) AS u
        FROM builds WHERE label >= 0 AND tenant_id <> 'demo' GROUP BY tenant_id)
    SELECT tenant_id, greatest(1, round_even(u * 0.2::DOUBLE, 0))::BIGINT AS rows, true AS both_scored FROM c WHERE n >= {K.MIN_BUILDS} AND u >= {K.MIN_BUILDS}""", "builds"))
def join_incumbent(spark, sf):
    """Held-out rows of each trained tenant under last night's model and under tonight's."""
    from deployrisk.plans.training import nightly
    first, _ = nightly(spark, sf)
    second, _ = nightly(spark, sf, "v2", spark.read.parquet(first["models"]))
    both = spark.read.parquet(second["predictions"])
    scored = F.coalesce(F.col("p").between(0, 1) & F.col("p_old").between(0, 1), F.lit(False))
    return both.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(scored).alias("both_scored"))


@TOPIC.query("join_followup", duck.sql("""
    SELECT a.build_id, a.tenant_id, a.timestamp FROM heads a WHERE EXISTS (
        SELECT 1 FROM heads b WHERE b.tenant_id = a.tenant_id AND b.is_hotfix = 1
          AND b.timestamp > a.timestamp AND b.timestamp <= a.timestamp + 4 * 3600)""", "heads"))
def join_followup(spark, sf):
    heads = views.build_heads(spark, sf)
    return joins.followed_up(heads, heads.filter("is_hotfix = 1"), 4).select("build_id", "tenant_id", "timestamp")


def model_registry(spark, sf):
    """A promotion history per tenant: one candidate per build year, promoted when most builds held."""
    heads = views.build_heads(spark, sf).filter("label >= 0")
    yearly = heads.groupBy("tenant_id", F.year("order_date").alias("year")).agg(
        F.round(1 - F.avg("label"), 4).alias("precision"), F.max("timestamp").alias("trained_at"))
    return yearly.select("tenant_id", F.concat(F.lit("v"), F.col("year")).alias("version"), "precision",
                         "trained_at", (F.col("precision") >= 0.5).alias("promoted"))


REGISTRY_SQL = """WITH r AS (SELECT tenant_id, 'v' || year(order_date) AS version, round(1 - avg(label), 4) AS precision,
        max(timestamp) AS trained_at FROM heads WHERE label >= 0 GROUP BY tenant_id, year(order_date)),
    live AS (SELECT tenant_id, precision, trained_at, version FROM r WHERE precision >= 0.5
        QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY trained_at DESC, version DESC) = 1)"""


@TOPIC.query("sink_tenant_meta", duck.sql(REGISTRY_SQL + """
    SELECT tenant_id, CASE WHEN trained_at IS NULL THEN 'base' ELSE 'tenant' END AS model_phase,
        coalesce(precision, 0.851::DOUBLE) AS model_precision, trained_at AS last_retrain
    FROM tenants LEFT JOIN live USING (tenant_id)""", "heads", "tenants"))
def sink_tenant_meta(spark, sf):
    return joins.tenant_meta(views.tenants(spark, sf), model_registry(spark, sf))


@TOPIC.query("sink_label_upsert", duck.sql("""
    WITH r AS (SELECT build_id, label, label_source, sample_weight, observed, row_number() OVER (
        PARTITION BY build_id ORDER BY observed DESC, event_ts DESC, seq DESC) AS k FROM label_events)
    SELECT build_id, label, label_source, sample_weight, observed AS label_observed FROM r WHERE k = 1""", "label_events"))
def sink_label_upsert(spark, sf):
    from deployrisk import sinks
    path = sinks.new_table(spark, "label_events")
    sinks.append_label_events(views.label_events(spark, sf), path)
    stored = spark.read.parquet(path)
    return labelling.resolve(stored).select("build_id", "label", "label_source", "sample_weight", "label_observed")
