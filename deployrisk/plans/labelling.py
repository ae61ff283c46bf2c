"""Label-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk.operators import labelling
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic

TOPIC = Topic()

RESOLVE_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY observed DESC, event_ts DESC, seq DESC) AS k FROM label_events)
    SELECT build_id, label, label_source, sample_weight, observed AS label_observed, event_ts AS labelled_at FROM r WHERE k = 1"""


@TOPIC.query("lbl_resolve", duck.sql(RESOLVE_SQL, "label_events"))
def lbl_resolve(spark, sf):
    return labelling.resolve(labelling.described(views.label_events(spark, sf)))


@TOPIC.query("lbl_status", duck.sql("""
    SELECT build_id, seq, CASE WHEN seen AND NOT observed THEN 'kept' ELSE 'updated' END AS status,
        CASE WHEN seen AND NOT observed THEN label_source || ' ignored: this build''s label already came from watching production' ELSE '' END AS note
    FROM (SELECT *, coalesce(bool_or(observed) OVER (PARTITION BY build_id ORDER BY event_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM label_events)""", "label_events"))
def lbl_status(spark, sf):
    return labelling.status(labelling.described(views.label_events(spark, sf))).select("build_id", "seq", "status", "note")


ASSUMED_SQL = """
    SELECT tenant_id, build_id, 0 AS label, 'assumed_ok' AS label_source, 0.4::DOUBLE AS sample_weight FROM heads
    WHERE timestamp <= 996624000 - 30 * 86400 AND build_id NOT IN (SELECT 'b' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') FROM lineitem)"""


@TOPIC.query("st_assumed_ok", duck.sql(ASSUMED_SQL, "heads"))
def st_assumed_ok(spark, sf):
    heads = views.build_heads(spark, sf)
    events = views.table(spark, sf, "lineitem").select(views.build_id_of("l_orderkey").alias("build_id"))
    return labelling.assumed_ok(heads, events, F.lit(996624000))
