"""Resolving conflicting outcome labels by strength of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.functions import labels as L


def described(events: DataFrame) -> DataFrame:
    """Canonical source, weight and whether production was observed."""
    return (events.withColumn("label_source", L.normalise(F.col("raw_source")))
            .withColumn("sample_weight", L.weight(F.col("raw_source")))
            .withColumn("observed", L.observed(F.col("raw_source"))))


def resolve(events: DataFrame) -> DataFrame:
    """One label per build.

    Applied in order, an observed label is only replaced by another observed one and
    otherwise the later wins. That is the maximum of (observed, time, sequence), which
    Spark combines before the shuffle, so events may come in any order and a build with
    very many events is never gathered.
    """
    rank = F.struct("observed", "event_ts", "seq")
    fields = F.struct("label", "label_source", "sample_weight", F.col("observed").alias("label_observed"),
                      F.col("event_ts").alias("labelled_at"))
    return events.groupBy("build_id").agg(F.max_by(fields, rank).alias("_l")).select("build_id", "_l.*")


def status(events: DataFrame) -> DataFrame:
    """Whether each event changed its build's label, with a note when it did not.

    Once one observed event has arrived every later non-observed one is ignored, so the
    first observed event per build decides; which observed label was in force is the
    newest observed one before the event.
    """
    seen = events.filter("observed").groupBy("build_id").agg(
        F.min(F.struct("event_ts", "seq")).alias("_first"))
    late = F.coalesce(F.col("_first") < F.struct("event_ts", "seq"), F.lit(False))
    kept = late & ~F.col("observed")
    return (events.join(seen, "build_id", "left").withColumn("status", F.when(kept, "kept").otherwise("updated"))
            .withColumn("note", F.when(kept, F.concat(
                F.col("label_source"),
                F.lit(" ignored: this build's label already came from watching production"))).otherwise(""))
            .drop("_first"))


def assumed_ok(builds: DataFrame, events: DataFrame, as_of: Column, quiet_days: int = 30) -> DataFrame:
    """Builds nobody labelled within the quiet period count as fine, at low weight."""
    due = builds.filter(F.col("timestamp") <= as_of - quiet_days * 86400)
    return due.join(events.select("build_id"), "build_id", "left_anti").select(
        "tenant_id", "build_id", F.lit(0).alias("label"), F.lit("assumed_ok").alias("label_source"),
        L.weight(F.lit("assumed_ok")).alias("sample_weight"))
