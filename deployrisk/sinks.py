"""Append-only tables: builds, label events, model registry, drift reports, alerts.

Nothing is rewritten in place. Current values are resolved when reading, so several
writers can append and a lost executor only repeats its own files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deployrisk.operators.labelling import described
from deployrisk.session import scratch_path


def new_table(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def append_builds(rows: DataFrame, path: str, period: str = "month") -> None:
    """Builds by tenant and ``period`` of their time; write defaults for the label fields.

    The rebalance hint makes adaptive execution split a busy tenant over many writers and
    merge small ones, so files come out evenly sized.
    """
    defaults = {"label": F.lit(-1), "label_source": F.lit("pending"), "sample_weight": F.lit(1.0)}
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    start = F.to_date(F.date_trunc(period, F.timestamp_seconds("timestamp")))
    (rows.withColumn("period", start).hint("rebalance", "tenant_id", "period")
     .write.mode("append").partitionBy("tenant_id", "period").parquet(path))


def append_label_events(events: DataFrame, path: str) -> None:
    """Outcome events with canonical source, weight and observed flag."""
    described(events).write.mode("append").parquet(path)


def append_rows(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Registry, drift-report and alert rows."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
