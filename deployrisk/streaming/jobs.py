"""Structured Streaming jobs: scoring, labels, health windows, limits and counters.

Rows are never dropped for being late, and no window has to close. Every micro-batch is
reduced to partial results (a winning label, counts, counts per latency) in a folder named
by the batch, so a restarted job writes the same folder again. Partial results merge in any
order: labels by rank, counts by addition. Every ``FAN_IN`` folders of batches are merged into one,
as many of those into a larger one, and so on, so a read meets a number of folders that grows with the
logarithm of the batches. Which folders are merged follows from the batch number alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deployrisk import contract as K
from deployrisk.functions import labels as L
from deployrisk.functions import scalars as S
from deployrisk.operators import health, ordered
from deployrisk.session import scratch_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ORDERS = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
          "o_orderdate timestamp_ntz, o_orderpriority string")


def file_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files at ``path`` (a folder or one file) as a stream.

    A file stream takes a plain path for a folder only; written as a pattern either works.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(pattern)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, append to a parquet table and read it back."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


FAN_IN = 4


def _file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def spans(spark: SparkSession, out: str) -> list[tuple[int, int]]:
    """First and last batch of each finished folder."""
    files, path = _file_system(spark, out)
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("batches=") and _file_system(spark, f"{out}/{name}/_SUCCESS")[0].exists(_file_system(spark, f"{out}/{name}/_SUCCESS")[1]):
            first, last = name.removeprefix("batches=").split("-")
            found.append((int(first), int(last)))
    return sorted(found)


def live_spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those that lie in no other one."""
    return [s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found)]


def _folder(out: str, first: int, last: int) -> str:
    return f"{out}/batches={first}-{last}"


def _compact(spark: SparkSession, out: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], batch_id: int) -> None:
    """Merge what batch ``batch_id`` completes.

    Parts of an earlier merge are deleted only now, after that batch was committed: a batch that is run
    again still finds what it merges.
    """
    size, done = FAN_IN, batch_id + 1
    found = spans(spark, out)
    for first, last in found:
        if any(o != (first, last) and o[0] <= first and last <= o[1] and o[1] < batch_id for o in found):
            files, path = _file_system(spark, _folder(out, first, last))
            files.delete(path, True)
    while done % size == 0:
        start, step = done - size, size // FAN_IN
        parts = [p for p in spans(spark, out) if p[0] >= start and p[1] - p[0] + 1 == step]
        if parts:
            rows = spark.read.schema(schema).parquet(*(_folder(out, *p) for p in parts))
            merge(rows).select(*schema.names).write.mode("overwrite").parquet(_folder(out, start, batch_id))
        size *= FAN_IN


def fold(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Fold everything available into the partial results at ``out``; called again, it goes on from ``checkpoint``.

    ``merge`` makes partial results of partial results.
    """
    spark = stream.sparkSession
    schema = partial(spark.createDataFrame([], stream.schema)).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(_folder(out, batch_id, batch_id))
        _compact(batch.sparkSession, out, schema, merge, batch_id)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def folded(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The partial results at ``out``, still unmerged."""
    live = live_spans(spans(spark, out))
    return spark.read.schema(schema).parquet(*(_folder(out, *s) for s in live)) if live else spark.createDataFrame([], schema)


def drain_partials(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Process everything available and read the partial results back, still unmerged."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    fold(stream, partial, merge, out, scratch_path(spark, f"{name}-checkpoint"))
    return folded(spark, out, partial(spark.createDataFrame([], stream.schema)).schema)


def summed(parts: DataFrame, values: Sequence[str]) -> DataFrame:
    """Counts of the same keys added up."""
    keys = [c for c in parts.columns if c not in values]
    return parts.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


LABEL_FIELDS = ("label", "label_source", "sample_weight", "observed", "event_ts", "seq")


def _best_label(events: DataFrame) -> DataFrame:
    best = F.max_by(F.struct(*LABEL_FIELDS), F.struct("observed", "event_ts", "seq"))
    return events.groupBy("build_id").agg(best.alias("best")).select("build_id", "best.*")


def label_partials(events: DataFrame) -> DataFrame:
    """The winning label event per build in a batch.

    ``events`` has ``build_id``, ``label``, ``raw_source``, ``event_ts`` and ``seq``.
    """
    return _best_label(events.withColumn("label_source", L.normalise(F.col("raw_source")))
                       .withColumn("sample_weight", L.weight(F.col("raw_source")))
                       .withColumn("observed", L.observed(F.col("raw_source"))))


def merge_labels(parts: DataFrame) -> DataFrame:
    return _best_label(parts)


def window_start(ts: str, window: str) -> Column:
    return F.window(ts, window)["start"]


def health_partials(probes: DataFrame, window: str = f"{health.WINDOW_SECONDS} seconds") -> DataFrame:
    """How often each latency was measured per deploy, watch window and success."""
    return (health.with_ok(probes).groupBy("deploy_id", window_start("ts", window).alias("window_start"), "ok", "latency_ms")
            .agg(F.count(F.lit(1)).alias("probes")))


def merge_probes(parts: DataFrame) -> DataFrame:
    return summed(parts, ["probes"])


def merge_requests(parts: DataFrame) -> DataFrame:
    return summed(parts, ["requests"])


def merge_health(parts: DataFrame, baselines: DataFrame) -> DataFrame:
    """A health report per deploy and watch window; percentiles come from the counts."""
    keys = ["deploy_id", "window_start"]
    counted = parts.groupBy(*keys).agg(F.sum("probes").alias("total"), F.sum(F.when(~F.col("ok"), F.col("probes")).otherwise(0)).alias("errors"))
    latency = ordered.exact_quantiles(parts.filter("ok"), keys, "latency_ms", {"p50": 0.5, "p95": 0.95}, weight="probes")
    return health.judge(counted.join(latency, keys, "left").join(baselines, "deploy_id", "left"))


def request_partials(log: DataFrame, key: Column, window: str = "1 minute") -> DataFrame:
    return (log.groupBy(key.alias("limiter_key"), window_start("ts", window).alias("window_start"))
            .agg(F.count(F.lit(1)).alias("requests")))


def merge_over_limit(parts: DataFrame, limit: int = K.RATE_LIMIT_PER_MINUTE) -> DataFrame:
    """Keys with more requests than allowed in a fixed window."""
    return parts.groupBy("limiter_key", "window_start").agg(F.sum("requests").alias("requests")).filter(F.col("requests") > limit)


def over_limit(log: DataFrame, key: Column, window: str = "1 minute", limit: int = K.RATE_LIMIT_PER_MINUTE) -> DataFrame:
    """The same for a log that is complete."""
    return merge_over_limit(request_partials(log, key, window), limit)


def actor_partials(builds: DataFrame) -> DataFrame:
    return builds.groupBy("tenant_id", "actor").agg(F.count(F.lit(1)).alias("builds"))


def merge_actors(parts: DataFrame) -> DataFrame:
    """Builds per tenant and actor."""
    return parts.groupBy("tenant_id", "actor").agg(F.sum("builds").alias("builds"))


def quiet_partials(rows: DataFrame) -> DataFrame:
    """What a batch tells of each build: when it was made, and whether anyone labelled it.

    ``rows`` mixes builds (tenant_id, timestamp) and label events (neither), by build_id.
    """
    return rows.groupBy("build_id").agg(F.max("tenant_id").alias("tenant_id"), F.min("timestamp").alias("timestamp"), F.max(F.col("timestamp").isNull()).alias("labelled"))


def merge_quiet(parts: DataFrame) -> DataFrame:
    return parts.groupBy("build_id").agg(F.max("tenant_id").alias("tenant_id"), F.min("timestamp").alias("timestamp"), F.max("labelled").alias("labelled"))


def assumed_ok(parts: DataFrame, as_of: Column, quiet_days: int = 30) -> DataFrame:
    """Builds whose quiet period ended by ``as_of`` without any label, in whatever order builds and labels came.

    A label that comes after the period still takes the build out: the period ends when it is asked for, not once.
    """
    due = merge_quiet(parts).filter((F.col("timestamp") <= as_of - quiet_days * 86400) & ~F.col("labelled"))
    return due.select("tenant_id", "build_id", F.lit(0).alias("label"), F.lit("assumed_ok").alias("label_source"), L.weight(F.lit("assumed_ok")).alias("sample_weight"))


LATENCY_COUNTS = ["le_" + str(b).replace(".", "_") for b in K.LATENCY_BOUNDS]
ACCESS_KEYS = ["endpoint", "status", "window_start"]


def access_partials(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Request counts and latency buckets per endpoint, status and window."""
    counts = [F.count(F.when(F.col("seconds") <= b, 1)).alias(n) for b, n in zip(K.LATENCY_BOUNDS, LATENCY_COUNTS, strict=True)]
    return log.groupBy("endpoint", "status", window_start("ts", window).alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("seconds").alias("seconds"), *counts)


def merge_access(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*ACCESS_KEYS).agg(*[F.sum(c).alias(c) for c in ("requests", "seconds", *LATENCY_COUNTS)])


def limiter_key() -> Column:
    return S.limiter_key(F.col("api_key"), F.col("forwarded_for"))
