"""Newest-N reads, time-ordered and random splits, sequence numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators.ordered import newest, with_position

ORDER = ["timestamp", "build_id"]


def newest_builds(builds: DataFrame, count: int) -> DataFrame:
    """The newest builds per tenant, numbered 1.. oldest first as ``place``."""
    kept = newest(builds, ["tenant_id"], ORDER, count)
    sizes = kept.groupBy("tenant_id").agg(F.max("rank").alias("_n"))
    return kept.join(sizes, "tenant_id").withColumn("place", F.col("_n") - F.col("rank") + 1).drop("_n")


def numbered(builds: DataFrame) -> DataFrame:
    """Every build's number within its tenant, oldest 1."""
    return with_position(builds, ["tenant_id"], ORDER).withColumn("build_number", F.col("pos") + 1).drop("pos", "n")


def tail_split(builds: DataFrame, share: float = K.HOLDOUT_SHARE) -> DataFrame:
    """Hold out the newest share per tenant, at least one row; not stratified.

    Python-style half-even rounding of the held-out count.
    """
    placed = with_position(builds, ["tenant_id"], ORDER)
    held = F.greatest(F.lit(1), F.bround(F.col("n") * share, 0).cast("long"))
    cut = F.greatest(F.lit(1), F.col("n") - held)
    return placed.withColumn("held_out", F.col("pos") >= cut).drop("pos")


def shuffle_number(id_column: str, seed: int) -> Column:
    """A repeatable 60-bit number per id, the same on any engine with md5."""
    digest = F.md5(F.concat_ws("-", F.col(id_column).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def stratified_split(rows: DataFrame, keys: Sequence[str], id_column: str,
                     share: float = K.HOLDOUT_SHARE, seed: int = 42) -> DataFrame:
    """Random hold-out keeping the class ratio exact.

    Rows are ranked by a seeded hash within each class. The top bits of the hash cut a
    class into even slices, so a class with most of the rows is ranked by many tasks.
    """
    hashed = rows.withColumn("_hash", shuffle_number(id_column, seed))
    placed = with_position(hashed, keys, ["_hash", id_column], F.shiftright("_hash", 48))
    return placed.withColumn("held_out", F.col("pos") < F.bround(F.col("n") * share, 0)).drop("_hash", "pos", "n")


def folds(rows: DataFrame, id_column: str, k: int = 5, seed: int = 42) -> DataFrame:
    """A fold number per row from a seeded hash."""
    return rows.withColumn("fold", (shuffle_number(id_column, seed) % k).cast("int"))


def recent_ten(builds: DataFrame) -> DataFrame:
    return newest(builds, ["tenant_id"], ORDER, 10)


def latest(scored: DataFrame, tenants: DataFrame) -> DataFrame:
    """Connection status per tenant with its newest build; verdicts use fixed limits."""
    last = scored.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("build_count"),
        F.max_by(F.struct("build_id", "score", "job_name", "branch_name"), F.struct(*ORDER)).alias("_b"))
    joined = tenants.select("tenant_id", "ci_platform").join(last, "tenant_id", "left")
    score = F.col("_b.score")
    return joined.select(
        "tenant_id", "ci_platform", F.coalesce("build_count", F.lit(0).cast("long")).alias("build_count"),
        (F.coalesce("build_count", F.lit(0)) > 0).alias("connected"),
        F.col("_b.build_id").alias("build_id"), score.alias("score"),
        F.when(score <= K.YELLOW, "SAFE").when(score <= K.RED, "WARNING").when(score.isNotNull(), "BLOCKED").alias("verdict"),
        F.col("_b.job_name").alias("job_name"), F.col("_b.branch_name").alias("branch_name"))
