"""Features measured from CI history, test reports and change statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import scalars as S
from deployrisk.operators.ordered import over_preceding, with_position

# platform status -> outcome; anything else says nothing (fixed values)
PASSED = {"github": ["success"], "jenkins": ["SUCCESS"], "bitbucket": ["SUCCESSFUL"]}
FAILED = {
    "github": ["failure", "timed_out"],
    "jenkins": ["FAILURE", "UNSTABLE"],
    "bitbucket": ["FAILED", "ERROR"],
}


def outcome(platform: Column, status: Column) -> Column:
    """True passed, False failed, null undecided. Only GitHub statuses are case-exact."""
    text = F.when(platform == "github", status).otherwise(F.upper(status))
    passed, failed = F.lit(False), F.lit(False)
    for name in PASSED:
        passed = passed | ((platform == name) & text.isin(*PASSED[name]))
        failed = failed | ((platform == name) & text.isin(*FAILED[name]))
    return F.when(passed, True).when(failed, False)


def exclude_current(runs: DataFrame, current: Column) -> DataFrame:
    """The running build is never part of its own history."""
    return runs.filter(current.isNull() | (F.col("run_id").cast("string") != current.cast("string")))


def ci_features(runs: DataFrame, keys: Sequence[str] = ("job",), order: Sequence[str] = ("finished_at", "run_id"),
                look_back: int = K.HISTORY_RUNS) -> DataFrame:
    """Failure rate, days since success and duration delta from the runs before each run.

    ``runs`` has ``succeeded``, ``duration_secs`` and ``finished_at``.
    """
    decided = F.col("succeeded").isNotNull()
    usable = F.when(F.col("duration_secs") > 0, F.col("duration_secs"))
    seen = over_preceding(runs, keys, order, look_back, {
        "recent_failure_rate": F.avg(F.when(decided, (~F.col("succeeded")).cast("double"))),
        "_last_success": F.max(F.when(F.col("succeeded"), F.col("finished_at"))),
        "_typical": F.percentile(usable, F.lit(0.5)),
    })
    days = F.greatest(F.lit(0.0), (F.col("finished_at") - F.col("_last_success")) / 86400.0)
    now = F.col("duration_secs")
    return (seen.withColumn("recent_failure_rate", F.round("recent_failure_rate", 4))
            .withColumn("days_since_deploy", F.when(F.col("_last_success").isNotNull(), F.round(days, 3)))
            .withColumn("build_time_delta", F.when(
                (now > 0) & (F.col("_typical") > 0), F.round((now - F.col("_typical")) / F.col("_typical"), 4)))
            .drop("_last_success", "_typical", "pos"))


def ci_features_v1(runs: DataFrame, keys: Sequence[str] = ("job",),
                   order: Sequence[str] = ("finished_at", "run_id")) -> DataFrame:
    """Superseded variants with optimistic defaults.

    Failure rate over all of the last ten runs (only plain failures count), days since
    the last success ever, and delta against the mean of up to nineteen earlier runs.
    """
    failed = F.col("status").isin("failure", "FAILURE", "FAILED").cast("double")
    usable = F.when(F.col("duration_secs") > 0, F.col("duration_secs"))
    longer = over_preceding(runs, keys, order, 19, {
        "_fails": (10, F.avg(failed)), "_mean": F.avg(usable), "_rows": F.count(F.lit(1))}).drop("pos")
    now = F.col("duration_secs")
    delta = F.when((F.col("_rows") >= 2) & (now > 0) & (F.col("_mean") > 0),
                   F.round((now - F.col("_mean")) / F.col("_mean"), 3)).otherwise(F.lit(0.0))
    return (longer.withColumn("recent_failure_rate_v1", F.round(F.coalesce("_fails", F.lit(0.0)), 3))
            .withColumn("build_time_delta_v1", delta).drop("_fails", "_mean", "_rows"))


def days_since_success_v1(runs: DataFrame, as_of: Column, keys: Sequence[str] = ("job",)) -> DataFrame:
    """Days from a job's last success to ``as_of``; a week when it never passed."""
    last = runs.groupBy(*keys).agg(F.max(F.when(F.col("succeeded"), F.col("finished_at"))).alias("_last"))
    days = F.greatest(F.lit(0.0), F.round((as_of - F.col("_last")) / 86400.0, 1))
    return last.select(*keys, F.coalesce(days, F.lit(7.0)).alias("days_since_deploy_v1"))


def native_pass_rate(passed: Column, failed: Column) -> Column:
    """Skipped tests do not count; null without any run test."""
    ran = F.coalesce(passed, F.lit(0)) + F.coalesce(failed, F.lit(0))
    return F.when(ran > 0, F.round(F.coalesce(passed, F.lit(0)) / ran, 4))


def pass_rate_v1(passed: Column, failed: Column, skipped: Column) -> Column:
    """Superseded: skipped tests in the denominator, 1.0 when nothing ran."""
    total = passed + failed + skipped
    return F.when(total > 0, F.round(passed / total, 3)).otherwise(F.lit(1.0))


def report_pass_rate(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass rate per build over all its test reports with counts."""
    usable = F.col("tests") > 0

    def total(c: str) -> Column:
        return F.sum(F.when(usable, F.col(c)).otherwise(0))

    summed = reports.groupBy(*keys).agg(
        *[total(c).alias(c) for c in ("tests", "failures", "errors", "skipped")],
        F.count(F.when(usable, 1)).alias("reports"))
    ran = F.col("tests") - F.col("skipped")
    passed = F.greatest(F.lit(0), ran - F.col("failures") - F.col("errors"))
    return summed.withColumn("test_pass_rate", F.when(
        (F.col("tests") > 0) & (ran > 0), F.round(F.least(F.lit(1.0), passed / ran), 4)))


def pick_pass_rate(native: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Native rate first, else the report rate; says which."""
    joined = native.select(key, F.col("test_pass_rate").alias("_native")).join(
        reports.select(key, F.col("test_pass_rate").alias("_junit")), key, "full")
    return joined.select(
        key, F.coalesce("_native", "_junit").alias("test_pass_rate"),
        F.when(F.col("_native").isNotNull(), "ci-api").when(F.col("_junit").isNotNull(), "junit-xml")
        .alias("source"))


def change_stats(raw: DataFrame, substantive: DataFrame, key: str) -> DataFrame:
    """Substantive churn and files, the share that was formatting, and a note.

    Both inputs have ``key``, ``churn`` and ``files``; ``substantive`` ignores whitespace.
    """
    joined = substantive.join(raw.select(key, F.col("churn").alias("raw_churn")), key, "left")
    share = F.bround((1 - F.col("churn") / F.col("raw_churn")) * 100, 0).cast("int")
    note = (F.when(F.col("raw_churn") > F.col("churn"), F.concat(
        share.cast("string"), F.lit("% of "), F.format_number("raw_churn", 0),
        F.lit(" changed lines are formatting only, not counted")))
        .when((F.col("churn") == 0) & (F.col("files") == 0), "no changes").otherwise(""))
    ratio = F.when(F.col("raw_churn") > 0, F.round(F.greatest(
        F.lit(0.0), 1.0 - F.col("churn") / F.col("raw_churn")), 4))
    return joined.select(key, F.col("churn").alias("diff_size"), F.col("files").alias("files_changed"),
                         "raw_churn", ratio.alias("formatting_ratio"), note.alias("note"))


def actor_builds_v1(builds: DataFrame) -> DataFrame:
    """Superseded experience: all rows of the actor, at least one."""
    return builds.groupBy("tenant_id", "actor").agg(
        F.greatest(F.lit(1), F.count(F.lit(1))).alias("deployer_exp_v1"))


def measured_split(df: DataFrame) -> DataFrame:
    """Names of measured and unknown features per row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("value")) for f in K.FEATURES])
    known = F.filter(pairs, lambda p: p["value"].isNotNull())
    unknown = F.filter(pairs, lambda p: p["value"].isNull())
    return df.withColumn("measured", F.transform(known, lambda p: p["name"])).withColumn(
        "unknown", F.transform(unknown, lambda p: p["name"]))


def commit_features(commits: DataFrame) -> DataFrame:
    """Commit metrics as the ten features; the two CI features stay null."""
    rated = rolling_bug_rate(commits)
    at = F.timestamp_seconds("author_date")
    return rated.select(
        "commit_id", "project", "buggy", "year", "author_date",
        (F.col("la") + F.col("ld")).alias("diff_size"),
        F.col("nf").alias("files_changed"),
        F.hour(at).alias("hour_of_day"),
        F.weekday(at).alias("day_of_week"),
        "recent_failure_rate",
        F.lit(None).cast("double").alias("test_pass_rate"),
        F.col("fix").cast("int").alias("is_hotfix"),
        F.col("aexp").alias("deployer_exp"),
        F.col("age").alias("days_since_deploy"),
        F.lit(None).cast("double").alias("build_time_delta"))


def rolling_bug_rate(commits: DataFrame) -> DataFrame:
    """Share of the project's ten commits before this one that were buggy; own row left out."""
    return over_preceding(commits, ["project"], ["author_date", "commit_id"], K.HISTORY_RUNS, {
        "recent_failure_rate": F.avg(F.col("buggy").cast("double"))}).drop("pos")


def describe_commits(commits: DataFrame) -> DataFrame:
    return commits.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("project").alias("projects"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.avg(F.col("buggy").cast("double")).alias("base_rate"))


def split_by_year(commits: DataFrame, through: int = K.TRAIN_THROUGH_YEAR) -> DataFrame:
    return commits.withColumn("part", F.when(F.col("year") <= through, "train").otherwise("test"))


def clock_features(at: Column) -> tuple[Column, Column]:
    """Hour, and weekday with Monday 0."""
    return F.hour(at), F.weekday(at)


