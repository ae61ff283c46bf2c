"""CI server payloads to one table of runs.

Each reader takes a DataFrame with a JSON text column and returns one row per past
run: ``run_id, succeeded, duration_secs, finished_at`` plus the input's other columns.
``current`` names a column with the running build's id, which is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.functions.scalars import epoch_seconds
from deployrisk.operators.history import exclude_current, native_pass_rate, outcome

GITHUB_SCHEMA = ("struct<workflow_runs:array<struct<id:bigint,run_number:int,status:string,"
                 "conclusion:string,created_at:string,updated_at:string>>>")
JENKINS_SCHEMA = "struct<builds:array<struct<number:int,result:string,duration:bigint,timestamp:bigint>>>"
BITBUCKET_SCHEMA = ("struct<values:array<struct<build_number:int,"
                    "state:struct<name:string,result:struct<name:string>>,"
                    "duration_in_seconds:bigint,created_on:string,completed_on:string>>>")
TEST_SCHEMA = "struct<passCount:int,failCount:int,skipCount:int>"


def _explode(df: DataFrame, payload: str, schema: str, field: str) -> DataFrame:
    parsed = F.from_json(F.col(payload), schema)
    rest = [c for c in df.columns if c != payload]
    return df.select(*rest, F.explode(parsed[field]).alias("_run"))


def _finish(df: DataFrame, rest: list[str], current: str | None, run_id: Column, succeeded: Column,
            duration: Column, finished: Column) -> DataFrame:
    out = df.select(*rest, run_id.alias("run_id"), succeeded.alias("succeeded"),
                    duration.alias("duration_secs"), finished.alias("finished_at"))
    return exclude_current(out, F.col(current)) if current else out


def github_runs(df: DataFrame, payload: str, current: str | None = None) -> DataFrame:
    """Workflow-run pages. Duration is last update minus creation, when positive."""
    rest = [c for c in df.columns if c != payload]
    runs = _explode(df, payload, GITHUB_SCHEMA, "workflow_runs")
    created, updated = epoch_seconds(F.col("_run.created_at")), epoch_seconds(F.col("_run.updated_at"))
    return _finish(runs, rest, current, F.col("_run.id"), outcome(F.lit("github"), F.col("_run.conclusion")),
                   F.when(updated > created, updated - created), updated)


def jenkins_runs(df: DataFrame, payload: str, current: str | None = None) -> DataFrame:
    """Build pages in milliseconds; finished = start + duration."""
    rest = [c for c in df.columns if c != payload]
    runs = _explode(df, payload, JENKINS_SCHEMA, "builds")
    duration, finished = ms_times(F.col("_run.timestamp"), F.col("_run.duration"))
    return _finish(runs, rest, current, F.col("_run.number").cast("long"),
                   outcome(F.lit("jenkins"), F.col("_run.result")), duration, finished)


def ms_times(start_ms: Column, duration_ms: Column) -> tuple[Column, Column]:
    """Seconds and finish time from milliseconds; zero counts as unknown."""
    duration = F.when(duration_ms != 0, duration_ms / F.lit(1000.0))
    return duration, F.when(start_ms != 0, start_ms / F.lit(1000.0) + F.coalesce(duration, F.lit(0.0)))


def bitbucket_runs(df: DataFrame, payload: str, current: str | None = None) -> DataFrame:
    """Run pages with a nested result name; completion time, else creation time."""
    rest = [c for c in df.columns if c != payload]
    runs = _explode(df, payload, BITBUCKET_SCHEMA, "values")
    seconds = F.col("_run.duration_in_seconds")
    return _finish(
        runs, rest, current, F.col("_run.build_number").cast("long"),
        outcome(F.lit("bitbucket"), F.col("_run.state.result.name")),
        F.when(seconds != 0, seconds.cast("double")),
        epoch_seconds(F.coalesce(F.col("_run.completed_on"), F.col("_run.created_on"))))


def jenkins_tests(df: DataFrame, payload: str) -> DataFrame:
    """Native test counts to a pass rate; skipped tests do not count."""
    rest = [c for c in df.columns if c != payload]
    parsed = df.select(*rest, F.from_json(payload, TEST_SCHEMA).alias("_t"))
    return parsed.select(*rest, F.col("_t.passCount").alias("passed"), F.col("_t.failCount").alias("failed"),
                         native_pass_rate(F.col("_t.passCount"), F.col("_t.failCount")).alias("test_pass_rate"))
