"""CI payloads, history features, reports and change statistics."""

import json

import pytest
from pyspark.sql import functions as F

from deployrisk.operators import history
from deployrisk.operators.ordered import over_preceding  # noqa: F401
from deployrisk.functions import scalars as S
from deployrisk.sources import ci, git, reports

# one history: run, outcome, seconds, finish time
RUNS = [
    (41, "ok", 300, "2026-08-05T10:05:00"), (40, "bad", 240, "2026-08-05T09:04:00"),
    (39, "ok", 360, "2026-08-04T18:06:00"), (38, "none", 60, "2026-08-04T12:01:00"),
    (37, "bad", 1800, "2026-08-03T22:30:00"), (36, "ok", 240, "2026-08-03T08:04:00"),
]
RUNNING = (42, "none", 600, "2026-08-05T12:00:00")


def epoch(text):
    import datetime as dt
    return dt.datetime.fromisoformat(text + "+00:00").timestamp()


def iso(seconds, tail="Z"):
    import datetime as dt
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + tail


def payload(platform):
    rows = [RUNNING, *RUNS]
    if platform == "github":
        words = {"ok": "success", "bad": "failure", "none": "cancelled"}
        return {"workflow_runs": [{"id": n, "conclusion": words[o], "created_at": iso(epoch(t) - s), "updated_at": iso(epoch(t))}
                                  for n, o, s, t in rows]}
    if platform == "jenkins":
        words = {"ok": "SUCCESS", "bad": "UNSTABLE", "none": None}
        return {"builds": [{"number": n, "result": words[o], "duration": s * 1000, "timestamp": int((epoch(t) - s) * 1000)}
                           for n, o, s, t in rows]}
    words = {"ok": "SUCCESSFUL", "bad": "ERROR", "none": "STOPPED"}
    return {"values": [{"build_number": n, "state": {"name": "COMPLETED", "result": {"name": words[o]}},
                        "duration_in_seconds": s, "completed_on": iso(epoch(t), ".000+00:00")} for n, o, s, t in rows]}


@pytest.mark.parametrize("platform", ["github", "jenkins", "bitbucket"])
def test_three_payloads_give_one_history(spark, platform):
    reader = {"github": ci.github_runs, "jenkins": ci.jenkins_runs, "bitbucket": ci.bitbucket_runs}[platform]
    df = spark.createDataFrame([("j", "42", json.dumps(payload(platform)))], "job string, current string, body string")
    past = reader(df, "body", "current").drop("current")
    assert past.count() == 6
    assert past.filter("succeeded IS NOT NULL").count() == 5
    now = spark.createDataFrame([("j", 42, None, 600.0, epoch(RUNNING[3]))], past.select(
        "job", "run_id", "succeeded", "duration_secs", "finished_at").schema)
    row = history.ci_features(past.unionByName(now)).filter("run_id = 42").first()
    assert row.recent_failure_rate == 0.4
    assert row.build_time_delta == round((600 - 270) / 270, 4)
    assert row.days_since_deploy == round((epoch(RUNNING[3]) - epoch(RUNS[0][3])) / 86400, 3)


def test_no_history_and_only_cancelled(spark):
    rows = [("a", 1, True, 5.0, 10.0), ("b", 1, None, 5.0, 10.0), ("b", 2, True, 5.0, 20.0)]
    df = spark.createDataFrame(rows, "job string, run_id long, succeeded boolean, duration_secs double, finished_at double")
    got = {(r.job, r.run_id): r for r in history.ci_features(df).collect()}
    assert got["a", 1].recent_failure_rate is None and got["a", 1].build_time_delta is None
    assert got["b", 2].recent_failure_rate is None and got["b", 2].days_since_deploy is None


@pytest.mark.parametrize("text,want", [
    ("2026-08-06T09:12:33Z", 1786007553.0), ("2026-08-06T11:12:33+0200", 1786007553.0),
    ("2026-08-06T09:12:33.5+00:00", 1786007553.5), (" 1786007553 ", 1786007553.0), ("yesterday", None), ("", None)])
def test_epochs(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(S.epoch_seconds(F.col("t")).alias("e")).first().e
    assert got == want


XML = [
    ('<testsuite tests="10" failures="2"/>', (10, 2, 0, 0), 0.8),
    ('<testsuite tests="10" failures="1" errors="1"/>', (10, 1, 1, 0), 0.8),
    ('<testsuite tests="100" skipped="90"/>', (100, 0, 0, 90), 1.0),
    ('<testsuite tests="20" skipped="20"/>', (20, 0, 0, 20), None),
    ('<testsuites tests="10" failures="2"><testsuite tests="10" failures="9"/></testsuites>', (10, 2, 0, 0), 0.8),
    ('<testsuites><testsuite tests="6" failures="2"/><testsuite tests="4"/></testsuites>', (10, 2, 0, 0), 0.8),
    ('<testsuite tests="5" failures="9"/>', (5, 9, 0, 0), 0.0),
    ("<testsuite tests='5'", (None,) * 4, None),
    ("<html><testsuite tests='5'/></html>", (None,) * 4, None),
    ('<!-- <testsuite tests="7"/> --><testsuite tests="4.0" disabled="1"><testcase/></testsuite>', (4, 0, 0, 1), 1.0),
]


@pytest.mark.parametrize("xml,counts,rate", XML)
def test_reports(spark, xml, counts, rate):
    df = spark.createDataFrame([("b", xml)], "build string, xml string")
    read = reports.suite_counts(df, "xml")
    row = read.first()
    assert (row.tests, row.failures, row.errors, row.skipped) == counts
    assert history.report_pass_rate(read, ["build"]).first().test_pass_rate == rate


def test_two_reports_add_up(spark):
    df = spark.createDataFrame([("b", 60, 0, 0, 0), ("b", 40, 10, 0, 0)],
                               "build string, tests int, failures int, errors int, skipped int")
    assert history.report_pass_rate(df, ["build"]).first().test_pass_rate == 0.9


@pytest.mark.parametrize("path,kept", [
    ("a/junit-1.xml", True), ("TEST-x.xml", True), ("m/test-results/u/x.xml", True), ("x/surefire-reports/y.xml", True),
    ("reports/x.xml", True), ("deep/reports/a/b.xml", True), ("pytest.xml", True), ("pom.xml", False), ("a/test-resultsx/b.xml", False)])
def test_report_globs(path, kept):
    import re
    assert bool(re.match(reports.glob_pattern(), path)) is kept


@pytest.mark.parametrize("branch,want", [
    ("hotfix/payments", 1), ("HOTFIX-123", 1), ("revert-bad-deploy", 1), ("emergency", 1), ("release/2.1-patch", 1),
    ("feature/new-dashboard", 0), ("main", 0), ("", 0), (None, 0)])
def test_hotfix_branches(spark, branch, want):
    df = spark.createDataFrame([(branch,)], "b string")
    assert df.select(S.hotfix_flag(F.col("b")).alias("h")).first().h == want


def test_numstat_and_diffstat(spark):
    text = "12\t3\ta.py\n-\t-\timg.png\nnoise\n7\t0\tb c.txt\n"
    row = git.numstat_text_counts(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row.churn, row.files) == (22, 3)
    line = spark.createDataFrame([("5 files changed, 847 insertions(+), 12 deletions(-)",), ("none",)], "t string")
    got = line.select(git.diffstat_churn(F.col("t"), F.lit(5)).alias("c"), git.diffstat_files(F.col("t")).alias("f")).collect()
    assert [(r.c, r.f) for r in got] == [(859, 5), (100, 5)]


def test_commit_mapping_and_leak_guard(spark):
    rows = [("a1", "x", True, False, 2015, 100, 200, 50, 3, 4, 1.0), ("a2", "x", False, False, 2016, 200, 10, 5, 1, 5, 2.0),
            ("a3", "x", True, True, 2017, 300, 1, 1, 1, 6, 0.5), ("b1", "y", False, False, 2015, 50, 400, 100, 9, 1, 9.0)]
    df = spark.createDataFrame(rows, "commit_id string, project string, buggy boolean, fix boolean, year int, author_date long, "
                                     "la int, ld int, nf int, aexp int, age double")
    got = {r.commit_id: r for r in history.commit_features(df).collect()}
    assert got["a1"].diff_size == 250 and got["b1"].diff_size == 500
    assert [got[c].is_hotfix for c in ("a1", "a2", "a3")] == [0, 0, 1]
    assert got["a1"].recent_failure_rate is None and got["b1"].recent_failure_rate is None
    assert got["a2"].recent_failure_rate == 1.0 and got["a3"].recent_failure_rate == 0.5
    assert all(r.test_pass_rate is None and r.build_time_delta is None for r in got.values())


def test_median_before_against_plain_python():
    import statistics

    import numpy as np

    from deployrisk.operators.impute import median_before
    rng = np.random.default_rng(4)
    values, known = np.round(rng.normal(0, 3, 300), 1), rng.random(300) < 0.6
    found, enough = median_before(values, known, 50, 5)
    for i in range(300):
        before = [float(values[j]) for j in range(max(0, i - 50), i) if known[j]]
        assert enough[i] == (len(before) >= 5)
        assert not enough[i] or found[i] == pytest.approx(statistics.median(before))
    assert not median_before(np.zeros(4), np.zeros(4, bool), 50, 1)[1].any()
