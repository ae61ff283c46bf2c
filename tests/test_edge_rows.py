"""Rows that the given tables do not hold: odd white space, numbers, reports and changes."""

import pytest
from pyspark.sql import functions as F

from deployrisk import session
from deployrisk.functions import scalars as S
from deployrisk.functions.text import strip
from deployrisk.operators import change, joins, validation
from deployrisk.sources import git, reports


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize("text", ["\t", "a\n", "\r\n b c \x85", "  x ", "", "\x1cq\x1f"])
def test_strip_is_pythons(spark, text):
    assert one(spark, strip("v"), text) == text.strip()


def test_ids_and_keys_with_line_breaks(spark):
    rows = spark.createDataFrame([("\t", "a"), ("x\n", "b")], "id string, other string")
    assert [tuple(r) for r in validation.nonempty_ids(rows, ["id"]).collect()] == [("x", "b")]
    tenants = spark.createDataFrame([("t1",)], "tenant_id string").withColumn("api_key_hash", F.sha2(F.lit("key"), 256))
    asked = spark.createDataFrame([("t1", "key\n"), ("t1", "no")], "tenant_id string, api_key string")
    accepted, rejected = joins.authenticate(asked, tenants)
    assert accepted.count() == 1 and rejected.count() == 1


@pytest.mark.parametrize("value", [12.34567, 0.00001, 0.0001, 0.00025, 3.0, 0.0, 1e16, 123456789.25, 1.5e-7, -2.5, 9999999.0, 12345678.0])
def test_numbers_read_as_python_prints_them(spark, value):
    assert one(spark, S.number_text(F.col("v")), value, "double") == repr(value)


def test_long_diffstat(spark):
    line = " ".join(["5"] + ["1"] * 3000)
    assert one(spark, git.diffstat_churn(F.col("v"), F.lit(1)), line) == 3000


def test_reports_are_cleaned_once_and_read_by_the_root_first(spark):
    rows = [("<testsuite name=\" tests='9' \" tests=' 3 '/>", (3, 0, 0, 0)),
            ("<?xml version='1.0'?>\n<t:TestSuites xmlns:t='u' tests='0'><t:testSuite skip='&#049;' skipped='x' tests='&#x034;'/></t:TestSuites>", (4, 0, 0, 1)),
            ("<testsuites tests='2'><testsuite tests='7'/></testsuites>", (2, 0, 0, 0)),
            ("<testsuites mytests='2'><testsuites tests='7'/></testsuites>", (None,) * 4),
            ("<testsuites \u00e9='2'><testsuite tests='7' errors='1'/></testsuites>", (7, 0, 1, 0)),
            ("<testsuite tests='3'", (None,) * 4), (None, (None,) * 4)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i long, xml string")
    read = reports.suite_counts(df, "xml")
    assert [tuple(r)[2:] for r in sorted(read.collect())] == [w for _, w in rows]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CDATA") == 1 and plan.count("from_xml") == 1


@pytest.mark.parametrize("xml,want", [
    ('<testsuite name="a > b" tests="3" failures="1"/>', (3, 1, 0, 0)),
    ('<testsuite tests="&#51;" failures=\'&#x31;\'/>', (3, 1, 0, 0)),
    ("<x:testsuites xmlns:x='u'><x:testsuite tests='2'><testsuite tests='1' errors='1'/></x:testsuite></x:testsuites>", (3, 0, 1, 0)),
    ('<testsuite tests="4"><![CDATA[<testsuite tests="9"/>]]><testcase name="a > b"/></testsuite>', (4, 0, 0, 0)),
    ('<testsuite tests="4"><broken', None),
    ("<other/>", None),
    ("", None),
])
def test_reports(spark, xml, want):
    row = reports.suite_counts(spark.createDataFrame([(xml,)], "xml string"), "xml").first()
    assert (None if row.tests is None else (row.tests, row.failures, row.errors, row.skipped)) == want


def test_change_without_files(spark):
    diffs = spark.createDataFrame([(1, ""), (2, None), (3, "diff --git a/x.py b/x.py\n@@ -1 +1 @@\n+if a:")], "change_id long, diff_text string")
    files = change.line_measures(change.classify(change.diff_files(diffs, "diff_text", ["change_id"])))
    got = {r.change_id: r for r in change.structure(files, ["change_id"]).collect()}
    assert {i: (got[i].files, got[i].added_complexity, got[i].hunk_count, got[i].languages_touched, got[i].config_file_ratio) for i in got} == {
        1: (0, 0, 0, 0, 0.0), 2: (0, 0, 0, 0, 0.0), 3: (1, 1, 1, 1, 0.0)}


def test_scratch_folder_of_a_cluster(spark):
    class Fake:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())
