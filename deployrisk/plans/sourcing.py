"""Source and sink queries: the tables are written in the source's own format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk import sinks
from deployrisk.operators import drift
from deployrisk.plans import duck, views
from deployrisk.plans.evaluation import DRIFT_SQL
from deployrisk.plans.registry import Topic
from deployrisk.plans.scoring import scored
from deployrisk.sources import builds as B
from deployrisk.sources import ci, git, reports

TOPIC = Topic()

STORED = ["tenant_id", "build_id", "timestamp", *K.FEATURES, "label"]


def number():
    return F.substring("build_id", 2, 20).cast("long")


def stored_builds(spark, sf):
    return views.builds(spark, sf).select(*STORED)


def written_json(spark, sf, rows=None):
    """Builds as JSON lines; every fiftieth object is cut off."""
    rows = stored_builds(spark, sf) if rows is None else rows
    path = sinks.new_table(spark, "builds-json")
    text = F.to_json(F.struct(*STORED))
    rows.select(F.when(number() % 50 == 0, F.substring(text, 1, 25)).otherwise(text).alias("value")).write.text(path)
    return path


def written_csv(spark, sf, rows=None):
    """Builds as CSV; labels are mixed text."""
    rows = stored_builds(spark, sf) if rows is None else rows
    path = sinks.new_table(spark, "builds-csv")
    label = F.when(F.col("label") == 1, "1.0").when(F.col("label") == 0, "0").otherwise("pending")
    rows.withColumn("label", label).write.option("header", True).csv(path)
    return path


BACK = "tenant_id, build_id, timestamp, diff_size, test_pass_rate, build_time_delta"
BACK_COLUMNS = BACK.split(", ")


@TOPIC.query("src_builds_json", duck.sql(f"""
    SELECT {BACK}, label FROM builds WHERE CAST(substr(build_id, 2) AS BIGINT) % 50 <> 0""", "builds"))
def src_builds_json(spark, sf):
    return B.builds_json(spark, written_json(spark, sf)).select(*BACK_COLUMNS, "label")


@TOPIC.query("src_builds_csv", duck.sql(f"""
    SELECT {BACK}, CASE WHEN label >= 0 THEN label END AS label FROM builds""", "builds"))
def src_builds_csv(spark, sf):
    return B.builds_csv(spark, written_csv(spark, sf), STORED).select(*BACK_COLUMNS, "label")


def halves(spark, sf):
    """New builds as JSON, old ones as CSV with fewer columns."""
    rows = stored_builds(spark, sf)
    new = rows.filter(F.col("timestamp") >= 900000000)
    old = rows.filter(F.col("timestamp") < 900000000)
    return (B.builds_json(spark, written_json(spark, sf, new)),
            B.builds_csv(spark, written_csv(spark, sf, old), STORED).drop("build_time_delta"))


@TOPIC.query("src_builds_union", duck.sql("""
    SELECT tenant_id, build_id, timestamp, diff_size, test_pass_rate, CASE WHEN timestamp >= 900000000 THEN build_time_delta END AS build_time_delta
    FROM builds WHERE timestamp < 900000000 OR CAST(substr(build_id, 2) AS BIGINT) % 50 <> 0""", "builds"))
def src_builds_union(spark, sf):
    return B.union_builds(*halves(spark, sf)).select(*BACK_COLUMNS)


@TOPIC.query("src_builds_fallback", duck.sql("""
    SELECT tenant_id, build_id, timestamp, diff_size, test_pass_rate, CASE WHEN mig THEN build_time_delta END AS build_time_delta FROM (
      SELECT *, tenant_id < 't13' AND tenant_id <> 'demo' AS mig FROM builds)
    WHERE (mig AND timestamp >= 900000000 AND CAST(substr(build_id, 2) AS BIGINT) % 50 <> 0) OR (NOT mig AND timestamp < 900000000)""", "builds"))
def src_builds_fallback(spark, sf):
    current, legacy = halves(spark, sf)
    migrated = current.filter((F.col("tenant_id") < "t13") & (F.col("tenant_id") != "demo"))
    return B.fallback_builds(migrated, legacy).select(*BACK_COLUMNS)


@TOPIC.query("src_tenants", duck.sql("""
    SELECT tenant_id, lower(trim(email)) AS email, slack_webhook, model_phase, count(build_id) AS builds FROM tenants LEFT JOIN heads USING (tenant_id) GROUP BY ALL""", "tenants", "heads"))
def src_tenants(spark, sf):
    path = sinks.new_table(spark, "tenants")
    views.tenants(spark, sf).write.parquet(path)
    counts = views.build_heads(spark, sf).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("builds"))
    return B.tenants(spark, path).join(counts, "tenant_id", "left").select(
        "tenant_id", F.lower(F.trim("email")).alias("email"), "slack_webhook", "model_phase",
        F.coalesce("builds", F.lit(0).cast("long")).alias("builds"))


def payload_runs(spark, sf, platform):
    return views.ci_runs(spark, sf).filter(F.col("platform") == platform).withColumn(
        "current", F.col("run_id") + 1000000)


# half a second is lost where a format only has whole seconds or milliseconds
RUN_SQL = """SELECT run_id, succeeded, {0} AS duration_secs, {1} AS finished_at FROM ci_runs WHERE platform = '{2}'"""


@TOPIC.query("src_github_runs", duck.sql(RUN_SQL.format(
    "CASE WHEN duration_secs >= 1 THEN floor(finished_at) - floor(finished_at - floor(duration_secs)) END", "floor(finished_at)", "github"), "ci_runs"))
def src_github_runs(spark, sf):
    runs = payload_runs(spark, sf, "github")
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    done = F.timestamp_micros((F.col("finished_at") * 1000000).cast("long"))
    started = F.timestamp_micros(((F.col("finished_at") - F.floor(F.coalesce("duration_secs", F.lit(0.0)))) * 1000000).cast("long"))

    def run(run_id):
        return F.struct(run_id.alias("id"), F.lit("completed").alias("status"), F.col("status").alias("conclusion"),
                        F.date_format(started, iso).alias("created_at"), F.date_format(done, iso).alias("updated_at"))

    pages = runs.select("current", F.to_json(F.struct(F.array(
        run(F.col("current")), run(F.col("run_id"))).alias("workflow_runs"))).alias("payload"))
    return ci.github_runs(pages, "payload", "current").drop("current")


@TOPIC.query("src_jenkins_builds", duck.sql(RUN_SQL.format(
    "duration_secs", "epoch_ms(to_timestamp(CAST(run_id AS DOUBLE))) / 1000.0::DOUBLE + coalesce(duration_secs, 0)", "jenkins"), "ci_runs"))
def src_jenkins_builds(spark, sf):
    runs = payload_runs(spark, sf, "jenkins")

    def build(number):
        return F.struct(number.cast("int").alias("number"), F.lower("status").alias("result"),
                        F.coalesce(F.round(F.col("duration_secs") * 1000, 0).cast("long"), F.lit(0).cast("long")).alias("duration"),
                        (F.col("run_id") * 1000).alias("timestamp"))

    pages = runs.select("current", F.to_json(F.struct(F.array(
        build(F.col("current")), build(F.col("run_id"))).alias("builds"))).alias("payload"))
    rows = ci.jenkins_runs(pages, "payload", "current").drop("current")
    return rows.withColumn("finished_at", F.coalesce("finished_at", F.lit(0.0) + F.coalesce("duration_secs", F.lit(0.0))))


@TOPIC.query("src_bitbucket", duck.sql(RUN_SQL.format(
    "CASE WHEN floor(duration_secs) > 0 THEN floor(duration_secs) END", "round(finished_at, 3)", "bitbucket"), "ci_runs"))
def src_bitbucket(spark, sf):
    runs = payload_runs(spark, sf, "bitbucket")
    stamp = F.date_format(F.timestamp_micros(F.round(F.col("finished_at") * 1000, 0).cast("long") * 1000),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")

    def item(number):
        return F.struct(
            number.cast("int").alias("build_number"),
            F.struct(F.lit("COMPLETED").alias("name"), F.struct(F.col("status").alias("name")).alias("result")).alias("state"),
            F.floor("duration_secs").alias("duration_in_seconds"), F.lit("2020-01-01T00:00:00.0+00:00").alias("created_on"),
            stamp.alias("completed_on"))

    pages = runs.select("current", F.to_json(F.struct(F.array(
        item(F.col("current")), item(F.col("run_id"))).alias("values"))).alias("payload"))
    return ci.bitbucket_runs(pages, "payload", "current").drop("current").withColumn(
        "finished_at", F.round("finished_at", 3))


@TOPIC.query("src_numstat", """
    SELECT l_orderkey AS change_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, CAST(l_quantity AS BIGINT) + l_partkey % 40 AS churn, 2::BIGINT AS files FROM lineitem""")
def src_numstat(spark, sf):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lines = views.spread(views.table(spark, sf, "lineitem").select(*columns)).select(
        F.col("l_orderkey").alias("change_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.concat(F.lit("warning: LF\n"), F.col("l_quantity").cast("int"), F.lit("\t"), F.col("l_partkey") % 40,
                 F.lit("\tsrc/m.py\n-\t-\timg/p.png\n")).alias("numstat"))
    return git.numstat_text_counts(lines, "numstat").drop("numstat")


@TOPIC.query("src_diffstat_line", duck.sql("""
    SELECT build_id, CASE WHEN label < 0 THEN 100 ELSE coalesce(diff_size + files_changed * 2, 100) END AS diff_size,
        CASE WHEN label < 0 THEN 5 ELSE coalesce(files_changed, 5) END AS files_changed FROM builds""", "builds"))
def src_diffstat_line(spark, sf):
    line = F.concat(F.lit(" "), F.col("files_changed"), F.lit(" files changed, "), F.col("diff_size"),
                    F.lit(" insertions(+), "), F.col("files_changed") * 2, F.lit(" deletions(-)"))
    text = F.when(F.col("label") < 0, "no changes").otherwise(F.coalesce(line, F.lit("")))
    return views.builds(spark, sf).select(
        "build_id", git.diffstat_churn(text, F.lit(5)).alias("diff_size"), git.diffstat_files(text).alias("files_changed"))


@TOPIC.query("src_junit_counts", """
    SELECT l_orderkey AS build, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
        CASE WHEN k = 4 THEN NULL ELSE CASE WHEN k = 2 THEN 2 ELSE 1 END * q END AS tests,
        CASE WHEN k = 4 THEN NULL ELSE CASE WHEN k = 2 THEN 2 ELSE 1 END * (l_suppkey % 4) END AS failures,
        CASE WHEN k = 4 THEN NULL WHEN k = 0 THEN 1 WHEN k IN (5, 6) THEN 3 ELSE 0 END AS skipped
    FROM (SELECT *, l_partkey % 7 AS k, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""")
def src_junit_counts(spark, sf):
    kind = F.col("l_partkey") % 7
    q, f = F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 4).cast("string")
    suite = F.concat(F.lit('<testsuite name="a &gt; b" tests="'), q, F.lit("\" failures='"), f, F.lit("'"))
    xml = (F.when(kind == 0, F.concat(F.lit('<?xml version="1.0"?>\n<!-- <testsuite tests="9"/> -->'), suite,
                                      F.lit(' skip="1"><testcase name="t"/></testsuite>')))
           .when(kind == 1, F.concat(F.lit('<testsuites tests="'), q, F.lit('" failures="'), f, F.lit('">'), suite, F.lit("/>"),
                                     suite, F.lit("/></testsuites>")))
           .when(kind == 2, F.concat(F.lit("<testsuites>"), suite, F.lit(">"), suite, F.lit("/></testsuite></testsuites>")))
           .when(kind == 3, F.concat(F.lit('<ns:testsuite xmlns:ns="urn:x" tests="'), q, F.lit('.0" failures="'), f, F.lit('"/>')))
           .when(kind == 5, F.concat(F.lit("<testsuite name='a > \"b\"' tests='"), q, F.lit("' disabled=\"&#51;\" failures='"), f,
                                     F.lit("'><testcase name='t > u'/><![CDATA[<testsuite tests='9'/>]]></testsuite>")))
           .when(kind == 6, F.concat(F.lit('<a:testsuites xmlns:a="urn:x"><a:testsuite skipped="&#x33;" tests=" '), q, F.lit(' " failures="'), f,
                                     F.lit('"><system-out>a &gt; b</system-out></a:testsuite></a:testsuites>')))
           .otherwise(F.concat(F.lit('<testsuite tests="'), q, F.lit('"><broken'))))
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = views.spread(views.table(spark, sf, "lineitem").select(*columns)).select(
        F.col("l_orderkey").alias("build"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"), xml.alias("xml"))
    return reports.suite_counts(rows, "xml").drop("xml", "errors").withColumn(
        "failures", F.col("failures").cast("long"))


@TOPIC.query("src_junit", duck.sql("""
    SELECT tenant_id AS build, sum(files_changed)::BIGINT AS tests, sum(CAST(round(files_changed * recent_failure_rate) AS INTEGER))::BIGINT AS failures
    FROM builds WHERE files_changed IS NOT NULL GROUP BY tenant_id""", "builds"))
def src_junit(spark, sf):
    """Writes one suite per build as report files below each tenant, finds them and sums the counts."""
    root = sinks.new_table(spark, "workspace")
    suites = views.builds(spark, sf).filter("files_changed IS NOT NULL").select(
        "tenant_id", F.col("files_changed").alias("_tests"),
        F.round(F.col("files_changed") * F.col("recent_failure_rate"), 0).cast("int").alias("_failures"))
    spread = suites.repartition("tenant_id", F.pmod(F.hash("_tests", "_failures"), F.lit(4)))  # several files a tenant
    for place in ("reports", "node_modules/reports"):
        (spread.write.partitionBy("tenant_id").option("rootTag", "testsuites")
         .option("rowTag", "testsuite").option("declaration", "").format("xml").save(f"{root}/{place}"))
    found = reports.discover(spark, root, F.regexp_extract("path", "tenant_id=([^/]+)", 1))
    return reports.suite_counts(found, "xml").groupBy("build").agg(
        F.sum("tests").alias("tests"), F.sum("failures").alias("failures"))


@TOPIC.query("src_commits", duck.sql("""
    SELECT commit_id, project, buggy, fix, CAST(year AS INTEGER) AS year, author_date, la, ld, nf, aexp, age FROM commits""", "commits"))
def src_commits(spark, sf):
    path = sinks.new_table(spark, "commits-csv")
    views.commits(spark, sf).write.option("header", True).csv(path)
    return B.commits_csv(spark, path)


@TOPIC.query("src_training_csv", duck.sql("SELECT build_id, " + ", ".join(
    f"CAST({f} AS DOUBLE) AS {f}" for f in K.FEATURES) + ", label FROM builds WHERE label >= 0", "builds"))
def src_training_csv(spark, sf):
    path = sinks.new_table(spark, "training-csv")
    stored_builds(spark, sf).drop("tenant_id", "timestamp").write.option("header", True).csv(path)
    return B.training_csv(spark, path).select("build_id", *K.FEATURES, "label")


# --- sinks

@TOPIC.query("sink_build_append", duck.sql("""
    SELECT tenant_id, count(*) AS builds, sum(score)::BIGINT AS score_sum, count(*) FILTER (WHERE label = -1) AS pending, 'pending' AS label_source FROM scored GROUP BY tenant_id""", "scored"))
def sink_build_append(spark, sf):
    path = sinks.new_table(spark, "builds")
    rows = scored(spark, sf).select("tenant_id", "build_id", "timestamp", *K.FEATURES, F.col("score").alias("predicted_score"),
                                    F.when(F.col("label") >= 0, F.col("label")).alias("label"))
    sinks.append_builds(rows, path, "year")
    return spark.read.parquet(path).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("builds"), F.sum("predicted_score").alias("score_sum"),
        F.sum((F.col("label") == -1).cast("long")).alias("pending"), F.max("label_source").alias("label_source"))


@TOPIC.query("sink_drift_flag", duck.sql(DRIFT_SQL + """
    SELECT tenant_id, builds, drifted_features, verdict, coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM d
        WHERE d.tenant_id = verdicts.tenant_id AND drifted), '') AS features FROM verdicts""", "builds"))
def sink_drift_flag(spark, sf):
    path = sinks.new_table(spark, "drift-reports")
    sinks.append_rows(drift.reports(
        views.recent_builds(spark, sf, 2 * K.DRIFT_RUN), heads=views.build_heads(spark, sf)), path)
    names = F.transform(F.coalesce("features", F.array().cast("array<struct<feature:string,p_value:double,statistic:double>>")), lambda f: f["feature"])
    return spark.read.parquet(path).select("tenant_id", "builds", "drifted_features", "verdict", F.array_join(names, ",").alias("features"))


@TOPIC.query("sink_alert_rows", duck.sql("""
    SELECT tenant_id, build_id, ':no_entry: ' || build_id || ' scored ' || score AS text FROM scored JOIN tenants USING (tenant_id)
    WHERE score > coalesce(threshold_red, 70) AND slack_webhook <> ''""", "scored", "tenants"))
def sink_alert_rows(spark, sf):
    from deployrisk.functions import alerts
    from deployrisk.operators.scoring import with_settings
    path = sinks.new_table(spark, "alerts")
    tenants = views.tenants(spark, sf)
    rows = with_settings(scored(spark, sf), tenants).filter(F.col("score") > F.col("threshold_red"))
    hooks = tenants.filter(F.length("slack_webhook") > 0).select("tenant_id", "slack_webhook")
    text = F.concat(F.lit(alerts.ICONS["BLOCKED"] + " "), F.col("build_id"), F.lit(" scored "), F.col("score"))
    sinks.append_rows(rows.join(hooks, "tenant_id").select("tenant_id", "slack_webhook", "build_id", text.alias("text")), path)
    return spark.read.parquet(path).select("tenant_id", "build_id", "text")
