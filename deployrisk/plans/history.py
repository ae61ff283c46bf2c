"""CI history, test-rate and change-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.functions import scalars as S
from deployrisk.operators import history, scoring
from deployrisk.operators.impute import tenant_medians
from deployrisk.plans import duck, views
from deployrisk.plans.registry import Topic

TOPIC = Topic()


def runs(spark, sf):
    return views.ci_runs(spark, sf).withColumn("succeeded", history.outcome(F.col("platform"), F.col("status")))


@TOPIC.query("ci_outcome_map", duck.sql("""
    SELECT platform, succeeded, count(*) AS runs, sum(run_id)::BIGINT AS id_sum FROM ci_runs GROUP BY ALL""", "ci_runs"))
def ci_outcome_map(spark, sf):
    return runs(spark, sf).groupBy("platform", "succeeded").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("run_id").alias("id_sum"))


@TOPIC.query("ci_exclude_current", duck.sql("""
    SELECT job, count(*) AS earlier_runs, max(run_id) AS newest_earlier
    FROM ci_runs JOIN (SELECT job AS j, max(run_id) AS current FROM ci_runs GROUP BY job) ON j = job
    WHERE run_id <> current GROUP BY job""", "ci_runs"))
def ci_exclude_current(spark, sf):
    all_runs = runs(spark, sf)
    current = all_runs.groupBy("job").agg(F.max("run_id").alias("current"))
    return history.exclude_current(all_runs.join(current, "job"), F.col("current")).groupBy("job").agg(
        F.count(F.lit(1)).alias("earlier_runs"), F.max("run_id").alias("newest_earlier"))


FRAME = "OVER (PARTITION BY job ORDER BY finished_at, run_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
TYPICAL = f"quantile_cont(CASE WHEN duration_secs > 0 THEN duration_secs END, 0.5) {FRAME}"


@TOPIC.query("ci_failure_rate", duck.sql(f"""
    SELECT job, run_id, round(avg(CASE WHEN succeeded IS NULL THEN NULL WHEN succeeded THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) {FRAME}, 4) AS recent_failure_rate
    FROM ci_runs""", "ci_runs"))
def ci_failure_rate(spark, sf):
    return history.ci_features(runs(spark, sf)).select("job", "run_id", "recent_failure_rate")


@TOPIC.query("ci_days_since", duck.sql(f"""
    SELECT job, run_id, round(greatest(0.0::DOUBLE, (finished_at - last) / 86400.0::DOUBLE), 3) AS days_since_deploy
    FROM (SELECT *, max(CASE WHEN succeeded THEN finished_at END) {FRAME} AS last FROM ci_runs)
    WHERE last IS NOT NULL""", "ci_runs"))
def ci_days_since(spark, sf):
    return history.ci_features(runs(spark, sf)).select("job", "run_id", "days_since_deploy").filter(
        F.col("days_since_deploy").isNotNull())


@TOPIC.query("ci_time_delta", duck.sql(f"""
    SELECT job, run_id, CASE WHEN duration_secs > 0 AND typical > 0 THEN round((duration_secs - typical) / typical, 4) END AS build_time_delta
    FROM (SELECT *, {TYPICAL} AS typical FROM ci_runs)""", "ci_runs"))
def ci_time_delta(spark, sf):
    return history.ci_features(runs(spark, sf)).select("job", "run_id", "build_time_delta")


V1 = duck.sql("""
    SELECT job, run_id, round(coalesce(avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
        OVER (PARTITION BY job ORDER BY finished_at, run_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 3) AS recent_failure_rate_v1
    FROM ci_runs""", "ci_runs")


@TOPIC.query("ci_failure_rate_v1", V1)
def ci_failure_rate_v1(spark, sf):
    return history.ci_features_v1(runs(spark, sf)).select("job", "run_id", "recent_failure_rate_v1")


@TOPIC.query("ci_time_delta_v1", duck.sql("""
    SELECT job, run_id, CASE WHEN n >= 2 AND duration_secs > 0 AND mean > 0
        THEN round((duration_secs - mean) / mean, 3) ELSE 0.0::DOUBLE END AS build_time_delta_v1
    FROM (SELECT *, avg(duration_secs) OVER w AS mean, count(*) OVER w AS n FROM ci_runs
          WINDOW w AS (PARTITION BY job ORDER BY finished_at, run_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))""", "ci_runs"))
def ci_time_delta_v1(spark, sf):
    return history.ci_features_v1(runs(spark, sf)).select("job", "run_id", "build_time_delta_v1")


@TOPIC.query("ci_days_since_v1", duck.sql("""
    SELECT job, coalesce(greatest(0.0::DOUBLE, round((1706745600.0::DOUBLE - max(CASE WHEN succeeded THEN finished_at END)) / 86400.0::DOUBLE, 1)), 7.0::DOUBLE) AS days_since_deploy_v1
    FROM ci_runs GROUP BY job""", "ci_runs"))
def ci_days_since_v1(spark, sf):
    return history.days_since_success_v1(runs(spark, sf), F.lit(1706745600.0))


def test_counts(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("build"), F.col("l_linenumber").alias("line"),
        (F.col("l_quantity").cast("int") * F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("passed"),
        (F.col("l_suppkey") % 4 * F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("failed"),
        (F.col("l_partkey") % 6).alias("skipped"))


COUNTS_SQL = """WITH c AS (SELECT l_orderkey AS build, l_linenumber AS line,
    CAST(l_quantity AS INTEGER) * CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS passed,
    l_suppkey % 4 * CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS failed, l_partkey % 6 AS skipped FROM lineitem)"""


@TOPIC.query("ci_pass_rate_v1", COUNTS_SQL + """
    SELECT build, line, passed, failed, skipped, CASE WHEN passed + failed + skipped > 0
        THEN round(passed / CAST(passed + failed + skipped AS DOUBLE), 3) ELSE 1.0::DOUBLE END AS test_pass_rate_v1 FROM c""")
def ci_pass_rate_v1(spark, sf):
    return test_counts(spark, sf).withColumn("test_pass_rate_v1", history.pass_rate_v1(
        F.col("passed"), F.col("failed"), F.col("skipped")))


@TOPIC.query("src_jenkins_tests", COUNTS_SQL + """
    SELECT build, line, passed, CAST(failed AS INTEGER) AS failed, CASE WHEN passed + failed > 0
        THEN round(passed / CAST(passed + failed AS DOUBLE), 4) END AS test_pass_rate FROM c""")
def src_jenkins_tests(spark, sf):
    from deployrisk.sources.ci import jenkins_tests
    payloads = test_counts(spark, sf).select("build", "line", F.to_json(F.struct(
        F.col("passed").alias("passCount"), F.col("failed").alias("failCount"),
        F.col("skipped").alias("skipCount"))).alias("payload"))
    return jenkins_tests(payloads, "payload").select("build", "line", "passed", "failed", "test_pass_rate")


def reports(spark, sf):
    """One report per order line; every fourth test fails or errs, some are skipped."""
    return views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("build"),
        F.col("l_quantity").cast("int").alias("tests"),
        (F.col("l_suppkey") % 4).alias("failures"), (F.col("l_partkey") % 3).alias("errors"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("int")).otherwise(F.col("l_partkey") % 2)
        .alias("skipped"))


REPORTS_SQL = """r AS (SELECT l_orderkey AS build, CAST(l_quantity AS INTEGER) AS tests,
    l_suppkey % 4 AS failures, l_partkey % 3 AS errors,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) ELSE l_partkey % 2 END AS skipped FROM lineitem),
  rate AS (SELECT build, sum(tests)::BIGINT AS tests, sum(skipped)::BIGINT AS skipped, count(*) AS reports,
    CASE WHEN sum(tests) - sum(skipped) > 0 THEN round(least(1.0::DOUBLE,
      CAST(greatest(0, sum(tests) - sum(skipped) - sum(failures) - sum(errors)) AS DOUBLE) / CAST(sum(tests) - sum(skipped) AS DOUBLE)), 4) END AS test_pass_rate
    FROM r GROUP BY build)"""


@TOPIC.query("junit_pass_rate", "WITH " + REPORTS_SQL + """
    SELECT build, tests, skipped, reports, test_pass_rate FROM rate""")
def junit_pass_rate(spark, sf):
    return history.report_pass_rate(reports(spark, sf), ["build"]).select(
        "build", "tests", "skipped", "reports", "test_pass_rate")


@TOPIC.query("pass_rate_pick", duck.sql("WITH " + REPORTS_SQL + """
    SELECT build, coalesce(n.test_pass_rate, rate.test_pass_rate) AS test_pass_rate,
           CASE WHEN n.test_pass_rate IS NOT NULL THEN 'ci-api' WHEN rate.test_pass_rate IS NOT NULL THEN 'junit-xml' END AS source
    FROM (SELECT order_key AS build, CASE WHEN is_hotfix = 1 THEN test_pass_rate END AS test_pass_rate
          FROM heads LEFT JOIN order_lines ON order_key = l_orderkey) n FULL JOIN rate USING (build)""", "heads", "order_lines"))
def pass_rate_pick(spark, sf):
    orders = views.build_heads(spark, sf).select("order_key", "is_hotfix")
    lines = views.order_lines(spark, sf).select("l_orderkey", "test_pass_rate")
    native = orders.join(lines, orders.order_key == lines.l_orderkey, "left").select(
        F.col("order_key").alias("build"),
        F.when(F.col("is_hotfix") == 1, F.col("test_pass_rate")).alias("test_pass_rate"))
    measured = history.report_pass_rate(reports(spark, sf), ["build"])
    return history.pick_pass_rate(native, measured, "build")


NUMSTATS_SQL = """n AS (SELECT l_orderkey AS change_id,
      sum(CAST(l_quantity AS INTEGER) + l_partkey % 40)::BIGINT AS raw_churn,
      sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE CAST(l_quantity AS INTEGER) + l_partkey % 40 END)::BIGINT AS churn,
      sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 2 END)::BIGINT AS files FROM lineitem GROUP BY l_orderkey)"""


@TOPIC.query("git_diff_stats", "WITH " + NUMSTATS_SQL + """
    SELECT change_id, churn AS diff_size, files AS files_changed, CASE WHEN raw_churn > churn
        THEN CAST(round_even((1 - CAST(churn AS DOUBLE) / raw_churn) * 100, 0) AS INTEGER) || '% of ' || raw_churn || ' changed lines are formatting only, not counted'
        WHEN churn = 0 AND files = 0 THEN 'no changes' ELSE '' END AS note FROM n""")
def git_diff_stats(spark, sf):
    raw, substantive = numstats(spark, sf)
    return history.change_stats(raw, substantive, "change_id").select(
        "change_id", "diff_size", "files_changed", F.regexp_replace("note", r"(\d),(\d)", "$1$2").alias("note"))


@TOPIC.query("git_formatting_ratio", "WITH " + NUMSTATS_SQL + """
    SELECT change_id, CASE WHEN raw_churn > 0 THEN CAST(CAST(CAST(greatest(0.0::DOUBLE, 1.0::DOUBLE - CAST(churn AS DOUBLE) / raw_churn) AS VARCHAR) AS DECIMAL(18,4)) AS DOUBLE) END AS formatting_ratio FROM n""")
def git_formatting_ratio(spark, sf):
    raw, substantive = numstats(spark, sf)
    return history.change_stats(raw, substantive, "change_id").select("change_id", "formatting_ratio")


def numstats(spark, sf):
    """Raw and whitespace-ignoring numstat texts per order line, parsed and summed per order."""
    from deployrisk.sources.git import numstat_text_counts
    lines = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("change_id"), "l_returnflag",
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("\t"), (F.col("l_partkey") % 40).cast("string"),
                 F.lit("\tsrc/m"), F.col("l_partkey"), F.lit(".py\n-\t-\timg/p"), F.col("l_suppkey"), F.lit(".png\n"))
        .alias("numstat"))

    def total(df):
        return numstat_text_counts(df, "numstat").groupBy("change_id").agg(
            F.sum("churn").alias("churn"), F.sum("files").alias("files"))

    return total(lines), total(lines.withColumn("numstat", F.when(
        F.col("l_returnflag") == "A", "").otherwise(F.col("numstat"))))


@TOPIC.query("join_numstat", "WITH " + NUMSTATS_SQL + """
    SELECT change_id, raw_churn, churn, files FROM n""")
def join_numstat(spark, sf):
    raw, substantive = numstats(spark, sf)
    return raw.select("change_id", F.col("churn").alias("raw_churn")).join(substantive, "change_id")


@TOPIC.query("hotfix_flag", duck.sql("""
    SELECT build_id, CASE WHEN regexp_matches(lower(branch_name), 'hotfix|urgent|emergency|revert|rollback|patch') THEN 1 ELSE 0 END AS is_hotfix
    FROM heads""", "heads"))
def hotfix_flag(spark, sf):
    return views.build_heads(spark, sf).select("build_id", S.hotfix_flag(F.col("branch_name")).alias("is_hotfix"))


@TOPIC.query("hotfix_flag_v1", duck.sql("""
    SELECT build_id, CASE WHEN regexp_matches(lower(branch_name), 'hotfix|fix/|patch/|revert/|emergency') THEN 1 ELSE 0 END AS is_hotfix
    FROM heads""", "heads"))
def hotfix_flag_v1(spark, sf):
    return views.build_heads(spark, sf).select(
        "build_id", S.hotfix_flag(F.col("branch_name"), K.HOTFIX_WORDS_V1).alias("is_hotfix"))


@TOPIC.query("clock_features", """
    SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events""")
def clock_features(spark, sf):
    hour, day = history.clock_features(F.col("ts"))
    return views.events(spark, sf).select("event_id", hour.alias("hour_of_day"), day.alias("day_of_week"))


EXP_SQL = "row_number() OVER (PARTITION BY tenant_id, actor ORDER BY timestamp, build_id) - 1"


@TOPIC.query("deployer_exp", duck.sql(f"""
    SELECT tenant_id, actor, build_id, {EXP_SQL} AS deployer_exp FROM heads""", "heads"))
def deployer_exp(spark, sf):
    return scoring.with_actor_history(views.build_heads(spark, sf)).select(
        "tenant_id", "actor", "build_id", F.col("server_exp").alias("deployer_exp"))


@TOPIC.query("join_actor_hist", duck.sql(f"""
    SELECT build_id, exp, CASE WHEN exp > 0 THEN 'server_history' ELSE 'no_history' END AS source
    FROM (SELECT build_id, {EXP_SQL} AS exp FROM builds)""", "builds"))
def join_actor_hist(spark, sf):
    seen = scoring.with_actor_history(views.build_heads(spark, sf)).select("build_id", "server_exp")
    return views.builds(spark, sf).join(seen, "build_id").select(
        "build_id", F.col("server_exp").alias("exp"),
        F.when(F.col("server_exp") > 0, "server_history").otherwise("no_history").alias("source"))


@TOPIC.query("deployer_exp_v1", duck.sql("""
    SELECT tenant_id, actor, greatest(1, count(*)) AS deployer_exp_v1 FROM heads GROUP BY ALL""", "heads"))
def deployer_exp_v1(spark, sf):
    return history.actor_builds_v1(views.build_heads(spark, sf))


@TOPIC.query("deployer_hint", duck.sql(f"""
    WITH e AS (SELECT build_id, tenant_id, {EXP_SQL} AS server_exp,
                 CASE WHEN order_key % 3 = 0 THEN NULL ELSE order_key % 60 END AS hint FROM heads),
    m AS (SELECT tenant_id, CASE WHEN count(*) >= 8 THEN quantile_cont(CAST(order_key % 60 AS DOUBLE), 0.5) END AS med
          FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp DESC, build_id DESC) AS r FROM heads)
          WHERE r <= 50 GROUP BY tenant_id),
    b AS (SELECT e.*, med, CAST(round_even(coalesce(med, 27), 0) AS BIGINT) AS baseline FROM e LEFT JOIN m USING (tenant_id))
    SELECT build_id, CAST(CASE WHEN server_exp > 0 THEN server_exp WHEN hint <= baseline THEN hint ELSE baseline END AS INTEGER) AS deployer_exp,
      CASE WHEN server_exp > 0 THEN 'server_history' WHEN hint <= baseline THEN 'client_hint'
           WHEN med IS NOT NULL THEN 'tenant_median' ELSE 'training_median' END AS exp_source,
      NOT (server_exp > 0 OR coalesce(hint <= baseline, false)) AS exp_imputed FROM b""", "heads"))
def deployer_hint(spark, sf):
    from deployrisk.operators.ordered import newest
    heads = views.build_heads(spark, sf)
    recent = newest(heads, ["tenant_id"], ["timestamp", "build_id"], K.MEDIAN_HISTORY)
    medians = recent.groupBy("tenant_id").agg(F.when(F.count(F.lit(1)) >= K.MEDIAN_MIN_ROWS, F.median(
        (F.col("order_key") % 60).cast("double"))).alias("exp_median"))
    seen = scoring.with_actor_history(heads).withColumn(
        "hint", F.when(F.col("order_key") % 3 != 0, F.col("order_key") % 60))
    return scoring.resolve_experience(seen.join(medians, "tenant_id", "left"), F.col("exp_median")).select(
        "build_id", "deployer_exp", "exp_source", "exp_imputed")


@TOPIC.query("measured_split", duck.sql("""
    SELECT build_id, 10 - unknown AS n_measured, unknown AS n_unknown, names AS unknown_names FROM (
      SELECT build_id, CAST(len(list_filter(l, lambda x: x IS NOT NULL)) AS INTEGER) AS unknown, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS names
      FROM (SELECT build_id, [""" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in K.FEATURES) + """] AS l FROM builds))""", "builds"))
def measured_split(spark, sf):
    return history.measured_split(views.builds(spark, sf)).select(
        "build_id", F.size("measured").alias("n_measured"), F.size("unknown").alias("n_unknown"),
        F.array_join("unknown", ",").alias("unknown_names"))


ROLLING = """avg(CASE WHEN buggy THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY project
    ORDER BY author_date, commit_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


@TOPIC.query("jit_rolling_rate", duck.sql(f"""
    SELECT project, commit_id, {ROLLING} AS recent_failure_rate FROM commits""", "commits"))
def jit_rolling_rate(spark, sf):
    return history.rolling_bug_rate(views.commits(spark, sf)).select("project", "commit_id", "recent_failure_rate")


@TOPIC.query("jit_mapping", duck.sql(f"""
    SELECT commit_id, la + ld AS diff_size, nf AS files_changed,
        CAST(author_date // 3600 % 24 AS INTEGER) AS hour_of_day, CAST(isodow(to_timestamp(author_date) AT TIME ZONE 'UTC') - 1 AS INTEGER) AS day_of_week,
        {ROLLING} AS recent_failure_rate, CAST(NULL AS DOUBLE) AS test_pass_rate, CASE WHEN fix THEN 1 ELSE 0 END AS is_hotfix,
        aexp AS deployer_exp, age AS days_since_deploy, CAST(NULL AS DOUBLE) AS build_time_delta FROM commits""", "commits"))
def jit_mapping(spark, sf):
    return history.commit_features(views.commits(spark, sf)).select("commit_id", *K.FEATURES)


@TOPIC.query("src_commits_desc", duck.sql("""
    SELECT count(*) AS rows, count(DISTINCT project) AS projects, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year,
        avg(CASE WHEN buggy THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS base_rate FROM commits""", "commits"))
def src_commits_desc(spark, sf):
    return history.describe_commits(views.commits(spark, sf))


@TOPIC.query("split_year", duck.sql("""
    SELECT CASE WHEN year <= 1999 THEN 'train' ELSE 'test' END AS part, count(*) AS rows,
        sum(CASE WHEN buggy THEN 1 ELSE 0 END)::BIGINT AS buggy FROM commits GROUP BY ALL""", "commits"))
def split_year(spark, sf):
    return history.split_by_year(views.commits(spark, sf), 1999).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("buggy").cast("long")).alias("buggy"))
