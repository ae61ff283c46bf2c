"""Deployment-risk tables derived from the driver's parquet tables.

Orders stand in for builds, nations for tenants, customers for actors, market
segments for jobs, and events for CI runs, probes, label events and the access log.
Every view is a lazy projection or join over the given files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deployrisk.operators.ordered import newest


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables. Its schema is read from the files once per path."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows for costly parsing, dealt evenly where the table has fewer files than there are cores.

    A file of one row group is read by one task; tables of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def tenant_of(nation: str) -> Column:
    n = F.col(nation)
    return F.when(n == 0, F.lit("demo")).otherwise(
        F.concat(F.lit("t"), F.lpad(n.cast("string"), 2, "0")))


def build_id_of(order: str) -> Column:
    return F.concat(F.lit("b"), F.lpad(F.col(order).cast("string"), 12, "0"))


def build_hour(order: str) -> Column:
    """Order dates are all midnight; the key spreads builds over the day."""
    return F.col(order) % 24


def build_epoch(date: str, order: str) -> Column:
    return F.unix_timestamp(F.col(date).cast("timestamp")) + build_hour(order) * 3600


def build_heads(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """Identity, time and label of every build; no line items are read.

    ``orders`` may be a stream of the same table.
    """
    orders = table(spark, sf, "orders") if orders is None else orders
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    priority = F.col("o_orderpriority")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        tenant_of("c_nationkey").alias("tenant_id"),
        build_id_of("o_orderkey").alias("build_id"),
        build_epoch("o_orderdate", "o_orderkey").alias("timestamp"),
        build_hour("o_orderkey").cast("int").alias("hour_of_day"),
        F.weekday(F.col("o_orderdate")).alias("day_of_week"),
        F.when(priority == "4-NOT SPECIFIED", F.lit(None)).otherwise(
            (priority == "1-URGENT").cast("int")).alias("is_hotfix"),
        F.lower("c_mktsegment").alias("job_name"),
        F.when(priority == "1-URGENT", F.concat(F.lit("Hotfix/issue-"), F.col("o_orderkey")))
        .when(priority == "2-HIGH", F.concat(F.lit("fix/URGENT-"), F.col("o_orderkey")))
        .when(priority == "3-MEDIUM", F.concat(F.lit("feature/page-"), F.col("o_orderkey")))
        .when(priority == "5-LOW", F.concat(F.lit("release/2."), F.col("o_orderkey") % 7, F.lit("-patch")))
        .otherwise("").alias("branch_name"),
        F.concat(F.lit(" c"), F.col("o_custkey"), F.lit(" ")).alias("triggered_by"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("actor"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
        .otherwise(-1).alias("label"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_totalprice").alias("total_price"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


def order_lines(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """Change and test measurements per order, of all orders or those in ``orders``."""
    n = F.count(F.lit(1))
    items = table(spark, sf, "lineitem")
    if orders is not None:
        items = items.join(orders.select(F.col("order_key").alias("l_orderkey")), "l_orderkey", "left_semi")
    return items.groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("int").alias("diff_size"),
        n.cast("int").alias("files_changed"),
        F.round(F.sum((F.col("l_returnflag") == "A").cast("int")) / n, 4).alias("recent_failure_rate"),
        F.round(F.sum((F.col("l_returnflag") != "R").cast("int")) / n, 4).alias("test_pass_rate"),
        F.max(F.col("l_shipdate").cast("date")).alias("last_ship"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("line_price"),
    )


def builds(spark: SparkSession, sf: str, heads: DataFrame | None = None, *extra: str,
           lines: DataFrame | None = None) -> DataFrame:
    """Build rows as clients send them. Orders without lines have real nulls.

    ``heads`` may carry further columns, kept when named in ``extra``.
    """
    heads = build_heads(spark, sf) if heads is None else heads
    lines = order_lines(spark, sf) if lines is None else lines
    return heads.join(lines, heads.order_key == lines.l_orderkey, "left").select(
        "tenant_id", "build_id", "timestamp",
        "diff_size", "files_changed", "hour_of_day", "day_of_week",
        "recent_failure_rate", "test_pass_rate", "is_hotfix",
        F.lit(None).cast("int").alias("deployer_exp"),
        F.when(F.col("last_ship").isNotNull(),
               F.greatest(F.lit(0), F.datediff("last_ship", "order_date")) / F.lit(32.0)).alias("days_since_deploy"),
        F.round(F.col("line_price") / F.col("total_price") - 1, 4).alias("build_time_delta"),
        "job_name", "branch_name", "triggered_by", "actor", "label", *extra,
    )


def recent_builds(spark: SparkSession, sf: str, count: int) -> DataFrame:
    """The newest builds per tenant; only their lines are summed."""
    heads = newest(build_heads(spark, sf), ["tenant_id"], ["timestamp", "build_id"], count, "_rank").drop("_rank")
    return builds(spark, sf, heads, lines=order_lines(spark, sf, heads))


def tenants(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        tenant_of("n_nationkey").alias("tenant_id"),
        F.concat(F.lit("  Ops@"), F.col("n_name"), F.lit(".example ")).alias("email"),
        F.when(n % 4 == 0, F.lit(None)).otherwise(30 + n % 5 * 5).cast("int").alias("threshold_yellow"),
        F.when(n % 4 == 0, F.lit(None)).otherwise(60 + n % 3 * 10).cast("int").alias("threshold_red"),
        F.when(n % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("https://hooks.example/"), n)).alias("slack_webhook"),
        F.sha2(F.concat(F.lit("key-"), n), 256).alias("api_key_hash"),
        F.when(n % 5 == 0, F.lit("")).otherwise(F.lit("github")).alias("ci_platform"),
        F.when(n % 6 == 1, F.lit("tenant")).otherwise(F.lit("base")).alias("model_phase"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def event_epoch() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)


def ci_runs(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    """One CI run per event; the job is the user."""
    kind, platform = F.col("event_type"), F.col("user_id") % 3
    status = (
        F.when(platform == 0, F.when(kind == "error", "failure").when(kind == "signup", "timed_out")
               .when(kind == "purchase", "cancelled").otherwise("success"))
        .when(platform == 1, F.when(kind == "error", "FAILURE").when(kind == "signup", "UNSTABLE")
              .when(kind == "purchase", "ABORTED").otherwise("SUCCESS"))
        .otherwise(F.when(kind == "error", "FAILED").when(kind == "signup", "ERROR")
                   .when(kind == "purchase", "STOPPED").otherwise("SUCCESSFUL")))
    return (events(spark, sf) if source is None else source).select(
        F.concat(F.lit("job"), F.col("user_id")).alias("job"),
        F.when(platform == 0, "github").when(platform == 1, "jenkins").otherwise("bitbucket").alias("platform"),
        F.col("event_id").alias("run_id"),
        status.alias("status"),
        F.when(kind == "purchase", F.lit(None)).otherwise(F.col("value")).alias("duration_secs"),
        event_epoch().alias("finished_at"),
    )


def probes(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    """Health probes; a deploy is a user and day, early probes form its baseline."""
    return (events(spark, sf) if source is None else source).select(
        F.concat(F.col("user_id"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias("deploy_id"),
        F.col("event_id").alias("probe_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.hour("ts") < 8, "baseline").otherwise("watch").alias("phase"),
        F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 302)
        .when((F.col("event_type") == "purchase") & (F.col("value") > 150), F.lit(None))
        .otherwise(200).cast("int").alias("status"),
        F.col("value").alias("latency_ms"),
    )


def label_events(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    kind = F.col("event_type")
    return (events(spark, sf) if source is None else source).select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("build_id"),
        F.col("event_id").alias("seq"),
        event_epoch().cast("long").alias("event_ts"),
        F.when(kind == "error", " Sentinel_Degraded ").when(kind == "view", "success")
        .when(kind == "click", "failure").when(kind == "signup", "")
        .otherwise("pager-duty").alias("raw_source"),
        F.when(kind.isin("error", "click"), 1).otherwise(0).alias("label"),
    )


def access_log(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    return (events(spark, sf) if source is None else source).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("api-"), F.col("user_id")).alias("api_key"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 250, F.lit(", 172.16.0.1")).alias("forwarded_for"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).cast("int").alias("status"),
        (F.col("value") / 100).alias("seconds"),
        "event_id",
    )


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled commits: one per order, the project is the customer's nation."""
    heads = build_heads(spark, sf)
    k = F.col("order_key")
    return heads.select(
        F.col("build_id").alias("commit_id"),
        F.col("tenant_id").alias("project"),
        (F.col("label") == 1).alias("buggy"),
        (F.coalesce("is_hotfix", F.lit(0)) == 1).alias("fix"),
        F.year("order_date").alias("year"),
        F.col("timestamp").alias("author_date"),
        (k % 700).cast("int").alias("la"),
        (k % 90).cast("int").alias("ld"),
        (k % 12 + 1).cast("int").alias("nf"),
        (k % 300).cast("int").alias("aexp"),
        (k % 160 / 8).alias("age"),
    )


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    """A two-file unified diff per document, rendered in the row from the whole text."""
    exts = F.array(*[F.lit(e) for e in (".py", ".ts", ".go", ".yml", ".java", ".md", ".sql")])
    ext = F.element_at(exts, (F.col("doc_id") % 7 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 3 == 0, "src/tests/").otherwise("src/")

    def body(line: Column, i: Column) -> Column:
        text = (F.when(i % 5 == 0, F.concat(F.lit("    if (a && b) { "), line))
                .when(i % 5 == 1, F.concat(F.lit("// "), line))
                .when(i % 5 == 2, F.concat(F.lit("        def f"), i.cast("string"), F.lit("(): return x or y # "), line))
                .when(i % 5 == 3, F.concat(F.lit("} "), line))
                .otherwise(line))
        sign = F.when(i % 4 == 3, "-").when(i % 4 == 2, " ").otherwise("+")
        return F.concat(sign, text)

    lines = F.split("text", "\n", -1)
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("change_id"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("diff --git a/"), folder, F.lit("m"), F.col("doc_id"), ext,
                     F.lit(" b/"), folder, F.lit("m"), F.col("doc_id"), ext),
            F.concat(F.lit("--- a/"), folder, F.lit("m"), F.col("doc_id"), ext),
            F.concat(F.lit("+++ b/"), folder, F.lit("m"), F.col("doc_id"), ext),
            F.concat(F.lit("@@ -1,3 +"), F.col("doc_id") % 50 + 1, F.lit(","), F.size(lines), F.lit(" @@ head")),
            F.array_join(F.transform(lines, body), "\n"),
            F.lit("diff --git a/Dockerfile b/Dockerfile\n--- a/Dockerfile\n+++ b/Dockerfile"),
            F.concat(F.lit("@@ -7 +"), F.col("doc_id") % 9 + 1, F.lit(" @@\n+RUN build --if-needed\n-class Old")),
        ).alias("diff_text"))
