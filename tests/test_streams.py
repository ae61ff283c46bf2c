"""Streams fed with unsorted files, one a micro-batch, give the rows of a batch over all files."""

import pytest
from pyspark.sql import functions as F

from deployrisk.plans import views
from deployrisk.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """events and orders as four unsorted files each."""
    root = tmp_path_factory.mktemp("parts")
    for name in ("events", "orders"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        rows.repartition(4, F.rand(3)).write.parquet(f"{root}/{name}")
    return str(root)


def stream(spark, parts, name, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{parts}/{name}")


def rows(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("view,partial,fold,merge", [
    (views.label_events, jobs.label_partials, jobs.merge_labels, jobs.merge_labels),
    (views.access_log, lambda b: jobs.request_partials(b, jobs.limiter_key(), "1 day"), jobs.merge_requests, lambda p: jobs.merge_over_limit(p, 1)),
    (views.access_log, lambda b: jobs.access_partials(b).withColumn("seconds", F.round("seconds", 6)), jobs.merge_access, lambda p: jobs.merge_access(p).drop("seconds")),
    (views.probes, lambda b: jobs.health_partials(b, "1 day"), jobs.merge_probes, lambda p: jobs.merge_health(p, p.sparkSession.createDataFrame([], "deploy_id string, baseline_p50 double"))),
])
def test_event_streams(spark, sf, parts, view, partial, fold, merge):
    source = view(spark, sf, stream(spark, parts, "events", jobs.EVENTS))
    got = merge(jobs.drain_partials(source, partial, fold, "test"))
    want = merge(partial(view(spark, sf)))
    assert rows(got) == rows(want) and got.count() > 0


def test_actor_stream(spark, sf, parts):
    heads = views.build_heads(spark, sf, stream(spark, parts, "orders", jobs.ORDERS))
    got = jobs.merge_actors(jobs.drain_partials(heads, jobs.actor_partials, jobs.merge_actors, "test"))
    assert rows(got) == rows(jobs.actor_partials(views.build_heads(spark, sf)))
    assert got.agg(F.sum("builds")).first()[0] == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_stream_without_files(spark, sf, tmp_path):
    spark.createDataFrame([], jobs.ORDERS).write.parquet(str(tmp_path / "orders"))
    heads = views.build_heads(spark, sf, stream(spark, str(tmp_path), "orders", jobs.ORDERS))
    assert jobs.merge_actors(jobs.drain_partials(heads, jobs.actor_partials, jobs.merge_actors, "test")).count() == 0


def numbers(spark, folder, first, last):
    for i in range(first, last):
        spark.createDataFrame([(i % 3, 1), (i, 1)], "k long, n long").coalesce(1).write.parquet(f"{folder}/f{i}")


def test_many_batches_leave_few_folders(spark, tmp_path, monkeypatch):
    """Also when the job stops and goes on, and when a batch is run again."""
    monkeypatch.setattr(jobs, "FAN_IN", 3)
    out, checkpoint, schema = str(tmp_path / "out"), str(tmp_path / "checkpoint"), "k long, n long"
    merge = lambda parts: jobs.summed(parts, ["n"])
    total = 0
    for first, last in ((0, 11), (11, 29)):
        numbers(spark, tmp_path / "in", first, last)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.fold(source, merge, merge, out, checkpoint)
        total = last
        live = jobs.live_spans(jobs.spans(spark, out))
        assert [i for a, b in live for i in range(a, b + 1)] == list(range(last)) and len(live) <= 2 * 4
        got = {r.k: r.n for r in merge(jobs.folded(spark, out, source.schema)).collect()}
        want = {}
        for i in range(total):
            for k in (i % 3, i):
                want[k] = want.get(k, 0) + 1
        assert got == want
    assert len(jobs.spans(spark, out)) <= 2 * len(live) + 3      # merged ones are deleted in time
    # the last batch once more, as after a crash before its commit
    done = total - 1
    spark.createDataFrame([(done % 3, 1), (done, 1)], schema).write.mode("overwrite").parquet(f"{out}/batches={done}-{done}")
    jobs._compact(spark, out, source.schema, merge, done)
    assert {r.k: r.n for r in merge(jobs.folded(spark, out, source.schema)).collect()} == want


def test_late_label_takes_a_build_out(spark):
    schema = "build_id string, tenant_id string, timestamp long"
    builds = [("b1", "t", 0), ("b2", "t", 0), ("b3", "t", 90 * 86400)]
    batches = [builds[:1], [("b2", None, None)], builds[1:], []]
    parts = [jobs.quiet_partials(spark.createDataFrame(b, schema)) for b in batches]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    as_of = F.lit(100 * 86400)
    assert [r.build_id for r in jobs.assumed_ok(every, as_of).collect()] == ["b1"]
    assert [r.build_id for r in jobs.assumed_ok(jobs.merge_quiet(every), as_of).collect()] == ["b1"]
    late = every.unionByName(jobs.quiet_partials(spark.createDataFrame([("b1", None, None)], schema)))
    assert jobs.assumed_ok(late, as_of).count() == 0
