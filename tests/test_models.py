"""Metrics, drift, oversampling, splits and training."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators import balance, change, drift, metrics, models, selection, training

TYPES = ", ".join(f"{f} int" if f in K.INT_FEATURES else f"{f} double" for f in K.FEATURES)


def history(spark, n, tenant="t1", risky=lambda i: i % 3 == 0):
    rows = []
    for i in range(n):
        features = (i + 800, 30, 3, 5, 0.7, 0.5, 1, 2, 40.0, 1.5) if risky(i) else (i + 20, 3, 14, 2, 0.05, 0.99, 0, 60, 2.0, 0.0)
        rows.append((tenant, f"b{i:05d}", 1_700_000_000 + 3600 * i, int(risky(i)), *features))
    return spark.createDataFrame(rows, f"tenant_id string, build_id string, timestamp long, label int, {TYPES}")


AS_OF = 1_700_000_000 + 3600 * 500


def test_tail_split_holds_out_the_newest(spark):
    got = selection.tail_split(history(spark, 100).orderBy(F.rand(5))).filter("held_out")
    assert sorted(r.build_id for r in got.collect()) == [f"b{i:05d}" for i in range(80, 100)]


def predictions(spark, p, y):
    return spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)], "k string, p double, y int")


def test_calibrated_and_overconfident(spark):
    rng = np.random.default_rng(0)
    p = rng.random(20000)
    good = predictions(spark, p, rng.random(20000) < p)
    assert metrics.calibration_error(good, ["k"]).first().ece < 0.02
    assert metrics.calibration_error(predictions(spark, [0.95] * 100, [0] * 100), ["k"]).first().ece > 0.9
    ranked = predictions(spark, np.linspace(0.90, 0.99, 100), [0] * 50 + [1] * 50)
    assert metrics.auc_roc(ranked, ["k"]).first().auc_roc == 1.0
    assert metrics.calibration_error(ranked, ["k"]).first().ece > 0.4


def test_auc_with_ties_equals_pair_counting(spark):
    rng = np.random.default_rng(2)
    p, y = rng.integers(0, 12, 200) / 11, rng.integers(0, 2, 200)
    pos, neg = p[y == 1], p[y == 0]
    want = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
    assert metrics.auc_roc(predictions(spark, p, y), ["k"]).first().auc_roc == pytest.approx(want)
    assert metrics.auc_roc(predictions(spark, [0.1, 0.9], [1, 1]), ["k"]).first().auc_roc == 0.5


@pytest.mark.parametrize("share", [0.76, 0.05])
def test_flagging_everything_never_promotes(spark, share):
    y = [1] * int(200 * share) + [0] * (200 - int(200 * share))
    rows = predictions(spark, [0.9] * 200, y).withColumnRenamed("k", "tenant_id")
    gated = metrics.gate(metrics.held_out_summary(rows, ["tenant_id"]).withColumn("dataset_size", F.lit(1000)))
    row = gated.first()
    assert not row.ok_precision and not row.passed


def brute_p(n, m, h):
    """Share of all orderings whose gap reaches h, by counting lattice paths."""
    paths = {(0, 0): 1}
    for i in range(n + 1):
        for j in range(m + 1):
            if (i, j) != (0, 0):
                paths[i, j] = 0 if abs(i * m - j * n) >= h else paths.get((i - 1, j), 0) + paths.get((i, j - 1), 0)
    return 1 - paths[n, m] / comb(n + m, n)


@pytest.mark.parametrize("n,m,h", [(30, 30, 300), (30, 30, 330), (30, 24, 200), (7, 30, 90), (30, 30, 900), (5, 5, 0)])
def test_exact_p_values(spark, n, m, h):
    got = spark.range(1).select(drift.exact_p(F.lit(n), F.lit(m), F.lit(h)).alias("p")).first().p
    assert got == pytest.approx(brute_p(n, m, h) if h else 1.0, abs=1e-12)


def test_known_drift_boundary(spark):
    at = lambda h: spark.range(1).select(drift.exact_p(F.lit(30), F.lit(30), F.lit(30 * h)).alias("p")).first().p
    assert round(at(10), 4) == 0.0709 and round(at(11), 4) == 0.0346


def test_shifted_builds_drift(spark):
    same = history(spark, 120, "calm")
    moved = history(spark, 120, "moved", lambda i: i >= 90)
    few = history(spark, 40, "few")
    got = {r.tenant_id: r.verdict for r in drift.verdicts(same.unionByName(moved).unionByName(few)).collect()}
    assert got["moved"] == "drifted" and got["few"] == "skipped"


@pytest.mark.parametrize("tile,copies", [(4096, 50_000), (16, 20)])
def test_neighbours_equal_brute_force(spark, monkeypatch, tile, copies):
    monkeypatch.setattr(balance, "TILE", tile)
    monkeypatch.setattr(balance, "QUERIES", copies)
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (400, 10)) * rng.uniform(0.1, 50, 10)
    points[:, 0] = np.round(points[:, 0])
    rows = [("a" if i % 3 else "b", f"v{i:04d}", *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "tenant_id string, vid string, " + ", ".join(f"{f} double" for f in K.FEATURES))
    got = {}
    for r in balance.nearest(df, ["tenant_id"], 5).collect():
        got.setdefault(r.vid, []).append((r["rank"], r.distance2))
    for i, p in enumerate(points):
        same = [j for j in range(400) if bool(j % 3) == bool(i % 3) and j != i]
        want = np.sort(np.sum((points[same] - p) ** 2, axis=1))[:5]
        np.testing.assert_allclose([d for _, d in sorted(got[f"v{i:04d}"])], want, rtol=1e-9)


def test_few_boxes_are_searched():
    rng = np.random.default_rng(6)
    compared = {}
    for n in (400, 4000):
        points = np.round(rng.normal(0, 1, (n, 3)), 1) * [50, 5, 1]
        points = np.unique(points, axis=0)
        near, far, pairs = balance.tile_neighbours(points, points, np.arange(len(points)), np.full(len(points), np.inf), 5)
        compared[n] = pairs / len(points)
        for i in rng.integers(0, len(points), 60):
            squares = np.sum((points - points[i]) ** 2, axis=1)
            squares[i] = np.inf
            want = np.lexsort((np.arange(len(points)), np.round(squares, 9)))[:5]
            np.testing.assert_allclose(far[i], squares[want], rtol=1e-9)
    assert compared[4000] < 40 and compared[4000] < 1.7 * compared[400]
    one = balance.tile_neighbours(points[:1], points[:1], np.array([0]), np.array([np.inf]), 5)
    assert (one[0] == -1).all() and np.isinf(one[1]).all()


def test_oversampling_reaches_parity_inside_the_class(spark):
    train = history(spark, 300, risky=lambda i: i % 10 == 0)
    made = balance.oversample(train, ["tenant_id"], "build_id")
    assert made.count() == 270 - 30
    box = made.agg(F.min("diff_size").alias("lo"), F.max("diff_size").alias("hi"), F.min("label").alias("l")).first()
    assert box.lo >= 800 and box.hi <= 1090 and box.l == 1
    again = balance.oversample(train, ["tenant_id"], "build_id")
    assert made.exceptAll(again).count() == 0


def test_copies_only_and_too_few(spark):
    copies = history(spark, 100, risky=lambda i: i % 5 == 0).withColumn("diff_size", F.when(F.col("label") == 1, 900).otherwise(F.col("diff_size")))
    made = balance.oversample(copies, ["tenant_id"], "build_id")
    assert made.count() == 60 and made.select("diff_size").distinct().count() == 1
    assert balance.oversample(history(spark, 30, risky=lambda i: i < 5), ["tenant_id"], "build_id").count() == 0


def test_one_night(spark):
    builds = history(spark, 400, "big").unionByName(history(spark, 10, "small")).unionByName(history(spark, 400, "demo"))
    paths = training.retrain_all(builds, F.lit(AS_OF), "v1", trees=10)
    gated = training.gate_all(spark, paths)
    row = gated.first()
    assert gated.count() == 1 and row.tenant_id == "big" and row.passed and row.test_rows == 80
    outcome = {r.tenant_id: (r.outcome, r.reason) for r in training.outcomes(spark, paths, gated).collect()}
    assert outcome == {"big": ("retrained", ""), "small": ("skipped", "only 10 labelled builds")}
    live = training.registry_rows(gated, paths, F.lit(AS_OF)).filter("promoted")
    assert live.first().feature_columns == K.FEATURES


def test_sample_weights_reach_the_fit(spark):
    """Weights stay where a tenant is too small to balance, and are void where it was balanced."""
    weight = F.when(F.col("build_id").substr(6, 1) == "0", 0.4).when(F.col("build_id").substr(6, 1) == "1", F.lit(None)).otherwise(0.9)
    train = history(spark, 60, "few", risky=lambda i: i % 20 == 0).unionByName(history(spark, 60, "many")).withColumn("sample_weight", weight)
    rows = balance.balance(train, ["tenant_id"], "build_id").collect()
    few = {r.build_id: r.sample_weight for r in rows if r.tenant_id == "few"}
    assert set(few.values()) == {0.4, 0.9, 1.0} and few["b00010"] == 0.4 and few["b00011"] == 1.0
    many = [r.sample_weight for r in rows if r.tenant_id == "many"]
    assert len(many) == 80 and set(many) == {1.0}
    small = history(spark, 40, "few", risky=lambda i: i % 10 == 0).withColumn("sample_weight", F.when(F.col("label") == 1, 0.5).otherwise(1.0))
    root = training.fit_keys(small, ["tenant_id"], 200).select(F.get("p", F.lit(0)).alias("p")).agg(F.avg("p")).first()[0]
    assert root == pytest.approx(1 / 3, abs=0.03)      # classes weigh the same before the rows' own weights


def test_two_nights_against_each_other(spark):
    builds = history(spark, 300, "a").unionByName(history(spark, 200, "b"))
    first = training.retrain_all(builds, F.lit(AS_OF), "v1", trees=5)
    trees = spark.read.parquet(first["models"])
    registry = training.registry_rows(training.gate_all(spark, first), first, F.lit(AS_OF))
    live = training.live_trees(registry, trees.unionByName(trees.withColumn("version", F.lit("v0"))))
    assert live.count() == 10 and {r.version for r in live.collect()} == {"v1"}
    second = training.retrain_all(builds, F.lit(AS_OF), "v2", trees=5, incumbents=live)
    both = spark.read.parquet(second["predictions"]).collect()
    assert len(both) == 100 and all(r.p == r.p_old for r in both)      # the same rows and draws
    gated = training.gate_all(spark, second).collect()
    assert all(r.old_precision == r.precision and r.ok_not_regressing for r in gated)


def test_versions_score_their_own_builds(spark):
    train = history(spark, 200, "a").unionByName(history(spark, 200, "b", risky=lambda i: i % 2 == 0))
    trees = training.fit_keys(train, ["tenant_id"], 5).withColumnRenamed("tenant_id", "version")
    trees = trees.unionByName(trees.filter("version = 'a'").withColumn("version", F.lit("base")))
    builds = history(spark, 30, "a").withColumn("version", F.when(F.col("hour_of_day") == 3, "b").otherwise("unknown"))
    got = {r.build_id: r for r in models.predict_by_version(trees, builds).collect()}
    assert len(got) == 30 and set(got["b00000"].asDict()) == {*builds.columns, "p"}
    own = {r.build_id: r.p for r in models.forests.predict(trees.filter("version = 'base'").withColumn("version", F.lit("x")), builds.withColumn("version", F.lit("x")), ["version"], "build_id").collect()}
    assert all(r.p == own[i] for i, r in got.items() if r.version == "unknown")


def test_scenarios_under_the_rule(spark):
    from deployrisk.functions.scalars import rule_risk
    got = {r.name: r.ok for r in models.scenario_check(models.scenarios(spark).withColumn("p", rule_risk())).collect()}
    assert got["friday_evening_large"] and got["tuesday_morning_small"]


DIFF = """noise before
diff --git a/src/app.go b/src/app.go
--- a/src/app.go
+++ b/src/app.go
@@ -10,2 +11,3 @@ func main() {
+func add(a int) int {
+    if a > 0 && ok { return a }
+// a comment
-func old() {}
@@ -30 +32 @@
+        x := 1
diff --git a/tests/test_x.py b/tests/test_x.py
+++ b/tests/test_x.py
@@ -0,0 +1,2 @@
+def test_x():
+    assert a or b
"""


def test_diff_and_structure(spark):
    df = spark.createDataFrame([("c", DIFF)], "change_id string, d string")
    files = change.diff_files(df, "d", ["change_id"])
    rows = files.orderBy("file_no").collect()
    assert [r.path for r in rows] == ["src/app.go", "tests/test_x.py"]
    assert [(h.start, h.length) for h in rows[0].hunks] == [(11, 3), (32, 1)]
    assert len(rows[0].added) == 4 and rows[0].removed == ["func old() {}"]
    row = change.structure(change.line_measures(change.classify(files)), ["change_id"]).first()
    assert (row.files, row.hunk_count, row.max_hunk_size) == (2, 3, 3)
    assert row.added_complexity == 2 and row.decls_added == 2 and row.decls_removed == 1
    assert row.max_nesting_depth == 2 and row.comment_ratio == round(1 / 6, 4)
    assert row.test_file_ratio == 0.5 and row.languages == "go,python"


@pytest.mark.parametrize("path,language,test,config", [
    ("src/App.PY", "python", False, False), ("a/.env", "other", False, False), ("pkg/x_test.go", "go", True, False),
    ("web/__tests__/a.ts", "typescript", True, False), ("k8s/prod.yaml", "other", False, True), ("Dockerfile", "other", False, True),
    ("a/b.spec.js", "javascript", True, False), ("README", "other", False, False)])
def test_paths(spark, path, language, test, config):
    row = change.classify(spark.createDataFrame([(path,)], "path string")).first()
    assert (row.language, row.is_test, row.is_config) == (language, test, config)


def plain_isotonic(p, y):
    """Pool adjacent violators over the distinct probabilities, and the straight line between their ends."""
    at = np.unique(p)
    blocks = [[x, x, y[p == x].sum(), (p == x).sum()] for x in at]
    i = 0
    while i + 1 < len(blocks):
        a, b = blocks[i], blocks[i + 1]
        if a[2] / a[3] >= b[2] / b[3]:
            blocks[i:i + 2] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]]]
            i = max(i - 1, 0)
        else:
            i += 1
    xs = [x for b in blocks for x in ([b[0], b[1]] if b[0] < b[1] else [b[0]])]
    ys = [b[2] / b[3] for b in blocks for _ in range(2 if b[0] < b[1] else 1)]
    return xs, ys


@pytest.mark.parametrize("slices", [256, 7])
def test_isotonic_scales_per_tenant(spark, monkeypatch, slices):
    from deployrisk.operators import calibration
    monkeypatch.setattr(calibration, "SLICES", slices)
    rng = np.random.default_rng(5)
    data = {t: (np.round(rng.random(n), 2 if t == "a" else 5), n) for t, n in (("a", 500), ("b", 300), ("c", 1))}
    data = {t: (p, (rng.random(n) < p ** 2).astype(int)) for t, (p, n) in data.items()}
    data["d"] = (np.array([0.2, 0.5, 1.0, 0.0]), np.array([1, 1, 0, 0]))
    rows = [(t, float(a), int(b)) for t, (p, y) in data.items() for a, b in zip(p, y)]
    scored = spark.createDataFrame(rows + [("none", None, 1)], "tenant_id string, p double, label int")
    scale = calibration.isotonic(scored.filter("tenant_id <> 'c'"), ["tenant_id"])
    want = {t: plain_isotonic(*data[t]) for t in ("a", "b", "d")}
    got = {r.tenant_id: (r["at"], r.share) for r in scale.collect()}
    assert set(got) == set(want)
    for t, (xs, ys) in want.items():
        assert got[t][0] == [float(x) for x in xs]
        np.testing.assert_allclose(got[t][1], ys)
    for r in calibration.calibrate(scale, scored, ["tenant_id"]).collect():
        assert r.p == (pytest.approx(float(np.interp(r.p_raw, *want[r.tenant_id]))) if r.tenant_id in want else r.p_raw)


def test_only_asked_neighbours_are_searched(spark, monkeypatch):
    monkeypatch.setattr(balance, "TILE", 16)
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", f"v{i:04d}", i % 7 == 0, *map(float, rng.normal(0, 1, 10))) for i in range(200)]
    df = spark.createDataFrame(rows, "tenant_id string, vid string, asked boolean, " + ", ".join(f"{f} double" for f in K.FEATURES))
    every = {(r.vid, r["rank"]): (r.other.vid, r.distance2) for r in balance.nearest(df.drop("asked"), ["tenant_id"], 5).collect()}
    some = balance.nearest(df, ["tenant_id"], 5)
    assert "asked" not in some.schema["other"].dataType.names
    assert {(r.vid, r["rank"]): (r.other.vid, r.distance2) for r in some.collect()} == {k: v for k, v in every.items() if int(k[0][1:]) % 7 == 0}


def test_builds_are_read_once_for_a_night(spark):
    builds = history(spark, 300)
    rows, report = training.prepare(builds, F.lit(AS_OF))
    assert rows.count() and report.count()
    for part in (rows, report):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "LocalTableScan" not in plan and "ExistingRDD" not in plan
