"""Forests of many keys as tables of trees."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators import forests, models, training
from deployrisk.session import materialize, scratch_path

FEATURES = K.FEATURES
COLUMNS = "tenant_id string, build_id string, label int, weight double, " + ", ".join(f"{f} double" for f in FEATURES)


def made(n, tenant, seed, noise=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 10)), 3)
    x[:, 6] = rng.integers(0, 2, n)
    x[:, 7] = 4.0
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.7) | (x[:, 6] == 1) & (x[:, 2] > 1)) ^ (rng.random(n) < noise)
    return [(tenant, f"{tenant}-{i}", int(y[i]), 1.0 + i % 3, *map(float, x[i])) for i in range(n)]


def auc(p, y):
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p))
    ranks[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        ranks[p == v] = ranks[p == v].mean()
    y = np.asarray(y)
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def tables(spark):
    train = [r for t, n, s in (("a", 700, 1), ("b", 300, 2), ("c", 8, 3)) for r in made(n, t, s)] + [("one", f"o{i}", 1, 1.0, *[float(i)] * 10) for i in range(20)]
    return spark.createDataFrame(train, COLUMNS).repartition(3), spark.createDataFrame([r for t, s in (("a", 11), ("b", 12), ("zz", 5)) for r in made(400, t, s)], COLUMNS)


def listed(trees):
    return {(r.tenant_id, r.tree): (r.node, r.feature, r.threshold, r.p, r.weight) for r in trees.collect()}


def test_forests_rank_like_mllib(spark, tables):
    train, test = tables
    trees = forests.fit(train, ["tenant_id"], "build_id", 60)
    got = {}
    for r in forests.predict(trees, test, ["tenant_id"], "build_id").select("tenant_id", "label", "p").collect():
        got.setdefault(r.tenant_id, []).append((r.p, r.label))
    assert set(got) == {"a", "b"}       # no forest, no row
    for tenant, rows in got.items():
        p, y = map(np.array, zip(*rows))
        mllib = models.fit_forest(train.filter(F.col("tenant_id") == tenant), 60)
        q = models.predict(mllib, test.filter(F.col("tenant_id") == tenant)).select("p", "label").collect()
        assert auc(p, y) > auc(np.array([r.p for r in q]), [r.label for r in q]) - 0.03
        assert auc(p, y) > 0.8


def test_trees_are_well_formed(tables):
    train, _ = tables
    rows = forests.fit(train, ["tenant_id"], "build_id", 12).collect()
    assert sorted((r.tenant_id, r.tree) for r in rows) == sorted((t, i) for t in ("a", "b", "c", "one") for i in range(12))
    for r in rows:
        known = dict(zip(r.node, zip(r.feature, r.weight, r.p)))
        assert r.node == sorted(known) and max(r.node) < 1 << 9
        for node, (feature, weight, p) in known.items():
            assert 0 <= p <= 1
            assert (2 * node in known) == (2 * node + 1 in known) == (feature >= 0)
            if feature >= 0:
                assert known[2 * node][1] + known[2 * node + 1][1] == pytest.approx(weight)
        if r.tenant_id == "one":
            assert r.node == [1] and r.p[0] in (0.0, 1.0)
        assert 7 not in r.feature       # it never varies


def test_levels_over_several_blocks_grow_the_same_trees(tables, monkeypatch):
    train, _ = tables
    whole = listed(forests.fit(train, ["tenant_id"], "build_id", 12))
    monkeypatch.setattr(forests, "BLOCK", 150)
    cut = listed(forests.fit(train, ["tenant_id"], "build_id", 12))
    assert set(cut) == set(whole)
    for key, (node, feature, threshold, p, weight) in whole.items():
        assert cut[key][:2] == (node, feature) and cut[key][2] == threshold
        np.testing.assert_allclose(cut[key][3], p, atol=1e-12)
        np.testing.assert_allclose(cut[key][4], weight)


def test_counts_and_draws_against_plain_python():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    drawn = forests.draws(ids, 5, 42)
    assert abs(drawn.mean() - 1) < 0.06 and abs(drawn.var() - 1) < 0.12 and (drawn != forests.draws(ids, 6, 42)).any()
    block = forests.Block(rng.integers(0, 6, (4000, 10)).astype(np.uint8), rng.integers(0, 2, 4000).astype(np.uint8), rng.random(4000), ids)
    growth = forests.Growth()
    tree = forests.grow(block, 5, growth)
    root = forests.counts(block, 5, np.array([1]), np.ones(4000, int), growth)
    features = forests.tried(np.array([1]), 5, 10, 42)[0]
    assert len(set(features.tolist())) == 4
    best = (0.0, None)
    gini = lambda w, y: 0.0 if not w.sum() else 2 * w[y == 1].sum() * w[y == 0].sum() / w.sum()
    w, y = block.weight * drawn, block.label
    for j, f in enumerate(features):
        for cut in range(31):
            left = block.bins[:, f] <= cut
            if drawn[left].sum() < 3 or drawn[~left].sum() < 3:
                continue
            best = max(best, (gini(w, y) - gini(w[left], y[left]) - gini(w[~left], y[~left]), -j))
        np.testing.assert_allclose(root[0, j, :6, 1], [w[(block.bins[:, f] == b) & (y == 1)].sum() for b in range(6)])
    assert tree.gain[0] == pytest.approx(best[0]) and tree.feature[0] == features[-best[1]]


def test_scores_equal_mllib(spark, tables):
    """A saved MLlib forest, read as a table of trees, scores the same."""
    train, test = tables
    model = models.fit_forest(train, 15)
    path = scratch_path(spark, "mllib")
    model.save(path)
    assert isinstance(RandomForestClassificationModel.load(path), RandomForestClassificationModel)
    trees = forests.from_saved(spark.read.parquet(f"{path}/data")).withColumn("version", F.lit("base"))
    ours = forests.predict(trees, test.withColumn("version", F.lit("base")), ["version"], "build_id").select("build_id", "p")
    pairs = ours.join(models.predict(model, test).select("build_id", F.col("p").alias("q")), "build_id").collect()
    assert len(pairs) == 1200 and max(abs(r.p - r.q) for r in pairs) < 1e-9
    found = forests.importances(trees, ["version"]).first().importances
    np.testing.assert_allclose(found, models.importance_array(model), atol=1e-9)


def test_blocks_of_scored_rows(tables, monkeypatch):
    train, test = tables
    trees = forests.fit(train, ["tenant_id"], "build_id", 7)
    whole = {r.build_id: r.p for r in forests.predict(trees, test, ["tenant_id"], "build_id").collect()}
    monkeypatch.setattr(forests, "BLOCK", 90)
    assert {r.build_id: r.p for r in forests.predict(trees, test, ["tenant_id"], "build_id").collect()} == whole
    assert forests.predict(trees, test.limit(0), ["tenant_id"], "build_id").count() == 0
    assert forests.fit(train.limit(0), ["tenant_id"], "build_id", 3).count() == 0


def test_importances(tables):
    train, _ = tables
    found = {r.tenant_id: r.importances for r in forests.importances(forests.fit(train, ["tenant_id"], "build_id", 30), ["tenant_id"]).collect()}
    assert sum(found["a"]) == pytest.approx(1) and max(found["a"]) == found["a"][0] and found["a"][7] == 0
    assert found["one"] == [0.0] * 10


def test_counts_are_summed_some_blocks_and_nodes_at_a_time(tables, monkeypatch):
    train, _ = tables
    whole = listed(forests.fit(train, ["tenant_id"], "build_id", 6))
    for name, value in (("BLOCK", 90), ("SUMMED", 2), ("NODE_GROUP", 3)):
        monkeypatch.setattr(forests, name, value)
    cut = listed(forests.fit(train, ["tenant_id"], "build_id", 6))
    assert set(cut) == set(whole)
    for key, (node, feature, threshold, p, weight) in whole.items():
        assert cut[key][:2] == (node, feature) and cut[key][2] == threshold
        np.testing.assert_allclose(cut[key][3], p, atol=1e-12)


def test_one_forest_over_all_rows_ranks_like_mllib(tables, monkeypatch):
    train, test = tables
    rows = train.drop("weight").filter("tenant_id <> 'one'")
    monkeypatch.setattr(forests, "BLOCK", 300)      # of all tenants together, in several blocks
    grown = training.fit_all(rows, 60)
    assert grown.count() == 60 and grown.select("forest").distinct().count() == 1
    found = training.predict_all(grown, test).select("label", "p").collect()
    other = models.predict(models.fit_forest(rows, 60), test).select("label", "p").collect()
    assert len(found) == test.count()
    ours, mllib = (auc(np.array([r.p for r in part]), [r.label for r in part]) for part in (found, other))
    assert ours > mllib - 0.03


def test_keys_of_some_blocks_need_no_summed_levels(tables, monkeypatch):
    train, _ = tables
    whole = listed(forests.fit(train, ["tenant_id"], "build_id", 6))
    written = []
    monkeypatch.setattr(forests, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(forests, "BLOCK", 90)
    assert listed(forests.fit(train, ["tenant_id"], "build_id", 6)) == whole
    assert "forest-level" not in written


def test_counts_of_bundles_of_blocks(tables, monkeypatch):
    train, _ = tables
    whole = listed(forests.fit(train, ["tenant_id"], "build_id", 6))
    for name, value in (("BLOCK", 10), ("HELD", 4), ("BUNDLE", 4), ("SUMMED", 3), ("NODE_GROUP", 3)):
        monkeypatch.setattr(forests, name, value)
    cut = listed(forests.fit(train, ["tenant_id"], "build_id", 6))
    assert set(cut) == set(whole)
    for key, (node, feature, threshold, p, weight) in whole.items():
        assert cut[key][:2] == (node, feature) and cut[key][2] == threshold
        np.testing.assert_allclose(cut[key][3], p, atol=1e-12)
        np.testing.assert_allclose(cut[key][4], weight)


def test_blocks_of_one_key_grow_the_tree_of_all_rows():
    """Whether labels decide the weights, or do in some blocks only, or rows have their own; with more features than a word holds."""
    rng = np.random.default_rng(8)
    n, growth = 3000, forests.Growth()
    label = rng.integers(0, 2, n).astype(np.uint8)
    ids = rng.integers(0, 1 << 63, n).astype(np.uint64)
    for width in (10, 30):
        bins = rng.integers(0, 32, (n, width)).astype(np.uint8)
        bins[:, 1] = np.minimum(bins[:, 1], 30 * label)
        classes = np.where(label == 1, 1.25, 0.75)
        for weight in (classes, np.where(np.arange(n) < 1000, classes, 0.5), rng.integers(1, 9, n) / 8):
            whole = forests.grow(forests.Block(bins, label, weight, ids), 3, growth)
            order = np.argsort(label[:500], kind="stable")      # the first blocks have one label each
            parts = [order[:200], np.sort(order[200:]), np.arange(500, 1000), np.arange(1000, n)]
            cut = forests.grow_together([forests.Packed.of(forests.Block(bins[q], label[q], weight[q], ids[q])) for q in parts], 3, growth, width)
            for a, b in zip(vars(whole).values(), vars(cut).values(), strict=True):
                np.testing.assert_array_equal(a, b)
            drawn = forests.draws(ids, 3, growth.seed)
            assert whole.weight[0] == (weight * drawn).sum() and whole.p[0] == pytest.approx((weight * drawn)[label == 1].sum() / whole.weight[0])


def test_walks_of_many_thresholds_and_unknown_values():
    """More thresholds than places in a word, deep trees, missing values: as a plain walk."""
    rng = np.random.default_rng(4)
    trees = []
    for _ in range(40):
        node, feature, threshold, p, open_ = [], [], [], [], [1]
        while open_:
            at = open_.pop(0)
            inner = at < 4 or (at < 1 << 11 and rng.random() < 0.7)
            node.append(at), feature.append(int(rng.integers(0, 10)) if inner else -1), p.append(float(rng.random()))
            threshold.append(float(rng.normal()) if inner else 0.0)
            open_ += [2 * at, 2 * at + 1] if inner else []
        trees.append({"node": node, "feature": feature, "threshold": threshold, "p": p})
    values = rng.normal(size=(300, 10))
    values[rng.random(values.shape) < 0.05] = np.nan
    values[:40, 0] = [t["threshold"][0] for t in trees]
    found = forests.walked(values, pa.Table.from_pylist(trees, pa.schema([("node", pa.list_(pa.int32())), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))])))
    for row, p in zip(values, found, strict=True):
        plain = []
        for t in trees:
            at, known = 1, {n: i for i, n in enumerate(t["node"])}
            while t["feature"][known[at]] >= 0:
                at = 2 * at + bool(row[t["feature"][known[at]]] > t["threshold"][known[at]])
            plain.append(t["p"][known[at]])
        assert p == pytest.approx(np.mean(plain), abs=1e-12)
