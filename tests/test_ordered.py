"""The sliced operators equal a plain window, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from deployrisk.operators.ordered import exact_quantiles, newest, over_preceding, with_position


def skewed(spark, rows=4000, seed=1):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "k": np.where(rng.random(rows) < 0.6, "hot", rng.integers(0, 30, rows).astype(str)),
        "t": rng.integers(0, 400000, rows), "id": np.arange(rows),
        "v": rng.normal(0, 1000, rows).round(2)})
    return spark.createDataFrame(frame)


def test_position_equals_row_number(spark):
    df = skewed(spark)
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1)
    got = with_position(df, ["k"], ["t", "id"]).select("id", "pos", "n")
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    both = plain.join(sizes, "k").join(got, "id")
    assert both.count() == df.count()
    assert both.filter((F.col("want") != F.col("pos")) | (F.col("size") != F.col("n"))).count() == 0


@pytest.mark.parametrize("chunk", [16, 50, 20000])
def test_preceding_frames_cross_chunks(spark, chunk):
    df = skewed(spark, 1500)
    frame = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-10, -1)
    aggregates = {"m": F.avg("v"), "top": F.max("v"), "mid": F.percentile("v", F.lit(0.5)), "c": F.count("v")}
    want = df.select("id", *[a.over(frame).alias(f"w_{n}") for n, a in aggregates.items()])
    got = over_preceding(df, ["k"], ["t", "id"], 10, aggregates, chunk=chunk)
    both = want.join(got, "id").toPandas()
    assert len(both) == 1500
    for name in aggregates:
        np.testing.assert_allclose(both[name].astype(float), both[f"w_{name}"].astype(float), atol=1e-6)


def test_own_row_never_counts(spark):
    """Flipping a row's own value leaves its history unchanged."""
    df = skewed(spark, 600)
    flipped = df.withColumn("v", F.when(F.col("id") == 77, F.lit(9e9)).otherwise(F.col("v")))
    ask = lambda d: over_preceding(d, ["k"], ["t", "id"], 10, {"m": F.avg("v")}, chunk=32).filter("id = 77").first().m
    assert ask(df) == ask(flipped)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    kept = [v for v in values if v is not None]
    got = exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.95}, count_as="n").collect()
    if not kept:
        assert got == []
        return
    want = np.percentile(kept, [25, 50, 95])
    np.testing.assert_allclose([got[0].a, got[0].b, got[0].c], want, rtol=1e-9, atol=1e-9)
    assert got[0].n == len(kept)


def test_quantiles_with_hot_key(spark):
    df = skewed(spark)
    got = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    want = df.groupBy("k").agg(F.median("v").alias("m")).collect()
    for row in want:
        assert got[row.k] == pytest.approx(row.m)


def test_unknown_keys_and_times_stay_in(spark):
    rows = [("a", 5, 1), ("a", None, 2), (None, 7, 3), (None, None, 4), (None, 3600 * 9, 5), ("", 1, 6)]
    df = spark.createDataFrame(rows, "k string, t long, id int")
    got = {r.id: (r.pos, r.n) for r in with_position(df, ["k"], ["t", "id"]).collect()}
    assert got == {1: (1, 2), 2: (0, 2), 3: (1, 3), 4: (0, 3), 5: (2, 3), 6: (0, 1)}


def test_newest_keeps_few_rows_before_the_shuffle(spark):
    plan = newest(skewed(spark), ["k"], ["t", "id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
