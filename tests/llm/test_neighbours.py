import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from deployrisk.llm import neighbours
from deployrisk.llm.queries import QUERIES


def plain(rows, picks, nearest=5):
    """rows: {id: vector}"""
    ids = np.array(sorted(rows))
    matrix = np.array([rows[i] for i in ids], float)
    units = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for q in picks:
        scores = units @ units[np.searchsorted(ids, q)]
        order = [k for k in np.lexsort((ids, -np.round(scores, 12))) if ids[k] != q][:nearest]
        out[q] = [(int(ids[k]), float(scores[k])) for k in order]
    return out


def compare(got, want):
    hits = total = 0
    for q, near in want.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and len(own) == len(near)
        assert all(a.score >= b.score for a, b in zip(own, own[1:]))
        hits += len({r.vec_id for r in own} & {i for i, _ in near})
        total += len(near)
        found = dict(near)
        for r in own:
            if r.vec_id in found:
                assert r.score == pytest.approx(found[r.vec_id], abs=1e-12)
    return hits / total


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors, queries = rng.standard_normal((2000, 48)), rng.standard_normal((20, 48))
    turn = neighbours.rotation(48, 3)
    assert np.allclose(turn @ turn.T, np.eye(48))
    codes, along = neighbours.encode(vectors, turn)
    assert codes.dtype == np.uint64 and codes.shape == (2000, 1)
    true = np.array([neighbours.cosines(q, vectors) for q in queries])
    upper = neighbours.upper_bounds(codes, along, queries, turn, 2.5)
    assert (true <= upper).mean() > 0.99
    assert (upper - true).mean() < 0.4
    middle = neighbours.upper_bounds(codes, along, queries, turn, 0.0)
    assert abs((middle - true).mean()) < 0.01


def test_estimate_is_the_product_with_the_code():
    rng = np.random.default_rng(4)
    vectors, queries = rng.standard_normal((300, 100)), rng.standard_normal((7, 100))
    turn = neighbours.rotation(100, 3)
    codes, along = neighbours.encode(vectors, turn)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.sign(units @ turn.T) / 10
    packed, low, step, total, lost = neighbours.planes(queries, turn)
    turned = queries / np.linalg.norm(queries, axis=1, keepdims=True) @ turn.T
    rounded = low + step * np.rint((turned - low) / step)
    want = rounded @ signs.T / (units @ turn.T * signs).sum(axis=1)
    assert np.allclose(neighbours.upper_bounds(codes, along, queries, turn, 0.0, block=64), want, atol=1e-5)


def test_few_vectors_are_reranked():
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").sort_by("vec_id").column("embedding").drop_null().to_pylist()
    vectors = np.array(rows)
    turn = neighbours.rotation(vectors.shape[1], 17)
    codes, along = neighbours.encode(vectors, turn)
    queries = vectors[::50]
    looked = hits = 0
    for i, near, scores, count in neighbours.best(codes, along, vectors, np.arange(len(vectors)), queries, turn, 2.0, 6):
        looked += count
        hits += len(set(near) & set(np.argsort(-neighbours.cosines(queries[i], vectors), kind="stable")[:6].tolist()))
    assert looked < 0.18 * len(vectors) * len(queries)
    assert hits >= 0.98 * 6 * len(queries)


@pytest.mark.parametrize("group_rows", [1 << 16, 100])
def test_small_table(spark, group_rows):
    rng = np.random.default_rng(2)
    vectors = {i: rng.standard_normal(24).tolist() for i in range(600)}
    for i in range(600, 650):
        vectors[i] = vectors[0]
    vectors[5] = vectors[7]
    odd = [(700, None), (750, [0.0] * 24), (800, [float("nan")] * 24), (850, [1.0] * 23 + [None]), (900, [float("inf")] + [1.0] * 23), (950, [1.0] * 3), (None, vectors[1]), (7, vectors[7])]
    docs = spark.createDataFrame([(i, v, 1, "k") for i, v in [*vectors.items(), *odd]], "vec_id long, embedding array<double>, rank int, rep string")
    got = neighbours.search(docs, F.col("vec_id") % 50 == 0, group_rows=group_rows).collect()
    picks = [i for i in vectors if i % 50 == 0]
    assert {r.query_id for r in got} == set(picks)
    assert compare(got, plain(vectors, picks)) >= 0.99
    hot = sorted((r.rank, r.vec_id) for r in got if r.query_id == 600)
    assert [i for _, i in hot] == [0, 601, 602, 603, 604]


def test_few_rows(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.search(docs, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert neighbours.search(docs.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.search(docs.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = QUERIES["op9_one_bit_neighbours"](spark, sf).collect()
    recall = compare(got, plain(rows, [i for i in rows if i % 50 == 0]))
    assert recall >= 0.98
