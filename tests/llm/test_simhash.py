import random

import numpy as np
import pytest
import xxhash

from deployrisk.llm import simhash
from deployrisk.llm.queries import QUERIES


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: {doc_id: fingerprint}"""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_golay_code():
    leaders, table = simhash._decoder()
    assert len(set(leaders.tolist())) == 2048  # perfect: an error of weight three or less for each syndrome
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    keys = simhash.golay_keys(words)
    for bit in range(23):
        near = simhash.golay_keys(words ^ (1 << bit))
        assert all(set(a) & set(b) for a, b in zip(keys.tolist(), near.tolist()))


def test_keys_meet_for_two_errors():
    rng = random.Random(2)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.choice([0, 1, 2])))
        ka, kb = (set(simhash.candidate_keys(np.array([x], np.uint64))[1].tolist()) for x in (a, b))
        assert ka & kb


def test_large_buckets_link_like_small_ones(monkeypatch):
    rng = random.Random(3)
    fps = [rng.getrandbits(64)]
    while len(set(fps)) < 60:
        fps.append(rng.choice(fps) ^ sum(1 << k for k in rng.sample(range(12), rng.choice([1, 2, 3]))))
    fps = np.array(sorted(set(fps)), np.uint64)
    reps = np.arange(len(fps)) * 7
    small = simhash.bucket_links(fps, reps, 2)
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 1)
    large = simhash.bucket_links(fps, reps, 2)
    assert [x.tolist() for x in small] == [x.tolist() for x in large]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(50)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(8)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(8, 60):
        w = rng.choice(base).split()
        w[rng.randrange(300)] = rng.choice(words)
        out.append((i, ("  " if i % 2 else "\n").join(w)))
    out += [(100, None), (101, ""), (102, " \n\t"), (103, "One"), (104, "one"), (105, "one two"), (None, base[0]), (5, base[5]),
            (106, "x " * 20000), (107, "é b C")]
    return out


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = plain_components(fps)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == fps[r.doc_id]
    assert len(set(want.values())) < len(want) - 20


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_query_on_given_table(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op10_simhash_golay"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps)
