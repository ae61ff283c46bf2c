"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into three segments, each padded with zeros to a 23-bit word of the
perfect binary Golay code. Every word lies within distance three of exactly one codeword, and words
one bit apart share a codeword among those within distance four (one or six of them): those are a
word's keys. Two fingerprints at most two bits apart have, by pigeonhole, one segment without an error
whose successor has one error at most, so they meet under (segment as it is, a key of the next one).

Rows: fingerprints are made distinct first, so copies are one node each. A bucket of fingerprints is
joined with itself inside its task and only a spanning forest of its verified links leaves it, so
links grow with the members of a bucket and not with their pairs. Components are found by passing
the smallest label along links with pointer jumping, one written table a round.

Defined results: a null or blank text has fingerprint zero, which links like any other; a null id takes
no part in linking and gets a null component; rows that share an id are each returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deployrisk.llm.common import slices, texts_of, written

#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: Buckets up to this size are compared pair by pair; larger ones by masking two bits at a time.
SMALL_BUCKET = 1024


# ---- fingerprints -------------------------------------------------------------------------------

def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The bits set in more than half the shingles' hashes, as an unsigned number."""
    words = text.lower().split()  # of bytes: A-Z only
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        runs = zip(*(words[i:] for i in range(shingle)), strict=False)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.fromiter((fingerprint(t, shingle, seed) for t in texts_of(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---- Golay keys ---------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome the error of weight three or less; and all errors of weight up to four, by syndrome.

    The second has a row per syndrome with the error of weight up to three first and then those of weight four;
    unused places repeat the first.
    """
    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - 11), rest)
        return rest

    errors = np.array([0], np.int64)
    by_weight = [errors]
    singles = np.int64(1) << np.arange(23, dtype=np.int64)
    for _ in range(4):
        grown = (by_weight[-1][:, None] | singles[None, :])[(by_weight[-1][:, None] < singles[None, :])]
        by_weight.append(grown)
    leaders = np.zeros(2048, np.int64)
    near = np.concatenate(by_weight[:4])
    leaders[syndrome(near)] = near
    table = np.repeat(leaders[:, None], 6, axis=1)
    filled = np.ones(2048, np.int64)
    found = syndrome(by_weight[4])
    weight = np.bitwise_count(leaders[found].view(np.uint64))
    for error, s in zip(by_weight[4][weight == 3], found[weight == 3], strict=True):
        table[s, filled[s]] = error
        filled[s] += 1
    return leaders, table


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Six 12-bit codeword indices for each 23-bit word (repeated where it has only one)."""
    _, table = _decoder()
    words = words.astype(np.int64)
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - 11), rest)
    return (words[:, None] ^ table[rest]) >> 11  # the code is systematic: the upper 12 bits name the codeword


def candidate_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: which segment, its bits, and a key of the next segment."""
    segments = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        near = golay_keys(segments[(i + 1) % 3])
        single = near[:, 1] == near[:, 0]
        exact = (np.int64(i) << 34) | (segments[i] << 12)
        for k in range(6):
            use = np.flatnonzero(~single) if k else np.arange(len(fps))
            rows.append(use)
            keys.append(exact[use] | near[use, k])
    return np.concatenate(rows), np.concatenate(keys)


# ---- links --------------------------------------------------------------------------------------

def _smallest_neighbour(labels: np.ndarray, fps: np.ndarray, most: int) -> np.ndarray:
    """Each row's smallest label among rows at most ``most`` bits away."""
    best = labels.copy()
    step = max(1, (1 << 20) // len(fps))
    for at in range(0, len(fps), step):
        near = np.bitwise_count(fps[at:at + step, None] ^ fps[None, :]) <= most
        best[at:at + step] = np.where(near, labels[None, :], len(fps)).min(axis=1)
    return best


def _masked_minimum(labels: np.ndarray, fps: np.ndarray, most: int) -> np.ndarray:
    """The same for large buckets: rows that agree after ``most`` bits are masked are that near."""
    best = labels.copy()
    varying = [b for b in range(64) if len(np.unique(fps >> np.uint64(b) & np.uint64(1))) > 1]
    masks = [0]
    for _ in range(most):
        masks = sorted({m | 1 << b for m in masks for b in varying} | set(masks))
    for mask in masks:
        _, group = np.unique(fps & np.uint64(~mask & (1 << 64) - 1), return_inverse=True)
        low = np.full(group.max() + 1, len(fps))
        np.minimum.at(low, group, labels)
        best = np.minimum(best, low[group])
    return best


def bucket_links(fps: np.ndarray, reps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one bucket: (member, smallest member it reaches)."""
    order = np.argsort(reps, kind="stable")
    fps, reps = fps[order], reps[order]
    labels = np.arange(len(fps))
    lower = _smallest_neighbour if len(fps) <= SMALL_BUCKET else _masked_minimum
    while True:
        found = lower(labels, fps, most)
        found = found[found]
        if (found == labels).all():
            break
        labels = found
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return reps[linked], reps[labels[linked]]


def links(classes: DataFrame, most: int = 2) -> DataFrame:
    """(u, v) between representatives of distinct fingerprints at most ``most`` bits apart, up to connectivity."""
    if most > 2:
        raise ValueError("three segments find fingerprints at most two bits apart")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            reps = batch.column("rep").to_numpy()
            for at in range(0, len(fps), 1 << 14):
                rows, keys = candidate_keys(fps[at:at + (1 << 14)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(fps[at:][rows].view(np.int64)), pa.array(reps[at:][rows])], ["key", "fp", "rep"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3

        def inside(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(keys)])
            fps = fps.view(np.uint64)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            twos = starts[sizes == 2]
            twos = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= most]
            us.append(np.maximum(reps[twos], reps[twos + 1]))
            vs.append(np.minimum(reps[twos], reps[twos + 1]))
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                u, v = bucket_links(fps[start:start + size], reps[start:start + size], most)
                us.append(u)
                vs.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        for batch in batches:
            rest = [np.concatenate([a, batch.column(n).to_numpy()]) for a, n in zip(rest, ("key", "fp", "rep"), strict=True)]
            if not len(rest[0]):
                continue
            cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on in the next batch
            yield inside(*(a[:cut] for a in rest))
            rest = [a[cut:] for a in rest]
        yield inside(*rest)

    keyed = classes.select("fp", "rep").mapInArrow(spread, "key long, fp long, rep long")
    return (keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, "u long, v long")
            .groupBy("u", "v").agg(F.lit(1).alias("seen")).select("u", "v"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node with an edge; the label is the smallest node it reaches."""
    both = written(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))), f"{name}-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), name)
    while True:
        heard = (both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("near")).agg(F.min("label").alias("heard")))
        heard = written(heard, f"{name}-heard")
        first = labels.join(heard, labels.node == heard.near).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        first = written(first, f"{name}-first")
        target = first.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = first.join(target, first.label == target.at).select("node", "old", F.least("label", "further").alias("label"))
        jumped = written(jumped, name)
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row; links join fingerprints at most ``most`` bits apart."""
    found = written(fingerprints(docs, shingle, seed), "fingerprints")
    classes = written(found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    labels = components(links(classes, most))
    named = classes.join(labels, classes.rep == labels.node, "left").select(
        "fp", F.coalesce("label", "rep").alias("component"))
    named = written(named, "fingerprint-components").withColumnRenamed("fp", "of")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return found.join(named, found.fp == named.of, "left").select("doc_id", "fp", component.alias("component_id"))
