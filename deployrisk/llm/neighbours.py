"""Nearest neighbours by randomly rotated one-bit codes.

Unit vectors are turned by a random rotation and each coordinate keeps its sign, packed into words, with one
scalar: how well the signs point along the vector. A query keeps four bits of each turned coordinate, one packed
plane for each bit, so its product with a code is four ANDs and bit counts a word. From it a cosine is estimated, and
the scalar bounds the estimate's error (``spread`` standard deviations). Vectors are reranked with the original
components in double precision, by falling upper bound, until that is below the last of the best exact cosines.

Equal vectors are one class that keeps as many of its smallest ids as an answer can show, so a vector that
is repeated thousands of times is compared once. Classes are dealt into groups of about ``group_rows``; the
queries pass each group in batches, so a task holds one group and one batch, and leaves a handful of rows
for each query.

Defined results: vectors that are null, zero, of another size than most, or hold null or non-finite
components take no part, as queries or candidates; ids that are null neither; equal scores go to the smaller
id; rows that repeat an id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deployrisk.llm.common import written


LEAST_GROUP = 2048


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits in 64-bit words, filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned unit vectors, and their cosines with the vectors themselves."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = units @ turn.T
    return _words(turned > 0), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def planes(queries: np.ndarray, turn: np.ndarray, bits: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turned unit queries in steps of a few bits: (a packed plane for each bit, lowest value, step, sum, what rounding took)."""
    turned = queries / np.linalg.norm(queries, axis=1, keepdims=True) @ turn.T
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-12) / ((1 << bits) - 1)
    levels = np.rint((turned - low) / step).astype(np.uint8)
    rounded = low + step * levels
    packed = np.stack([_words(levels >> j & 1) for j in range(bits)], axis=1)
    return packed, low, step, rounded.sum(axis=1, keepdims=True), np.linalg.norm(turned - rounded, axis=1, keepdims=True)


def upper_bounds(codes: np.ndarray, along: np.ndarray, queries: np.ndarray, turn: np.ndarray, spread: float, block: int = 1 << 13) -> np.ndarray:
    """Upper bounds of the cosines of each query (row) with each coded vector (column), from AND and bit counts."""
    size = turn.shape[0]
    packed, low, step, total, lost = planes(queries, turn)
    bounds = np.empty((len(queries), len(codes)), np.float32)
    for at in range(0, len(codes), block):
        own = codes[at:at + block]
        met = np.zeros((len(queries), len(own)), np.uint32)
        for j in range(packed.shape[1]):
            for w in range(own.shape[1]):
                met += np.bitwise_count(packed[:, j, w, None] & own[None, :, w]).astype(np.uint32) << np.uint32(j)
        ones = np.bitwise_count(own).sum(axis=1, dtype=np.int64)[None]
        scale = np.sqrt(size) * along[None, at:at + block]
        estimate = (2 * (low * ones + step * met) - total) / scale
        error = np.sqrt(np.maximum(1 - along[None, at:at + block] ** 2, 0) * size / max(size - 1, 1) + lost ** 2) / scale
        bounds[:, at:at + block] = estimate + spread * error
    return bounds


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    query, vectors = query.astype(np.float64), vectors.astype(np.float64)
    return vectors @ query / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(query))


def reranked(upper: np.ndarray, query: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of the vectors looked at: by falling bound, until it is below the ``most``-th exact cosine."""
    first = np.argpartition(-upper, min(8 * most, len(upper)) - 1)[:8 * most]
    looked, scores = [first], [cosines(query, vectors[first])]
    if len(first) == len(upper):
        return first, scores[0]
    top = np.partition(scores[0], -most)[-most:]
    kth = top[0]
    rest = np.flatnonzero(upper >= kth)
    rest = rest[~np.isin(rest, first, assume_unique=True)]
    rest = rest[np.argsort(-upper[rest], kind="stable")]
    for at in range(0, len(rest), 128):
        part = rest[at:at + 128]
        part = part[upper[part] >= kth]
        if not len(part):
            break
        looked.append(part)
        scores.append(cosines(query, vectors[part]))
        top = np.partition(np.concatenate([top, scores[-1]]), -most)[-most:]
        kth = top[0]
    return np.concatenate(looked), np.concatenate(scores)


def best(codes, along, vectors, reps, queries, turn, spread, most) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query the ids and cosines of its ``most`` nearest vectors in this group, and how many were reranked."""
    for at in range(0, len(queries), 64):
        part = queries[at:at + 64]
        upper = upper_bounds(codes, along, part, turn, spread)
        for i, query in enumerate(part):
            near, scores = reranked(upper[i], query, vectors, most)
            order = np.lexsort((reps[near], -scores))[:most]
            yield at + i, reps[near][order], scores[order], len(near)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: Column, nearest: int = 5, seed: int = 17, spread: float = 2.0, group_rows: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` of each row that ``queries`` picks, among all other rows.

    ``vectors`` has vec_id and embedding.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    size = sizes["size"]
    # classes of equal vectors, with their smallest ids
    rows = rows.filter(F.size("embedding") == size).groupBy("vec_id", "embedding").agg(F.lit(1).alias("one")).drop("one")
    rows = written(rows, "vectors")
    order = Window.partitionBy("embedding").orderBy("vec_id")
    members = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= nearest + 1)
    classes = written(members.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                      .select(F.get("ids", 0).alias("rep"), "embedding", "ids"), "vector-classes")
    asked = rows.filter(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("like"))
    asked = written(asked.join(classes, F.col("like") == F.col("embedding")).select("query_id", F.col("rep").alias("of")), "asked")
    there = classes.count()
    # a group for each core while the groups are not too small to be worth their own copy of the queries
    groups = max(1, -(-there // group_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, there // LEAST_GROUP))

    # each group's vectors first, then every query
    held = classes.select(F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "rep", "embedding")
    sent = classes.join(asked.select(F.col("of").alias("r")).distinct(), F.col("rep") == F.col("r"), "left_semi")
    sent = sent.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "rep", "embedding")
    turn, most = rotation(size, seed), nearest + 1

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, coded = None, [], None
        for whole in batches:
            keys = whole.column("group").to_numpy() * 2 + whole.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if start == stop:
                    continue
                batch = whole.slice(start, stop - start)
                own, kind = batch.column("group")[0].as_py(), batch.column("kind")[0].as_py()
                if own != group:
                    group, parts, coded = own, [], None
                matrix = batch.column("embedding").flatten().to_numpy().reshape(-1, size)
                reps = batch.column("rep").to_numpy()
                if kind == 0:
                    parts.append((*encode(matrix, turn), matrix.astype(np.float64), reps))
                    continue
                if coded is None and parts:
                    coded = [np.concatenate(x) for x in zip(*parts, strict=True)]
                if coded is None:
                    continue
                found = list(best(*coded, matrix, turn, spread, most))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(reps[[f[0] for f in found]], [len(f[1]) for f in found])),
                     pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["q", "rep", "score"])

    together = held.unionByName(sent).repartitionByRange(groups, "group").sortWithinPartitions("group", "kind", "rep")
    pairs = written(together.mapInArrow(compare, "q long, rep long, score double"), "near-classes")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    pairs = pairs.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= most)
    named = classes.select(F.col("rep").alias("c"), "ids")
    pairs = written(pairs.join(named, F.col("rep") == F.col("c")).select("q", "score", F.explode("ids").alias("vec_id")), "near-vectors")
    shown = asked.join(pairs, F.col("of") == F.col("q")).filter(F.col("query_id") != F.col("vec_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return shown.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
