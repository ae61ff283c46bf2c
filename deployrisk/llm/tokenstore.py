"""Token ids as binary shards with a keyed index.

Shards: documents are spread over shards by ranges of their ids, and of a hash of their texts where very many rows
share an id, and each task writes one file, the raw
little-endian ids of its documents in ascending order, 16 bits each where the vocabulary allows, else 32.
A file is written under the name of the task's attempt and renamed when complete, so a lost or repeated
task leaves one whole file.

Index: documents' keys are spread over buckets by hash, and each bucket holds a minimal perfect hash of its
keys: levels of bits in which a key owns the place where no other key of the level falls, the rest going to
the next level. A key's rank among the bits is its slot, which stores a fingerprint of the key and the
document's shard, place and length. A look-up hashes the key, reads one slot, and compares the fingerprint,
so unknown keys are told apart.

Defined results: null texts hold the end id alone; a null id comes first and is a key of its own; rows with
equal ids are told apart by their number (0, 1, ...) in the order of a hash of their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deployrisk.llm.common import mixed, slices, written
from deployrisk.llm.wordids import opened
from deployrisk.session import scratch_path

_FINGERPRINT = np.uint64(0x5851F42D4C957F2D)
_LEVEL = 0x9E3779B97F4A7C15


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


# ---- minimal perfect hash -----------------------------------------------------------------------

def key_hashes(ids: np.ndarray, missing: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """64-bit hashes of (id or null, number); distinct for distinct ids of one number."""
    numbers = numbers.astype(np.uint64) + (missing.astype(np.uint64) << np.uint64(40))
    return mixed(mixed(ids.astype(np.int64).view(np.uint64)) + numbers * np.uint64(_LEVEL))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ _FINGERPRINT) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bits; ``ranks`` counts the bits set before each 64-bit word."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype(np.int64) if len(words) else np.zeros(0, np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, load: float = 1.5) -> PerfectHash:
        sizes, words, rest = [], [], hashes
        while len(rest):
            if len(sizes) > 200:
                raise ValueError("two keys have the same hash")
            size = -(-int(len(rest) * load + 1) // 64) * 64
            places = cls.place(rest, len(sizes), size)
            alone = np.bincount(places, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[places]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(hashes + np.uint64(level * _LEVEL % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 where it is surely no key."""
        out, base, open_rows = np.full(len(hashes), -1), 0, np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = base + self.place(hashes[open_rows], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_rows[hit]] = (self.ranks[at >> 6] + below)[hit]
            open_rows, base = open_rows[~hit], base + size
        return out


# ---- writing ------------------------------------------------------------------------------------

def write(docs: DataFrame, path: str, folder: str, end_id: int, shard_bytes: int = 32 << 20, bucket_keys: int = 1 << 16) -> DataFrame:
    """Write shards and index below ``folder``; returns the written list of documents.

    (shard, doc_id, number, at, n_tokens, start): ``at`` counts ids from the shard's begin, ``start`` from the first shard's.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context = opened(path), TaskContext.get()
        shard, at, last, number = context.partitionId(), 0, (), 0
        files, root = filesystem(folder)
        name = f"{root}/shards/.{shard:06d}.{context.taskAttemptId()}"
        files.create_dir(f"{root}/shards", recursive=True)
        end = np.array([end_id], words.dtype).tobytes()
        with files.open_output_stream(name) as out:
            for batch in slices(batches, "text"):
                ids, sizes, numbers = batch.column("doc_id").to_pylist(), [], []
                for key, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                    data = words.encode(text or "") + end
                    out.write(data)
                    sizes.append(len(data) // words.dtype.itemsize)
                    number = number + 1 if last == (key,) else 0
                    last = (key,)
                    numbers.append(number)
                starts = at + np.cumsum([0, *sizes])
                at = int(starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), shard)), batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(starts[:-1]), pa.array(sizes, pa.int64())],
                    ["shard", "doc_id", "number", "at", "n_tokens"])
        files.move(name, f"{root}/shards/{shard:06d}.ids")

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(max(1, -(-total // shard_bytes)), *order).sortWithinPartitions(*order, "text")
    listed = written(ranged.mapInArrow(encode, "shard long, doc_id long, number long, at long, n_tokens long"), "token-rows")
    listed = _numbered_on(listed)

    # one row a shard: where each begins among all ids
    sums = listed.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = written(sums.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "shard-begins")
    placed = listed.join(begins, listed.shard == begins.s).select("shard", "doc_id", "number", "at", "n_tokens", (F.col("begin") + F.col("at")).alias("start"))
    placed = written(placed, "token-places")
    _write_index(placed, folder, max(1, -(-placed.count() // bucket_keys)))
    return placed


def _numbered_on(listed: DataFrame) -> DataFrame:
    """The rows with their numbers going on from shard to shard, for ids that more than one shard holds.

    Such an id ends one shard and begins the next, so there are fewer of them than shards.
    """
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    ends = listed.groupBy("shard").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    shared = ends.select("shard", F.explode(F.array_distinct(F.array("low", "high"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = written(shared.filter("n > 1").select(F.col("key.doc_id").alias("shared")), "shared-ids")
    if shared.isEmpty():
        return listed
    sizes = listed.join(shared, F.col("doc_id").eqNullSafe(F.col("shared"))).groupBy("shard", "shared").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shared").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select(F.col("shard").alias("of"), "shared", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "shared-offsets")
    joined = listed.join(offsets, (F.col("shard") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("shared")), "left")
    return joined.select("shard", "doc_id", (F.col("number") + F.coalesce("offset", F.lit(0))).alias("number"), "at", "n_tokens")


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "number"), F.lit(buckets)))


def _hashes_of(table: pa.Table) -> np.ndarray:
    ids = table.column("doc_id")
    return key_hashes(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), table.column("number").to_numpy())


def _write_index(placed: DataFrame, folder: str, buckets: int) -> None:
    """One row a bucket below ``folder``/index; buckets hold about as many keys whatever the data."""

    def build(group: pa.Table) -> pa.Table:
        hashes = _hashes_of(group)
        perfect = PerfectHash.build(hashes)
        order = np.argsort(perfect.slots(hashes))
        entries = np.stack([group.column(c).to_numpy() for c in ("shard", "at", "n_tokens", "start")], axis=1)[order]
        return pa.table({"bucket": group.column("bucket")[:1], "sizes": pa.array([perfect.sizes], pa.list_(pa.int64())), "bits": pa.array([perfect.words.tobytes()]),
                         "prints": pa.array([fingerprints(hashes)[order].tobytes()]), "entries": pa.array([entries.astype("<i8").tobytes()])})

    index = _hashed(placed, buckets).groupBy("bucket").applyInArrow(build, "bucket long, sizes array<long>, bits binary, prints binary, entries binary")
    index.withColumn("buckets", F.lit(buckets).cast("long")).write.parquet(f"{folder.rstrip('/')}/index")


# ---- reading ------------------------------------------------------------------------------------

def look_up(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, number, shard, at, n_tokens, start) of each distinct key that the index knows."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{folder.rstrip('/')}/index")
    first = index.select("buckets").first()
    if first is None:
        return spark.createDataFrame([], "doc_id long, number long, shard long, at long, n_tokens long, start long")

    def find(asked: pa.Table, known: pa.Table) -> pa.Table:
        names = ["shard", "at", "n_tokens", "start"]
        asked = asked.select(["doc_id", "number"])
        if not known.num_rows or not asked.num_rows:
            entries, found = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        else:
            bucket = known.slice(0, 1).to_pylist()[0]
            hashes = _hashes_of(asked)
            slots = PerfectHash(bucket["sizes"], np.frombuffer(bucket["bits"], "<u8")).slots(hashes)
            prints = np.frombuffer(bucket["prints"], np.uint32)
            found = np.flatnonzero((slots >= 0) & (prints[np.maximum(slots, 0)] == fingerprints(hashes)))
            entries = np.frombuffer(bucket["entries"], "<i8").reshape(-1, 4)[slots[found]]
        asked = asked.take(pa.array(found))
        return pa.table([*asked.columns, *(pa.array(entries[:, i]) for i in range(4))], names=["doc_id", "number", *names])

    asked = _hashed(keys.select(F.col("doc_id").cast("long"), F.col("number").cast("long")).distinct(), first[0])
    return asked.groupBy("bucket").cogroup(index.drop("buckets").groupBy("bucket")).applyInArrow(
        find, "doc_id long, number long, shard long, at long, n_tokens long, start long")


def read(places: DataFrame, folder: str, path: str) -> DataFrame:
    """The rows with ``ids``, read from the shards as little-endian 32-bit numbers."""
    dtype = opened(path).dtype

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        shard, file = None, None
        for batch in batches:
            for part in _even(batch):
                out = []
                for own, at, n in zip(*(part.column(c).to_pylist() for c in ("shard", "at", "n_tokens")), strict=True):
                    if own != shard:
                        if file:
                            file.close()
                        shard, file = own, files.open_input_file(f"{root}/shards/{own:06d}.ids")
                    file.seek(at * dtype.itemsize)
                    out.append(np.frombuffer(file.read(n * dtype.itemsize), dtype).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "ids"])
        if file:
            file.close()

    columns = ["doc_id", "number", "shard", "at", "n_tokens", "start"]
    spread = F.floor(F.col("at") / (1 << 20))  # a shard is read by several tasks
    rows = places.select(*columns).repartition("shard", spread).sortWithinPartitions("shard", "at")
    return rows.mapInArrow(load, ", ".join(f"{c} long" for c in columns) + ", ids binary")


def _even(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` ids, so that what is read stays small."""
    group = np.cumsum(batch.column("n_tokens").to_numpy()) // limit
    for start, stop in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]), strict=True):
        if stop > start:
            yield batch.slice(start, stop - start)


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "token-shards")
