"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deployrisk.session import materialize

#: Words are runs of anything but space and the control characters 9 to 13; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        ends = np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64)
        ends = ends[batch.column(column).offset:][:batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts, nulls as empty ones."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``most`` of them; frequent words come early and stay."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(seed).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(count, np.uint64)
    for i, factor in enumerate(factors):
        total += words[i:i + count] * factor
    return mixed(total)


def stable_order(*keys: str) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in keys]


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back.

    The table outlives any executor, so the shuffles behind it are given back as soon as it stands
    instead of filling the disks until the driver next collects its garbage.
    """
    conf = frame.sparkSession.conf
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(frame, name)
    finally:
        conf.set(key, before)


def settled(rows: DataFrame, kept: list[str], computed: list[str]) -> DataFrame:
    """The columns with ``computed`` ones behind a generator.

    A filter on them is then not rewritten in terms of what they are made of, where an array that was built once
    a row would be built again for every element of another.
    """
    return rows.select(*kept, F.inline(F.array(F.struct(*computed))))
