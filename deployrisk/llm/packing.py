"""Best-fit packing of documents into sequences, by exact complements first.

Documents are encoded, ended with an end id and cut at the sequence length. What fits with what depends
on lengths alone, so only the number of pieces of each length (as many numbers as a sequence has places)
comes to the driver. There, for the longest length left, single lengths, pairs and triples whose sum
exactly fills its gap are looked up in an index of sums and consumed as often as the counts allow; what is
left is placed best fit, longest first, whole groups of equal pieces and equal gaps at a time. The plan has
a few thousand patterns however many pieces there are.

Pieces learn their place in three steps that no length, however frequent, can crowd: each task numbers
its pieces of a length as it writes them, the tasks' counts are added up by length, and the plan's
intervals turn the number into a sequence and an offset.

Defined results: a null or empty text is one piece that holds the end id alone; rows with equal or null ids
are packed like any others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deployrisk.llm.common import slices, written
from deployrisk.llm.wordids import opened

Pattern = tuple[list[tuple[int, int]], int]


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth): pieces of at most ``capacity`` ids, little-endian 32-bit.

    ``part`` is the task and ``nth`` the piece's number among those of its length there.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = opened(path), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, "text"):
            rows, out = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(np.frombuffer(words.encode(text or ""), words.dtype).astype("<u4"), np.uint32(end_id))
                for start in range(0, len(ids), capacity):
                    own = ids[start:start + capacity]
                    rows.append((at, start // capacity, start, len(own), part, seen[len(own)]))
                    seen[len(own)] += 1
                    out.append(own.tobytes())
            at, piece, start, length, parts, nth = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(out, pa.binary()), pa.array(parts), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, part long, nth long")


# ---- the plan -----------------------------------------------------------------------------------

def _pair(left: np.ndarray, total: int, most: int) -> list[int] | None:
    """Two available lengths of this sum, the longest first part that there is."""
    high = min(total - 1, most)
    low = (total + 1) // 2
    if high < low:
        return None
    first = np.arange(high, low - 1, -1)
    fits = (left[first] > 0) & (left[total - first] > 0)
    if total % 2 == 0:
        fits[-1] = left[low] > 1
    at = int(fits.argmax())
    return [int(first[at]), total - int(first[at])] if fits[at] else None


def _complement(left: np.ndarray, sums: np.ndarray, gap: int, most: int) -> list[int] | None:
    """One, two or three available lengths that fill the gap; ``sums`` holds which sums two lengths can have."""
    if left[gap] > 0:
        return [gap]
    found = _pair(left, gap, most)
    if found:
        return found
    firsts = np.flatnonzero((left[:gap] > 0) & sums[gap - np.arange(gap)])[::-1]
    for first in firsts[firsts <= most]:
        left[first] -= 1
        found = _pair(left, gap - int(first), int(first))
        left[first] += 1
        if found:
            return [int(first), *found]
    return None


def exact_patterns(left: np.ndarray) -> list[Pattern]:
    """Patterns without a gap; takes what they use from the counts."""
    capacity, out = len(left) - 1, []
    if left[capacity]:
        out.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    for longest in range(capacity - 1, 0, -1):
        if not left[longest]:
            continue
        there = (left > 0).astype(np.int64)
        sums = np.convolve(there, there)[:capacity + 1] > 0
        while left[longest]:
            left[longest] -= 1
            found = _complement(left, sums, capacity - longest, longest)
            left[longest] += 1
            if not found:
                break
            uses = Counter([longest, *found])
            times = min(int(left[k]) // n for k, n in uses.items())
            for k, n in uses.items():
                left[k] -= n * times
            out.append((sorted(uses.items(), reverse=True), times))
    return out


def best_fit_patterns(left: np.ndarray) -> list[Pattern]:
    """Patterns for the rest: longest first, each into the smallest gap that holds it."""
    capacity = len(left) - 1
    open_bins: dict[int, list[Pattern]] = {}
    number = np.zeros(capacity + 1, np.int64)

    def put(gap: int, items: list[tuple[int, int]], times: int) -> None:
        if times:
            open_bins.setdefault(gap, []).append((items, times))
            number[gap] += 1

    for length in range(capacity, 0, -1):
        rest = int(left[length])
        while rest:
            gaps = np.flatnonzero(number[length:])
            gap, items, times = capacity, [], rest
            if len(gaps):
                gap = int(gaps[0]) + length
                items, times = open_bins[gap].pop()
                number[gap] -= 1
            each = gap // length
            full = min(times, rest // each)
            if full:
                put(gap - each * length, [*items, (length, each)], full)
                rest -= full * each
                used = full
            else:
                put(gap - rest * length, [*items, (length, rest)], 1)
                rest, used = 0, 1
            if len(gaps):
                put(gap, items, times - used)
        left[length] = 0
    return [pattern for gap in sorted(open_bins) for pattern in open_bins[gap]]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    return exact_patterns(left) + best_fit_patterns(left)


def intervals(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first number, sequence base, how many in a sequence, offset), by length and first number."""
    rows, given, base = [], Counter(), 0
    for items, times in patterns:
        offset = 0
        for length, each in items:
            rows.append((length, given[length], base, each, offset))
            given[length] += times * each
            offset += length * each
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` instead of ``part`` and ``nth``; ``rows`` must be a written table."""
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "piece-counts")
    # at most `capacity` rows reach the driver
    patterns = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    steps = intervals(patterns)
    edges = np.searchsorted(steps[:, 0], np.arange(capacity + 2))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    firsts = written(firsts, "piece-firsts")
    # both grow with the pieces, so neither is sent whole to every task
    numbered = rows.join(firsts.hint("merge"), (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    kept = [c for c in rows.columns if c not in ("part", "nth")]

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                step = steps[edges[length]:edges[length + 1]]
                step = step[np.searchsorted(step[:, 1], numbers[own], "right") - 1]
                turn = numbers[own] - step[:, 1]
                sequence[own] = step[:, 2] + turn // step[:, 3]
                offset[own] = step[:, 4] + turn % step[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return numbered.select(*kept, (F.col("first") + F.col("nth")).alias("number")).mapInArrow(put, f"{types}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ``ids`` on request."""
    found = pieces(docs, path, end_id, capacity)
    columns = ["doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth"]
    return place(written(found.select(*columns, *(["ids"] if with_ids else [])), "pieces"), capacity)
