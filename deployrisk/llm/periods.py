"""Runs of repeated words: maximal stretches with a period, by enhanced suffix arrays.

The words of a text are numbered, their suffixes sorted by doubling, and the common prefixes of neighbours in
that order give the LCP intervals, found with a stack of open intervals and no tree. A branching tandem is a
square whose next word breaks the period: two suffixes ``i`` and ``i + depth`` in different children of one
interval. For each interval only the suffixes of its smaller children are tried, both ways, by the inverse
suffix array: n log n trials in all. Each run ends in exactly one branching tandem of its smallest period;
rotated to the left as far as the words agree, the tandem becomes the run. Longer periods of the same stretch
are multiples of the smallest and are dropped.

Texts are first passed through a necessary condition: a run of at least ``least`` words holds a window of
``least // 2`` words twice. Texts without such a window have no runs. The others are taken together, about
``together`` words at a time, with words numbered apart for each text and ended by a word of their own, so that no
suffix meets one of another text. A longer text is taken alone; work and memory follow its length.

Defined results: null and empty texts have no words and no runs; every row is returned with its own result,
rows of one id too; a null id is carried along, and its words are not rewritten (``planted``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deployrisk.llm.common import WordHashes, slices, texts_of, window_hashes

SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs string, collapsed binary")
TRIALS = 1 << 18    # suffixes of smaller children tried at once, more only for a single child


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and their places; the last word must be unique."""
    size = len(words)
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(first, size))
    rank = np.empty(size, np.int64)
    rank[order] = np.repeat(first, sizes)          # a group's rank is its first place
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    step = 1
    while len(open_):
        suffixes = order[open_]
        key = rank[suffixes] * np.int64(size) + rank[suffixes + step]   # never past the end: that suffix would be alone
        by = np.argsort(key, kind="stable")
        key, order[open_] = key[by], suffixes[by]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(open_)))
        rank[order[open_]] = np.repeat(open_[heads], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order, rank


def common_prefixes(words: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """Words that each suffix shares with the one before it in order; 0 for the first."""
    text, size = words.tolist(), len(words)
    before = np.full(size, -1, np.int64)
    before[order[1:]] = order[:-1]
    by_place, length = [0] * size, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            length = 0
        else:
            while text[i + length] == text[j + length]:
                length += 1
        by_place[i] = length
        if length:
            length -= 1
    return np.asarray(by_place, np.int64)[order].tolist()


def smaller_children(lcp: list[int]) -> Iterator[np.ndarray]:
    """Rows of (interval start, end, depth, child start, end) for all but the largest child of each LCP interval."""
    found: list[tuple[int, int, int, int, int]] = []
    waiting = 0
    stack: list[tuple[int, list[int]]] = []     # depth, and where the children begin
    for place in range(1, len(lcp) + 1):
        depth = lcp[place] if place < len(lcp) else 0
        start = place - 1
        while stack and stack[-1][0] > depth:
            own, cuts = stack.pop()
            start = cuts[0]
            cuts.append(place)
            largest = max(range(len(cuts) - 1), key=lambda i: cuts[i + 1] - cuts[i])
            for i in range(len(cuts) - 1):
                if i != largest:
                    found.append((start, place, own, cuts[i], cuts[i + 1]))
                    waiting += cuts[i + 1] - cuts[i]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(place)
            else:
                stack.append((depth, [start, place]))
        if waiting >= TRIALS:
            yield np.array(found, np.int64)
            found, waiting = [], 0
    if found:
        yield np.array(found, np.int64)


def branching_tandems(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, half) of the squares that the next word breaks off, distinct, by end and half."""
    order, rank = suffix_array(words)
    ends, halves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for children in smaller_children(common_prefixes(words, order, rank)):
        sizes = children[:, 4] - children[:, 3]
        own = np.repeat(np.arange(len(children)), sizes)
        i = order[np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + children[own, 3]]
        low, high, depth, child, end = children[own].T
        for j, left in ((i + depth, i), (i - depth, i - depth)):
            there = rank[np.clip(j, 0, len(words) - 1)]
            hit = (j >= 0) & (j < len(words)) & (there >= low) & (there < high) & ((there < child) | (there >= end))
            ends.append(left[hit] + 2 * depth[hit])
            halves.append(depth[hit])
    return _distinct(np.concatenate(ends), np.concatenate(halves))


def _distinct(ends: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((halves, ends))
    ends, halves = ends[order], halves[order]
    new = np.ones(len(ends), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (halves[1:] != halves[:-1])
    return ends[new], halves[new]


def rotated(words: np.ndarray, end: int, half: int) -> int:
    """Where the run that ends in this square begins."""
    start, width = end - 2 * half, 64
    while start:
        width = min(width, start)
        other = words[start + half - width:start + half]
        differ = np.flatnonzero(words[start - width:start] != other)
        if len(differ):
            return start - width + int(differ[-1]) + 1
        start, width = start - width, width * 4
    return 0


def runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``least`` words and twice their period, by start and period.

    The last word must be unique.
    """
    ends, halves = branching_tandems(words)
    # short squares must go on to the left as far as the shortest run
    missing = least - 2 * halves
    for back in range(1, least - 1):
        wanted = missing >= back
        at = ends - 2 * halves - back
        there = ~wanted | ((at >= 0) & (words[np.maximum(at, 0)] == words[np.maximum(at, 0) + halves]))
        ends, halves, missing = ends[there], halves[there], missing[there]
    starts, kept = [], []
    last, known = -1, []
    for n, (end, half) in enumerate(zip(ends.tolist(), halves.tolist(), strict=True)):
        if end != last:
            last, known = end, []
        if any(half % period == 0 and start <= end - 2 * half for start, period in known):
            continue        # the same stretch by a multiple of its period
        start = rotated(words, end, half)
        known.append((start, half))
        starts.append(start)
        kept.append(n)
    start = np.array(starts, np.int64)
    end, period = ends[kept], halves[kept]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def planted(words: list[bytes], doc_id: int) -> list[bytes]:
    """Words of a text of which one in ten goes on in a circle from some word, decided by its id."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    at = g % len(words)
    period = 1 + (len(words) - at) // (3 + g % 8)
    circle = words[at:at + period]
    return words[:at] + (circle * (-(-(len(words) - at) // len(circle))))[:len(words) - at]


def _numbered(words: list[bytes], base: int) -> np.ndarray:
    """Own numbers for the words of a text from ``base`` on, and a last one for its end."""
    numbers: dict[bytes, int] = {}
    made = [numbers.setdefault(w, len(numbers)) for w in words]
    return np.array([*made, len(numbers)], np.int64) + base


def found_in(texts: list[list[bytes]], least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each text."""
    parts, base = [], 0
    for words in texts:
        parts.append(_numbered(words, base))
        base = int(parts[-1][-1]) + 1
    start, length, period = runs(np.concatenate(parts), least)
    edges = np.cumsum([0, *map(len, parts)])
    cuts = np.searchsorted(start, edges)
    return [(start[a:b] - edge, length[a:b], period[a:b]) for a, b, edge in zip(cuts[:-1], cuts[1:], edges[:-1], strict=True)]


def _row(words: list[bytes], found: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple:
    if found is None or not len(found[0]):
        return len(words), 0, None, None, None, None, "", b" ".join(words)
    start, length, period = found
    drops = np.zeros(len(words) + 1, np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, start + length, -1)
    stays = np.cumsum(drops)[:-1] == 0
    best = np.lexsort((period, start, -length))[0]
    s, n, p = int(start[best]), int(length[best]), int(period[best])
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    left = b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])
    return len(words), len(start), s, n, p, 1000 * n // p, listed, left


def find(docs: DataFrame, least: int = 12, plant: bool = False, together: int = 1 << 18) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_runs; start, length, period and exponent_milli of the longest
    run (smallest start, then period); ``runs``, all of them as ``start,length,period`` lines; and ``collapsed``, the
    words that no run holds after its first period, joined by a space.

    ``plant`` rewrites one text in ten first, see :func:`planted`.
    """
    window = least // 2

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", 2 << 20):
            ids = batch.column("doc_id").to_pylist()
            texts = [t.split() for t in texts_of(batch)]
            if plant:
                texts = [words if i is None else planted(words, i) for i, words in zip(ids, texts, strict=True)]
            found: list = [None] * len(texts)
            chosen: list[int] = []
            waiting = 0
            for n, words in enumerate(texts):
                if len(words) < least:
                    continue
                seen = window_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), window, 13)
                seen.sort()
                if not (seen[1:] == seen[:-1]).any():
                    continue
                chosen.append(n)
                waiting += len(words)
                if waiting >= together:
                    for k, r in zip(chosen, found_in([texts[k] for k in chosen], least), strict=True):
                        found[k] = r
                    chosen, waiting = [], 0
            if chosen:
                for k, r in zip(chosen, found_in([texts[k] for k in chosen], least), strict=True):
                    found[k] = r
            rows = [_row(words, r) for words, r in zip(texts, found, strict=True)]
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 6 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
