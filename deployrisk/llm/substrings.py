"""Substring dedup: seed, join on winnowed anchors, extend, keep repeats over the length threshold.

A repeat is a run of at least ``length`` words. Each run of ``length`` words holds ``length - seed + 1``
runs of ``seed`` words; the one with the smallest hash (leftmost among equals) is its anchor, so equal
runs have equal anchors at equal places (winnowing). About two in ten positions are anchors.

1. Anchors that occur in two different texts are the seeds; both sides of that are aggregated per
   task first, so a passage that a third of all documents share is one row a task.
2. Seeds go back to the documents that hold them. Exact copies of a text need no seeds: the first one
   stands for them, and the others go altogether.
3. Around each seed every run of ``length`` words whose anchor it is is hashed (96 bits), which extends
   the match by up to ``length - seed`` words both ways; the first document of each run is found, and
   later documents' runs merge into maximal repeats that are removed.

Two texts that share an anchor are never paired with each other, so work grows with the words.

Defined results: a null or blank text has no words; a null id takes no part and loses nothing; rows with
equal ids never remove each other's words; texts shorter than ``length`` words lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deployrisk.llm.common import WordHashes, slices, texts_of, window_hashes, written

#: Seeds of the three hashes: of anchors, and of the two parts of a run's.
ANCHOR, RUN, CHECK = 11, 12, 13
_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of each run of ``length`` words."""
    grams = window_hashes(hashes, seed, ANCHOR)
    within = length - seed + 1
    if len(grams) < within:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    places = np.lib.stride_tricks.sliding_window_view(grams, within).argmin(axis=1)
    places = places + np.arange(len(places))
    return grams[places], places


def covered(starts: np.ndarray, length: int, words: int) -> np.ndarray:
    """Which words lie in a run that begins at one of ``starts``."""
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def anchor_rows(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, t) for the distinct anchors of each text; t is the text's hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [np.unique(anchors(word_hashes(t.split()), length, seed)[0]) for t in texts_of(batch)]
            sizes = [len(x) for x in found]
            kinds = np.repeat(batch.column("t").to_numpy(), sizes)
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(kinds)], ["anchor", "t"])

    return docs.select("text", "t").mapInArrow(run, "anchor long, t long")


def run_rows(seeded: DataFrame, length: int, seed: int) -> DataFrame:
    """(w, x, doc_id, place) for each run of words whose anchor is among the row's ``seeds``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, kinds = batch.column("doc_id").to_numpy(), batch.column("t").to_numpy()
            parts = []
            for i, text in enumerate(texts_of(batch)):
                hashes = word_hashes(text.split())
                found, _ = anchors(hashes, length, seed)
                known = batch.column("seeds")[i].values.to_numpy().view(np.uint64)
                starts = np.flatnonzero(np.isin(found, known))
                tag = (int(kinds[i]) & 0x7FFFFFFF) << 32  # tells rows with the same id apart
                parts.append((window_hashes(hashes, length, RUN)[starts], window_hashes(hashes, length, CHECK)[starts],
                              np.full(len(starts), ids[i]), starts | tag))
            w, x, doc, place = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.view(np.int64)), pa.array(x.astype(np.uint32).view(np.int32)), pa.array(doc), pa.array(place)],
                ["w", "x", "doc_id", "place"])

    return seeded.select("doc_id", "t", "text", "seeds").mapInArrow(run, "w long, x int, doc_id long, place long")


def kept_rows(flagged: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kinds, copies = batch.column("t").to_pylist(), batch.column("copy").to_pylist()
            places, counts, gone, kept = batch.column("places"), [], [], []
            for i, text in enumerate(texts_of(batch)):
                words = text.split()
                counts.append(len(words))
                if copies[i] and len(words) >= length:
                    gone.append(len(words))
                    kept.append(b"")
                    continue
                removed = 0
                if places[i].is_valid and kinds[i] is not None:
                    own = places[i].values.to_numpy()
                    own = own[own >> 32 == (kinds[i] & 0x7FFFFFFF)] & 0xFFFFFFFF
                    mask = covered(own, length, len(words))
                    removed = int(mask.sum())
                    words = list(compress(words, (~mask).tolist()))
                gone.append(removed)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return flagged.select("doc_id", "t", "text", "places", "copy").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, length: int = 13, seed: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left once runs seen in a document of smaller id are gone."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    known = docs.filter("doc_id is not null")

    # copies of a whole text: the smallest id stands for them
    named = written(known.select("doc_id", "t", F.md5("text").alias("digest")), "digests")
    groups = written(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("t").alias("t"), F.max("doc_id").alias("last")), "texts")
    repeated = groups.filter("first < last").select(F.col("digest").alias("d"), "first")
    copies = named.join(written(repeated, "copied"), F.col("digest") == F.col("d")).filter("doc_id > first")
    copies = copies.select("doc_id", "t", F.lit(True).alias("copy"))

    # seeds: anchors in two different texts
    found = written(anchor_rows(known, length, seed), "anchors")
    seeds = (found.groupBy("anchor").agg(F.min("t").alias("low"), F.max("t").alias("high"))
             .filter("low < high").select(F.col("anchor").alias("a")))
    held = written(found.join(written(seeds, "seeds"), F.col("anchor") == F.col("a")).select("t", "anchor"), "held-seeds")
    sets = held.groupBy(F.col("t").alias("of")).agg(F.collect_set("anchor").alias("seeds"))
    texts = groups.select(F.col("first").alias("id"), F.col("t").alias("kind"))
    wanted = written(texts.join(sets, F.col("kind") == F.col("of")).select("id", "kind", "seeds"), "seeded")

    # runs around the seeds, and the first document of each
    seeded = known.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("t") == F.col("kind")))
    runs = written(run_rows(seeded, length, seed), "runs")
    firsts = (runs.groupBy("w", "x").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
              .filter("first < last").select(F.col("w").alias("rw"), F.col("x").alias("rx"), "first"))
    later = runs.join(written(firsts, "first-runs"), (F.col("w") == F.col("rw")) & (F.col("x") == F.col("rx"))).filter("doc_id > first")
    later = written(later.select("doc_id", "place"), "later-runs")
    places = later.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    return kept_rows(_flagged(docs, written(places, "places"), written(copies, "copies")), length)


def _flagged(docs: DataFrame, places: DataFrame, copies: DataFrame) -> DataFrame:
    """Each row with its places and whether it is a later copy; both are keyed by id, so one shuffle of the texts does."""
    flags = (places.select("doc_id", "places", F.lit(None).cast("long").alias("t"))
             .unionByName(copies.select("doc_id", F.lit(None).cast("array<long>").alias("places"), "t"))
             .groupBy(F.col("doc_id").alias("id")).agg(F.first("places", ignorenulls=True).alias("places"), F.collect_set("t").alias("copied")))
    joined = docs.join(flags, docs.doc_id == flags.id, "left")
    return joined.withColumn("copy", F.coalesce(F.array_contains("copied", F.col("t")), F.lit(False)))
