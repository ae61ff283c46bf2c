"""Line dedup by overlapping windows of three lines.

Lines that hold a word are numbered within their document; each three consecutive ones are a window, hashed to
96 bits. A window that occurs more than once, anywhere, is repeated; its first occurrence, by document id and
line, stays, and the lines covered by any later occurrence go. Windows are judged on the input.

A window that a third of all documents share is aggregated in every task first, and met again by a join
whose frequent keys Spark splits.

Defined results: lines without a word are never removed and belong to no window; null texts stay null; a null
id takes no part; rows with equal id and text are one document and lose the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.llm.common import WORD, settled, written


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, tag, at, w, x): each window by the number of its first line."""
    worded = docs.select("doc_id", "tag", F.filter(_lines(F.col("text")), lambda line: line.rlike(WORD)).alias("own"))
    worded = worded.filter(F.size("own") >= size)
    run = lambda i: [F.get("own", i + k) for k in range(size)]
    made = F.transform(F.sequence(F.lit(0), F.size("own") - size), lambda i: F.struct(
        i.alias("at"), F.xxhash64(*run(i)).alias("w"), F.hash(F.lit("check"), *run(i)).alias("x")))
    return worded.select("doc_id", "tag", F.inline(made))


def repeated_starts(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, tag, starts): first lines of the windows that occurred before."""
    found = written(windows(docs, size), "line-windows")
    firsts = (found.groupBy(F.col("w").alias("rw"), F.col("x").alias("rx"))
              .agg(F.min(F.struct("doc_id", "tag", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    later = found.join(written(firsts, "first-windows"), (F.col("w") == F.col("rw")) & (F.col("x") == F.col("rx")))
    later = later.filter(F.struct("doc_id", "tag", "at") != F.col("first")).select("doc_id", "tag", "at")
    return written(later, "later-windows").groupBy("doc_id", "tag").agg(F.collect_set("at").alias("starts"))


def remove_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows with repeated lines gone from ``text``, and ``n_lines`` and ``n_removed`` (lines with a word)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tag"))
    starts = written(repeated_starts(keyed.filter("doc_id is not null and text is not null"), size), "line-starts")
    starts = starts.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("starts").alias("__starts"))
    rows = docs.select(*own).withColumn("__of", F.xxhash64("text"))
    # as the starts grow with the documents, both sides are always dealt by key, whatever their size
    rows = rows.join(starts.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__of") == F.col("__tag")), "left")
    rows = rows.withColumn("__lines", F.coalesce(_lines(F.col("text").cast("string")), F.array().cast("array<string>")))
    every = lambda column: F.sequence(F.lit(0), F.size(column) - 1)
    worded = F.when(F.size("__lines") > 0, F.filter(every("__lines"), lambda i: F.get("__lines", i).rlike(WORD))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__worded", worded)
    gone = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.transform(F.sequence(s, s + size - 1), lambda j: F.get("__worded", j)))))
    rows = rows.withColumn("__gone", F.coalesce(gone, F.array().cast("array<int>")))
    left = F.array_join(F.transform(F.array_except(every("__lines"), F.col("__gone")), lambda i: F.get("__lines", i)), "\n")
    made = rows.select(
        *(c for c in own if c != "text"), F.when(F.size("__gone") > 0, left).otherwise(F.col("text").cast("string")).alias("text"),
        F.size("__worded").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"))
    return settled(made, [c for c in own if c != "text"], ["text", "n_lines", "n_removed"]).select(*own, "n_lines", "n_removed")
