"""From raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``; the
result of each is written and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deployrisk.llm import lines, packing, pii, quality, simhash
from deployrisk.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with the number of characters brought up to date."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned rules reject go."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in three-line windows seen before go, and with them documents of which no line with a word is left."""
    left = lines.remove_lines(docs, size=3)
    return _measured(left.filter("n_removed = 0 OR n_removed < n_lines"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, once; rows without an id stay."""
    found = simhash.near_duplicates(docs, shingle=3, most=2, seed=42)
    first = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("__first")).agg(F.count(F.lit(1)).alias("__rows"))
    first = written(first, "group-firsts")
    rows = docs.join(first.hint("merge"), F.col("doc_id") == F.col("__first"), "left").filter("__first is not null or doc_id is null")
    if first.filter("__rows > 1").isEmpty():
        return rows.select(*docs.columns)
    # of rows that repeat an id and text one stays
    rows = written(rows, "group-rows")
    repeated = F.coalesce(F.col("__rows"), F.lit(1)) > 1
    return rows.filter(~repeated).unionByName(rows.filter(repeated).dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _measured(pii.redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, with the token ids of each piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the learned rules nor the fingerprints nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
