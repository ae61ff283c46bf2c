"""Change statistics from git's text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk.functions.text import strip


def numstat_text_counts(df: DataFrame, text: str) -> DataFrame:
    """Churn and file count from a numstat text, computed inside the row.

    ``-`` marks a binary file: it counts as a file without lines. Numbers are matched
    before they are cast, since a failed cast costs far more than a pattern.
    """
    def found(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?m)^{pattern}"), F.lit(group))

    def total(digits: Column) -> Column:
        return F.aggregate(digits.cast("array<bigint>"), F.lit(0).cast("long"), lambda a, n: a + n)

    added = found(r"(\d{1,18})\t[^\t\n]*\t", 1)
    deleted = found(r"[^\t\n]*\t(\d{1,18})\t", 1)
    files = F.size(found(r"[^\t\n]*\t[^\t\n]*\t", 0))
    return df.withColumn("churn", total(added) + total(deleted)).withColumn("files", files.cast("long"))


def diffstat_numbers(text: Column) -> Column:
    """The whole-number words of a diff-stat line."""
    words = F.split(strip(F.regexp_replace(text, ",", "")), r"\s+")
    return F.transform(F.filter(words, lambda w: w.rlike(r"^\d+$")), lambda w: w.cast("int"))


def diffstat_churn(text: Column, files_hint: Column) -> Column:
    """Insertions plus deletions, at least 1; twenty lines per file when unreadable."""
    numbers = diffstat_numbers(text)
    total = F.aggregate(F.slice(numbers, 2, 2147483646), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(numbers) >= 2, F.greatest(F.lit(1), total)).otherwise(
        F.greatest(F.lit(1), files_hint * 20))


def diffstat_files(text: Column) -> Column:
    numbers = diffstat_numbers(text)
    return F.when(F.size(numbers) >= 1, F.greatest(F.lit(1), F.element_at(numbers, 1))).otherwise(F.lit(5))
