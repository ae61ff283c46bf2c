"""Build, tenant and commit tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deployrisk import contract as K
from deployrisk.functions.scalars import number
from deployrisk.functions.text import strip


class SourceError(ValueError):
    """A file lacks columns the job cannot do without."""


def builds_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per build; unreadable objects are skipped."""
    schema = T.StructType([*K.BUILD_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def builds_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Legacy tables: every value is text and unreadable ones become null.

    ``columns`` is the header, so no pass over the files is needed to infer it.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(text).option("header", True).csv(path)
    typed = []
    for field in K.BUILD_SCHEMA.fields:
        if field.name not in columns:
            continue
        value = F.col(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.LongType)):
            value = number(strip(value)).try_cast(field.dataType)
        elif isinstance(field.dataType, T.ArrayType):
            value = F.when(F.length(value) > 0, F.split(value, ","))
        elif isinstance(field.dataType, T.DoubleType):
            value = number(strip(value))
        elif not isinstance(field.dataType, T.StringType):
            value = value.try_cast(field.dataType)
        typed.append(value.alias(field.name))
    return rows.select(*typed)


def union_builds(*parts: DataFrame) -> DataFrame:
    """All parts by column name; missing columns become null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def fallback_builds(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Legacy rows only for tenants without any current row."""
    have = current.select("tenant_id").distinct()
    return union_builds(current, legacy.join(have, "tenant_id", "left_anti"))


def tenants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv_with_columns(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """A CSV table that must have ``required`` columns."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise SourceError(f"missing columns: {missing}")
    return rows


def commits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled commits; the header decides the columns and is checked."""
    rows = csv_with_columns(spark, path, K.COMMIT_COLUMNS)
    kinds = {"la": "int", "ld": "int", "nf": "int", "aexp": "int", "age": "double", "year": "int", "author_date": "long",
             "buggy": "boolean", "fix": "boolean"}
    return rows.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])


def training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training rows with all features and a decided label."""
    rows = csv_with_columns(spark, path, [*K.FEATURES, "label"])
    label = number(strip("label"))
    typed = rows.select(*[c for c in rows.columns if c not in K.FEATURES and c != "label"],
                        *[number(strip(f)).alias(f) for f in K.FEATURES], label.alias("label"))
    return typed.filter(F.col("label").isin(0.0, 1.0)).withColumn("label", F.col("label").cast("int"))
