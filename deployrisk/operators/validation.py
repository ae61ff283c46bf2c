"""Contract checks, range validation, training filters and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from deployrisk import contract as K
from deployrisk.functions import scalars as S
from deployrisk.functions.text import strip
from deployrisk.operators.impute import column_medians


class ContractError(ValueError):
    """Input or model disagrees with the feature contract."""


def contract_columns(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The ten features in contract order, after ``extra`` columns."""
    missing = [f for f in K.FEATURES if f not in df.columns]
    if missing:
        raise ContractError(f"missing features: {missing}")
    return df.select(*extra, *K.FEATURES)


def model_contract(registry: DataFrame) -> DataFrame:
    """Compare each model's ``feature_columns`` with the contract."""
    want = F.array(*[F.lit(f) for f in K.FEATURES])
    have = F.col("feature_columns")
    pairs = F.filter(F.arrays_zip(have.alias("have"), want.alias("want"),
                                  F.sequence(F.lit(0), F.lit(len(K.FEATURES) - 1)).alias("at")),
                     lambda p: p["have"] != p["want"])
    extra, missing = F.array_except(have, want), F.array_except(want, have)
    count_off = F.size(have) != len(K.FEATURES)
    message = (
        F.when(have.isNull(), "model was fitted without feature names; order unverified")
        .when(count_off, F.concat(F.lit("model expects "), F.size(have).cast("string"),
                                  F.lit(f" features, contract defines {len(K.FEATURES)}")))
        .when((F.size(extra) > 0) | (F.size(missing) > 0),
              F.concat(F.lit("feature set mismatch (extra="), F.array_join(extra, ","),
                       F.lit(", missing="), F.array_join(missing, ","), F.lit(")")))
        .when(F.size(pairs) > 0,
              F.concat(F.lit("feature ORDER mismatch at index "), pairs[0]["at"].cast("string"),
                       F.lit(": contract="), pairs[0]["want"], F.lit(" model="), pairs[0]["have"]))
        .otherwise("ok"))
    return registry.withColumn("message", message).withColumn(
        "ok", F.col("message").isin("ok", "model was fitted without feature names; order unverified"))


def range_errors(columns: Mapping[str, tuple] = K.RANGES) -> Column:
    """Array of messages for features outside their range; nulls are allowed."""
    checks = []
    for f, (low, high) in columns.items():
        checks.append(F.when(F.col(f) < low, F.lit(f"{f}: must be >= {low}")))
        if high is not None:
            checks.append(F.when(F.col(f) > high, F.lit(f"{f}: must be <= {high}")))
    return F.array_compact(F.array(*checks))


def validate_ranges(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", range_errors()).withColumn("accepted", F.size("errors") == 0)


def nonempty_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim ids and keep only rows where each is non-empty."""
    out = df.withColumns({c: strip(c) for c in columns})
    for c in columns:
        out = out.filter(F.length(c) > 0)
    return out


def _read_number(df: DataFrame, column: str) -> Column:
    """A column as a number, whatever type it was stored in; whole numbers need no reading."""
    if isinstance(df.schema[column].dataType, IntegralType):
        return F.col(column).cast("double")
    return S.number(strip(F.col(column).cast("string")))


def labelled(df: DataFrame) -> DataFrame:
    """Rows whose label reads as 0 or 1, whatever type it was stored in."""
    number = _read_number(df, "label")
    return df.filter(number.isin(0.0, 1.0)).withColumn("label", number.cast("int"))


def recent_window(df: DataFrame, as_of: Column, days: int = K.TRAIN_WINDOW_DAYS) -> DataFrame:
    """Rows not older than ``days``; an unreadable time counts as zero."""
    return df.filter(is_recent(df, as_of, days))


def is_recent(df: DataFrame, as_of: Column, days: int = K.TRAIN_WINDOW_DAYS) -> Column:
    return F.coalesce(_read_number(df, "timestamp"), F.lit(0.0)).cast("long") >= as_of - days * 86400


def eligibility(labelled_counts: DataFrame, usable_counts: DataFrame) -> DataFrame:
    """Whether each tenant may be trained, and why not.

    Inputs have ``tenant_id`` with ``labelled`` and ``usable`` row counts.
    """
    joined = labelled_counts.join(usable_counts, "tenant_id", "left").withColumn(
        "usable", F.coalesce("usable", F.lit(0).cast("long")))
    reason = (F.when(F.col("tenant_id") == "demo", "demo")
              .when(F.col("labelled") < K.MIN_BUILDS,
                    F.concat(F.lit("only "), F.col("labelled").cast("string"), F.lit(" labelled builds")))
              .when(F.col("usable") < K.MIN_BUILDS, "insufficient data")
              .otherwise("eligible"))
    return joined.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")


def by_email(tenants: DataFrame, email: Column) -> DataFrame:
    return tenants.filter(F.lower(strip("email")) == F.lower(strip(email)))


def apply_overrides(measured: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Caller values win over measured ones; a null never erases a measurement.

    Adds ``<feature>_source``: ``override``, ``measured`` or null.
    """
    given = overrides.select(*keys, *[F.col(f).alias(f"_o_{f}") for f in K.FEATURES])
    joined = measured.join(given, list(keys), "left")
    rest = [c for c in measured.columns if c not in K.FEATURES]
    return joined.select(
        *rest, *[F.coalesce(f"_o_{f}", f).alias(f) for f in K.FEATURES],
        *[F.when(F.col(f"_o_{f}").isNotNull(), "override").when(F.col(f).isNotNull(), "measured")
          .alias(f"{f}_source") for f in K.FEATURES])


def expectations(df: DataFrame) -> DataFrame:
    """Data-quality checks over a labelled frame: name, measured value, passed."""
    risky = F.col("label") == 1

    def share(where: Column) -> Column:
        return F.avg(F.when(where, risky.cast("double")))

    nulls = F.lit(0)
    outside = F.lit(0)
    for f in K.FEATURES:
        nulls = nulls + F.col(f).isNull().cast("int")
    for f, (low, high) in K.RANGES.items():
        if high == 1 or f in K.CLOCK_FEATURES:
            outside = outside + F.coalesce((~F.col(f).between(low, high)).cast("int"), F.lit(0))
    fri = (F.col("day_of_week") == 4) & F.col("hour_of_day").between(16, 19)
    tue = (F.col("day_of_week") == 1) & F.col("hour_of_day").between(9, 12)
    high = F.col("recent_failure_rate") > 0.20
    one = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("nulls"), F.sum(outside).alias("outside"),
        F.min("diff_size").alias("diff_min"), F.avg(risky.cast("double")).alias("risky"),
        share(F.col("is_hotfix") == 1).alias("hotfix"), share(high).alias("high"),
        F.sum(high.cast("int")).alias("n_high"),
        share(fri).alias("fri"), share(tue).alias("tue"),
        F.sum(fri.cast("int")).alias("n_fri"), F.sum(tue.cast("int")).alias("n_tue"))
    return one.selectExpr(
        """stack(8,
            'row_count', cast(n as double), n > 0,
            'no_nulls', cast(nulls as double), nulls = 0,
            'ranges', cast(outside as double), outside = 0,
            'diff_size_min', cast(diff_min as double), diff_min >= 1,
            'risky_share', risky, risky between 0.15 and 0.45,
            'hotfix_risky', hotfix, hotfix >= 0.55,
            'high_failure_risky', high, n_high <= 10 or high >= 0.55,
            'friday_over_tuesday', fri - tue, (n_fri <= 5 or n_tue <= 5) or fri > tue
        ) as (check, value, passed)""")


def median_drift(df: DataFrame, stored: Mapping[str, float] = K.TRAINING_MEDIANS,
                 tolerance: float = 0.02) -> DataFrame:
    """Recomputed medians against stored ones, relative tolerance."""
    medians = column_medians(df, [])
    long = medians.unpivot([], [f"{f}_median" for f in K.FEATURES], "name", "measured")
    feature = F.regexp_replace("name", "_median$", "")
    new = F.round("measured", 3)
    old = S.lookup(stored, F.col("feature"))
    scale = F.greatest(F.abs(F.col("stored")), F.abs(F.col("measured")), F.lit(1e-6))
    return (long.select(feature.alias("feature"), new.alias("measured"))
            .withColumn("stored", old)
            .withColumn("relative", F.abs(F.col("stored") - F.col("measured")) / scale)
            .withColumn("drifted", F.col("relative") > tolerance))
