"""Filling unknown features while recording where each value came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators.ordered import exact_quantiles, in_chunks, newest


def whole(feature: str, value: Column) -> Column:
    """Counts stay whole numbers, halves to even."""
    return F.bround(value, 0).cast("int") if feature in K.INT_FEATURES else value.cast("double")


def unpivot_features(df: DataFrame, keys: Sequence[str], features: Sequence[str] = K.FEATURES) -> DataFrame:
    """One row per (row, feature) with a double ``value``."""
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keys), list(features), "feature", "value")


def pivot_features(df: DataFrame, keys: Sequence[str], value: str, features: Sequence[str] = K.FEATURES,
                   suffix: str = "") -> DataFrame:
    """Back to one column per feature; a fixed list, so no pass to find the values."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col("feature") == f, F.col(value))).alias(f + suffix) for f in features])


def tenant_medians(builds: DataFrame) -> DataFrame:
    """Medians over each tenant's newest builds; too few usable values give null."""
    recent = newest(builds.select("tenant_id", "timestamp", "build_id", *K.FEATURES),
                    ["tenant_id"], ["timestamp", "build_id"], K.MEDIAN_HISTORY)
    # at most MEDIAN_HISTORY rows per tenant reach this aggregate
    return recent.groupBy("tenant_id").agg(*[
        F.when(F.count(f) >= K.MEDIAN_MIN_ROWS, F.median(F.col(f).cast("double"))).alias(f"{f}_median")
        for f in K.FEATURES])


def median_before(values: np.ndarray, known: np.ndarray, rows: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The median of the known ones of the ``rows`` values before each value, and whether there are ``least`` of them."""
    padded = np.concatenate([np.full(rows, np.nan), np.where(known, values, np.nan)])
    seen = np.concatenate([[0], np.cumsum(known)])
    count = seen[:-1] - seen[np.maximum(np.arange(len(values)) - rows, 0)]
    found = np.full(len(values), np.nan)
    enough = count >= least
    at = np.flatnonzero(enough)
    if len(at):
        frames = np.sort(np.lib.stride_tricks.sliding_window_view(padded, rows)[at], axis=1)    # unknown ones come last
        low, high = (np.take_along_axis(frames, place[:, None], 1)[:, 0] for place in ((count[at] - 1) // 2, count[at] // 2))
        found[at] = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return found, enough


def medians_before(builds: DataFrame) -> DataFrame:
    """Every build with the medians over its tenant's builds before it, as many as serving looks back on.

    Too few usable values give null.
    """
    order, own = ["timestamp", "build_id"], builds.columns
    spread = in_chunks(builds, ["tenant_id"], order, K.MEDIAN_HISTORY)
    rows = spread.select(*own, "_chunk", (F.col("_chunk") == F.col("_home")).alias("_own"), "pos", *[F.col(f).cast("double").alias(f"_{f}") for f in K.FEATURES])
    names = [f"{f}_median" for f in K.FEATURES]

    def medians(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        found = []
        for f in K.FEATURES:
            column = table.column(f"_{f}")
            known = column.is_valid().to_numpy()
            values, enough = median_before(column.fill_null(0.0).to_numpy(), known, K.MEDIAN_HISTORY, max(K.MEDIAN_MIN_ROWS, 1))
            found.append(pa.array(values, pa.float64(), mask=~enough))
        made = pa.table([*(table.column(c) for c in own), *found], [*own, *names])
        return made.filter(table.column("_own"))

    schema = builds.withColumns({n: F.lit(None).cast("double") for n in names}).schema
    return rows.groupBy("tenant_id", "_chunk").applyInArrow(medians, schema)


def impute_as_of(builds: DataFrame, model_medians: DataFrame, hour: Column, weekday: Column) -> DataFrame:
    """:func:`impute_serving` with what was known when each build came, then with the medians of the tenant's model.

    ``model_medians`` has tenant_id and ``<feature>_median`` columns of the rows that the live model was trained on.
    """
    fallback = model_medians.select("tenant_id", *[F.col(f"{f}_median").alias(f"_{f}_model") for f in K.FEATURES])
    rows = medians_before(builds).join(fallback, "tenant_id", "left")
    return _filled(rows, builds.columns, hour, weekday, {f: F.coalesce(f"_{f}_model", F.lit(K.TRAINING_MEDIANS[f])) for f in K.FEATURES})


def impute_serving(builds: DataFrame, medians: DataFrame, hour: Column, weekday: Column) -> DataFrame:
    """Given value, else clock, else tenant median, else fixed median.

    Adds ``imputed`` (names, contract order) and ``sources`` (name -> source).
    """
    return _filled(builds.join(medians, "tenant_id", "left"), builds.columns, hour, weekday, {f: F.lit(m) for f, m in K.TRAINING_MEDIANS.items()})


def _filled(joined: DataFrame, columns: Sequence[str], hour: Column, weekday: Column, last: Mapping[str, Column]) -> DataFrame:
    clock = {"hour_of_day": hour, "day_of_week": weekday}
    filled, sources = {}, {}
    for f in K.FEATURES:
        given = F.col(f)
        if f in clock:
            filled[f] = F.coalesce(given, clock[f]).cast("int")
            sources[f] = F.when(given.isNotNull(), "provided").otherwise("clock")
            continue
        median = F.col(f"{f}_median")
        guess = whole(f, F.coalesce(median, last[f]))
        filled[f] = F.coalesce(given, guess)
        sources[f] = (F.when(given.isNotNull(), "provided").when(median.isNotNull(), "tenant_median")
                      .otherwise("training_median"))
    imputed = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in K.FEATURES]))
    source_map = F.map_from_arrays(F.array(*[F.lit(f) for f in K.FEATURES]),
                                   F.array(*[sources[f] for f in K.FEATURES]))
    rest = [c for c in columns if c not in K.FEATURES]
    return joined.select(*rest, *[filled[f].alias(f) for f in K.FEATURES],
                         imputed.alias("imputed"), source_map.alias("sources"))


def column_medians(df: DataFrame, keys: Sequence[str], features: Sequence[str] = K.FEATURES) -> DataFrame:
    """Exact medians per key, one ``<feature>_median`` column each, null when no values."""
    long = unpivot_features(df, keys, features)
    found = exact_quantiles(long, [*keys, "feature"], "value", {"median": 0.5})
    return pivot_features(found, keys, "median", features, "_median")


def fill_with(df: DataFrame, medians: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill features from ``medians`` (one row per key), fixed medians where null.

    Without keys ``medians`` is a single row.
    """
    if keys:
        joined = df.join(medians, list(keys), "left")
    else:
        # a one-row aggregate: joined on a constant, small by construction
        joined = df.withColumn("_k", F.lit(0)).join(
            F.broadcast(medians.withColumn("_k", F.lit(0))), "_k", "left").drop("_k")
    rest = [c for c in df.columns if c not in K.FEATURES]
    return joined.select(*rest, *[
        F.coalesce(F.col(f).cast("double"),
                   whole(f, F.coalesce(f"{f}_median", F.lit(K.TRAINING_MEDIANS[f]))).cast("double")).alias(f)
        for f in K.FEATURES])


def impute_training(df: DataFrame) -> DataFrame:
    """Each tenant's own column medians, fixed medians for all-null columns; never zero."""
    return fill_with(df, column_medians(df, ["tenant_id"]), ["tenant_id"])


def impute_global(df: DataFrame) -> DataFrame:
    """Medians of the whole frame, not rounded."""
    medians = column_medians(df, [])
    joined = df.withColumn("_k", F.lit(0)).join(
        F.broadcast(medians.withColumn("_k", F.lit(0))), "_k", "left").drop("_k")
    rest = [c for c in df.columns if c not in K.FEATURES]
    return joined.select(*rest, *[
        F.coalesce(F.col(f).cast("double"), F.col(f"{f}_median")).alias(f) for f in K.FEATURES])


def impute_train_only(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Medians from the training rows only, applied to both parts."""
    medians = column_medians(train, [])

    def fill(df: DataFrame) -> DataFrame:
        joined = df.withColumn("_k", F.lit(0)).join(
            F.broadcast(medians.withColumn("_k", F.lit(0))), "_k", "left").drop("_k")
        rest = [c for c in df.columns if c not in K.FEATURES]
        return joined.select(*rest, *[
            F.coalesce(F.col(f).cast("double"), F.col(f"{f}_median"), F.lit(K.TRAINING_MEDIANS[f])).alias(f)
            for f in K.FEATURES])

    return fill(train), fill(test)


def impute_zero(df: DataFrame) -> DataFrame:
    """Superseded zero fill, kept as the contrast."""
    return df.na.fill(0, K.FEATURES)
