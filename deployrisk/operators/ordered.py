"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Everything here
cuts each key into *slices* instead: a slice is any expression that never falls as
the ordering rises (an hour of the timeline, a band of scores). Rows are sorted
within (key, slice), the slices of a key are totalled (one small row each), and the
running total over the slices is joined back. Results are exactly those of the
plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 3600


def hour_slice(ts: str) -> Column:
    """Hour of the timeline for an epoch-second column."""
    return F.floor(F.col(ts) / F.lit(SLICE_SECONDS))


def value_slice(value: str) -> Column:
    """A monotone band for any finite number: 64 bands per e-fold of magnitude."""
    v = F.col(value).cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(64.0))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    slice_: Column,
    order: Sequence[str],
    values: Mapping[str, str],
) -> DataFrame:
    """Exclusive running sums along ``order`` within ``keys``.

    ``values`` maps an input column to the stem of its outputs: ``<stem>_before``
    holds the sum over all earlier rows of the key, ``<stem>_total`` the key's sum.
    Rows must be distinct on (keys, order) for the result to be deterministic.
    """
    keys = list(keys)
    # join columns that are never null, so rows with an unknown key or time stay in
    parts = [f"_key{i}" for i in range(len(keys))]
    cut = df.withColumns({
        **{p: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for p, k in zip(parts, keys)},
        "_slice": F.coalesce(slice_.cast("long"), F.lit(-(1 << 63)))})
    earlier = Window.partitionBy(*parts, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    inside = cut.select(
        "*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_in_{s}") for c, s in values.items()])
    slices = cut.groupBy(*parts, "_slice").agg(*[F.sum(c).alias(f"_s_{s}") for c, s in values.items()])
    by_key = Window.partitionBy(*parts)
    before = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *parts, "_slice",
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in values.values()],
        *[F.sum(f"_s_{s}").over(by_key).alias(f"{s}_total") for s in values.values()])
    joined = inside.join(offsets, [*parts, "_slice"])
    return joined.select(
        *df.columns, *[F.col(f"{s}_total") for s in values.values()],
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"{s}_before") for s in values.values()])


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_: Column | None = None,
) -> DataFrame:
    """Add ``pos`` (0-based place of a row within its key) and ``n`` (rows in the key).

    ``order`` must end in a column that makes the ordering total. The first order
    column is taken as epoch seconds unless another ``slice_`` is given.
    """
    cut = slice_ if slice_ is not None else hour_slice(order[0])
    counted = running_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, cut, order, {"_one": "_rows"})
    return (counted.withColumnRenamed("_rows_before", "pos")
            .withColumnRenamed("_rows_total", "n").drop("_one"))


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, slice_: Column | None = None, chunk: int = 20000) -> DataFrame:
    """Each key cut into chunks of ``chunk`` consecutive rows (``_chunk``), after the ``rows`` rows before it, whose ``_home`` is another chunk.

    Rows keep their place in the key as ``pos``, and ``n``.
    """
    placed = with_position(df, keys, order, slice_)
    home = F.floor(F.col("pos") / F.lit(chunk))
    tail = (F.col("pos") % F.lit(chunk)) >= F.lit(chunk - rows)
    carries = tail & (home < F.floor((F.col("n") - 1) / F.lit(chunk)))
    return (placed.withColumn("_home", home)
            .withColumn("_chunk", F.explode(
                F.when(carries, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))))


def over_preceding(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    aggregates: Mapping[str, Column | tuple[int, Column]],
    slice_: Column | None = None,
    chunk: int = 20000,
) -> DataFrame:
    """Aggregates over the ``rows`` rows before each row of its key, itself excluded.

    An aggregate given with a number looks back over that many rows only.

    Each key is cut into chunks of ``chunk`` consecutive rows. The last ``rows`` rows
    of a chunk are also sent to the next chunk, so every frame is whole and no task
    sorts more than ``chunk + rows`` rows of one key.
    """
    spread = in_chunks(df, keys, order, rows, slice_, chunk)
    ordered = Window.partitionBy(*keys, "_chunk").orderBy("pos")
    sized = {name: a if isinstance(a, tuple) else (rows, a) for name, a in aggregates.items()}
    out = spread.select("*", *[a.over(ordered.rowsBetween(-n, -1)).alias(name) for name, (n, a) in sized.items()])
    return out.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home", "n")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    count_as: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, nulls ignored.

    ``weight`` names how often a row's value occurred, for values already counted.

    ``percentile`` keeps every distinct value of a key in one task's memory. Here the
    values are first counted (map-side), then placed with :func:`running_sums` and
    only the one or two values a quantile falls on are kept.
    """
    keys = list(keys)
    usable = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = usable.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    placed = running_sums(counts, keys, value_slice("_v"), ["_v"], {"_c": "_n"})
    last = F.col("_n_total") - 1

    def at(position: Column) -> Column:
        hit = (F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_c"))
        return F.max(F.when(hit, F.col("_v")))

    picks = []
    for name, q in quantiles.items():
        point = last * F.lit(float(q))
        picks += [at(F.floor(point)).alias(f"_lo_{name}"), at(F.ceil(point)).alias(f"_hi_{name}")]
    found = placed.groupBy(*keys).agg(F.max("_n_total").alias("_n"), *picks)
    last = F.col("_n") - 1
    outputs = []
    for name, q in quantiles.items():
        point = last * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append((lo + (hi - lo) * (point - F.floor(point))).alias(name))
    if count_as:
        outputs.append(F.col("_n").alias(count_as))
    return found.select(*keys, *outputs)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, rank_as: str = "rank") -> DataFrame:
    """The ``count`` newest rows per key, rank 1 newest.

    The rank filter lets Spark keep only ``count`` rows per key and input partition
    before the shuffle, so a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank_as, F.row_number().over(w)).filter(F.col(rank_as) <= count)
