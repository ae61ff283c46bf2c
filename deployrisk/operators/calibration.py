"""Isotonic calibration of each key's probabilities.

The best rising steps come from pooling neighbours whose shares fall. Pooled blocks stay pooled whatever is added on
either side, so each slice of the probabilities of a key is pooled by itself first, from counts per distinct
probability, and only the blocks that are left are pooled over the whole key. A key is never gathered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 256


def pooled(low: np.ndarray, high: np.ndarray, risky: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order, merged with their neighbour on the left while their share of risky rows is not above it."""
    stack: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), risky.tolist(), rows.tolist(), strict=True):
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, top, y, n = stack.pop()
            stack[-1][1] = top
            stack[-1][2] += y
            stack[-1][3] += n
    return tuple(np.array(c, float) for c in zip(*stack, strict=True)) if stack else (np.zeros(0),) * 4


def _pool(keys: Sequence[str]):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        blocks = pooled(*(table.column(c).to_numpy() for c in ("low", "high", "risky", "rows")))
        first = table.slice(0, 1)
        own = [pa.array([first.column(k)[0].as_py()] * len(blocks[0]), table.schema.field(k).type) for k in keys]
        return pa.table([*own, *map(pa.array, blocks)], [*keys, "low", "high", "risky", "rows"])
    return work


def isotonic(scored: DataFrame, keys: Sequence[str], p: str = "p", y: str = "label") -> DataFrame:
    """keys and the scale: ``at`` (rising probabilities) and ``share`` (the calibrated value at each).

    Rows without a probability or label take no part.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in scored.schema}
    schema = "".join(f"{k} {types[k]}, " for k in keys) + "low double, high double, risky double, rows double"
    usable = scored.filter(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    counts = usable.groupBy(*keys, F.col(p).cast("double").alias("low")).agg(
        F.sum((F.col(y) == 1).cast("double")).alias("risky"), F.count(F.lit(1)).cast("double").alias("rows"))
    sliced = counts.select(*keys, F.floor(F.col("low") * SLICES).alias("slice"), "low", F.col("low").alias("high"), "risky", "rows")
    parts = sliced.groupBy(*keys, "slice").applyInArrow(_pool(keys), schema)
    steps = parts.groupBy(*keys).applyInArrow(_pool(keys), schema)
    share = F.col("risky") / F.col("rows")
    ends = F.when(F.col("low") < F.col("high"), F.array("low", "high")).otherwise(F.array("low"))
    points = steps.select(*keys, F.explode(ends).alias("at"), share.alias("share"))
    listed = F.array_sort(F.collect_list(F.struct("at", "share")))
    return points.groupBy(*keys).agg(listed.alias("_l")).select(*keys, F.col("_l.at").alias("at"), F.col("_l.share").alias("share"))


def _between(p: Column) -> Column:
    """The scale at p: straight between its points, level beyond them."""
    below = F.size(F.filter("at", lambda a: a <= p))
    low, high = F.get("at", below - 1), F.get("at", below)
    left, right = F.get("share", below - 1), F.get("share", below)
    return F.when(below == 0, F.get("share", F.lit(0))).when(below == F.size("at"), left).otherwise(left + (right - left) * (p - low) / (high - low))


def calibrate(scale: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace ``p`` by its calibrated value, where the key has a scale; the raw one stays as ``p_raw``."""
    rest = [c for c in scored.columns if c != "p"]
    joined = scored.join(scale, list(keys), "left").withColumn("p_raw", F.col("p"))
    return joined.select(*rest, "p_raw", F.when(F.col("at").isNull() | F.col("p").isNull(), F.col("p")).otherwise(_between(F.col("p"))).alias("p"))
