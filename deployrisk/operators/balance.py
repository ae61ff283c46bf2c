"""Oversampling the rarer class with synthetic rows between near neighbours.

The neighbour search is exact without comparing all rows of a tenant. Distinct vectors are cut into tiles of at most
``TILE`` by their places along the two features that vary most: slabs along one, tiles along the other. Within a tile
a tree of boxes, halved along the widest side down to ``LEAF`` vectors, is searched by rising distance of
the boxes until the next one is farther than the k-th neighbour found. Only vectors whose k-th neighbour is
farther than the border of another slab's and tile's box are searched there too, within that distance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deployrisk import contract as K
from deployrisk.operators.ordered import value_slice, with_position
from deployrisk.session import materialize

NEIGHBOURS = 5
LEAST_RISKY = 6
TILE = 4096         # vectors searched together
LEAF = 4            # vectors in a box at the end of the tree
QUERIES = 50_000    # vectors of other tiles searched in one copy of a tile
BATCH = 1000        # synthetic rows made per exploded element


# --- search within a tile ------------------------------------------------------

def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Places of the points in each box of the tree."""
    found, waiting = [], [np.arange(len(points))]
    while waiting:
        own = waiting.pop()
        if len(own) <= LEAF:
            found.append(own)
            continue
        sides = np.ptp(points[own], axis=0)
        own = own[np.argsort(points[own, np.argmax(sides)], kind="stable")]
        waiting += [own[:len(own) // 2], own[len(own) // 2:]]
    return found


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, added up feature by feature."""
    total = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for f in range(a.shape[-1]):
        gap = a[..., f] - b[..., f]
        total += gap * gap
    return total


def tile_neighbours(points: np.ndarray, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` nearest points of each query, not farther than ``bound`` (squared): (places or -1, squares, pairs compared).

    ``own`` is the place of the query itself among the points, or -1. Of equally near points earlier ones come first.
    """
    boxes = leaves(points)
    width = max(map(len, boxes))
    member = np.array([[*b, *[-1] * (width - len(b))] for b in boxes])
    low, high = (np.array([edge(points[b], axis=0) for b in boxes]) for edge in (np.min, np.max))
    places, squares, pairs = np.full((len(queries), k), -1), np.full((len(queries), k), np.inf), 0
    step = max(1, (1 << 20) // len(boxes))
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        q = queries[part]
        away = _squares(np.clip(q[:, None], low[None], high[None]), q[:, None])
        order = np.argsort(away, axis=1, kind="stable")
        near, far = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        active = np.arange(len(q))
        for turn in range(len(boxes)):
            box = order[active, turn]
            # boxes lie no nearer than this one from here on
            there = away[active, box] <= np.minimum(far[active, -1], bound[part][active])
            active, box = active[there], box[there]
            if not len(active):
                break
            other = member[box]
            square = _squares(q[active, None], points[other])
            usable = (other >= 0) & (other != own[part][active, None]) & (square <= bound[part][active, None])
            pairs += int((other >= 0).sum())
            names = np.concatenate([near[active], np.where(usable, other, -1)], axis=1)
            sizes = np.concatenate([far[active], np.where(usable, square, np.inf)], axis=1)
            best = np.lexsort((names, sizes), axis=1)[:, :k]
            near[active], far[active] = np.take_along_axis(names, best, 1), np.take_along_axis(sizes, best, 1)
        near[np.isinf(far)] = -1
        places[part], squares[part] = near, far
    return places, squares, pairs


def _matrix(batch: pa.Table, column: str) -> np.ndarray:
    values = batch.column(column).combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _listed(vids: pa.Array, ids: pa.Array, places: np.ndarray, squares: np.ndarray) -> pa.Table:
    """(vid, other, distance2) of all neighbours found."""
    row, column = np.nonzero(places >= 0)
    return pa.table({"vid": ids.take(pa.array(row)), "other": vids.take(pa.array(places[row, column])), "distance2": pa.array(squares[row, column])})


def _in_tile(k: int) -> Callable[[pa.Table], pa.Table]:
    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("vid")
        points, vids = _matrix(table, "at"), table.column("vid").combine_chunks()
        own = np.flatnonzero(table.column("asked").to_numpy())
        if len(own):
            places, squares, _ = tile_neighbours(points, points[own], own, np.full(len(own), np.inf), k)
        else:
            places, squares = np.full((0, k), -1), np.zeros((0, k))
        found = _listed(vids, vids.take(pa.array(own)), places, squares)
        keys = {c: table.column(c)[0] for c in table.column_names if c not in ("vid", "at", "asked")}
        return pa.table({**{c: pa.array([v.as_py()] * found.num_rows, table.schema.field(c).type) for c, v in keys.items()},
                         **{c: found.column(c) for c in found.column_names}})
    return search


def _in_other_tile(k: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        keys = {c: asked.column(c)[0] if asked.num_rows else None for c in names}
        if not held.num_rows or not asked.num_rows:
            found = pa.table({"vid": pa.array([], pa.string()), "other": pa.array([], pa.string()), "distance2": pa.array([], pa.float64())})
        else:
            held = held.sort_by("vid")
            places, squares, _ = tile_neighbours(_matrix(held, "at"), _matrix(asked, "at"), np.full(asked.num_rows, -1),
                                                 asked.column("bound").to_numpy(), k)
            found = _listed(held.column("vid").combine_chunks(), asked.column("vid").combine_chunks(), places, squares)
        return pa.table({**{c: pa.array([v.as_py() if v is not None else None] * found.num_rows, (asked if asked.num_rows else held).schema.field(c).type)
                            for c, v in keys.items()}, **{c: found.column(c) for c in found.column_names}})
    return search


# --- tiles ---------------------------------------------------------------------

def tiled(points: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys, vid, asked, ``at`` (array of the features), slab and tile."""
    keys = list(keys)
    rows = points.select(*keys, "vid", "asked", F.array(*[F.col(f).cast("double") for f in features]).alias("at"))
    spread = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.reverse(F.sort_array(F.array(*[
        F.struct(F.coalesce(F.var_samp(F.col(f).cast("double")), F.lit(0.0)).alias("v"), F.lit(i).alias("f")) for i, f in enumerate(features)]))).alias("by"))
    rows = rows.join(spread, keys)
    small = rows.filter(F.col("n") <= TILE).select(*keys, "vid", "asked", "at", F.lit(0).cast("long").alias("slab"), F.lit(0).cast("long").alias("tile"))
    large = rows.filter(F.col("n") > TILE).withColumns({
        "_x": F.get("at", F.get("by", F.lit(0)).f), "_y": F.get("at", F.get("by", F.lit(1 if len(features) > 1 else 0)).f),
        "_slabs": F.ceil(F.sqrt(F.col("n") / TILE))}).drop("by", "n")
    placed = with_position(large, keys, ["_x", "vid"], value_slice("_x"))
    slabs = placed.withColumn("slab", F.floor(F.col("pos") * F.col("_slabs") / F.col("n"))).drop("pos", "n")
    placed = with_position(slabs, [*keys, "slab"], ["_y", "vid"], value_slice("_y"))
    tiles = placed.withColumn("tile", F.floor(F.col("pos") * F.ceil(F.col("n") / TILE) / F.col("n")))
    return small.unionByName(tiles.select(*keys, "vid", "asked", "at", "slab", "tile"))


def _box_distance(at: Column, low: Column, high: Column) -> Column:
    """Squared distance of a point to a box."""
    gaps = F.zip_with(F.zip_with(low, at, lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with(at, high, lambda a, b: F.greatest(a - b, F.lit(0.0))),
                      lambda a, b: a * a + b * b)
    return F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b)


def _boxes(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """low and high corner of the points of each group."""
    return rows.groupBy(*keys).agg(F.array(*[F.min(F.get("at", F.lit(i))) for i in range(size)]).alias("low"),
                                   F.array(*[F.max(F.get("at", F.lit(i))) for i in range(size)]).alias("high"), F.count(F.lit(1)).alias("held"))


def nearest(points: DataFrame, keys: Sequence[str], k: int, features: Sequence[str] = K.FEATURES) -> DataFrame:
    """The ``k`` nearest other points of each point within its key, exact.

    ``points`` has distinct feature vectors with an id ``vid``, and may have a column ``asked``: then only the neighbours of
    points where it is true are searched, among all points. Returns
    keys, ``vid``, ``other`` (struct of vid, features and remaining columns), ``distance2``
    (squared) and ``rank``.
    """
    keys, size = list(keys), len(features)
    points = materialize(points if "asked" in points.columns else points.withColumn("asked", F.lit(True)), "neighbour-points")
    placed = materialize(tiled(points, keys, features), "neighbour-tiles")
    schemas = {f.name: f.dataType.simpleString() for f in placed.schema}
    spot = [*keys, "slab", "tile"]
    schema = ", ".join(f"{c} {schemas[c]}" for c in [*spot, "vid"]) + ", other string, distance2 double"
    # the search takes long for its few bytes, so tiles are dealt to a number of tasks that grows with them
    work = max(points.sparkSession.sparkContext.defaultParallelism, 1)
    tasks = max(4 * work, -(-placed.select(*spot).distinct().count() // 8))
    inside = materialize(placed.repartition(tasks, *spot).groupBy(*spot).applyInArrow(_in_tile(k), schema), "neighbours-inside")

    # how far each point's k-th neighbour is, and the boxes that are nearer
    tiles = _boxes(placed, spot, size)
    many = tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tiles")).filter("_tiles > 1").select(*keys)
    tiles = materialize(tiles.join(many, keys, "left_semi"), "neighbour-boxes")
    reach = inside.groupBy(*keys, "vid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance2")).otherwise(float("inf")).alias("bound"))
    asking = placed.filter("asked").drop("asked").join(many, keys, "left_semi").join(reach, [*keys, "vid"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    asking = asking.withColumnsRenamed({"slab": "_slab", "tile": "_tile"})
    slabs = tiles.groupBy(*keys, "slab").agg(
        F.array(*[F.min(F.get("low", F.lit(i))) for i in range(size)]).alias("low"), F.array(*[F.max(F.get("high", F.lit(i))) for i in range(size)]).alias("high"))
    listed = slabs.groupBy(*keys).agg(F.collect_list(F.struct("slab", "low", "high")).alias("_boxes"))       # a square root of the tiles
    near = asking.join(listed, keys).withColumn("slab", F.explode(F.transform(F.filter(
        "_boxes", lambda b: _box_distance(F.col("at"), b.low, b.high) <= F.col("bound")), lambda b: b.slab))).drop("_boxes")
    listed = tiles.groupBy(*keys, "slab").agg(F.collect_list(F.struct("tile", "low", "high")).alias("_boxes"))
    near = near.join(listed, [*keys, "slab"]).withColumn("tile", F.explode(F.transform(F.filter(
        "_boxes", lambda b: _box_distance(F.col("at"), b.low, b.high) <= F.col("bound")), lambda b: b.tile))).drop("_boxes")
    near = materialize(near.filter("NOT (slab = _slab AND tile = _tile)").select(*spot, "vid", "at", "bound"), "neighbour-queries")

    # a tile that many ask is copied, and each copy answers some of them
    copies = near.groupBy(*spot).agg((F.floor(F.count(F.lit(1)) / QUERIES) + 1).alias("_copies"))
    asked = near.join(copies, spot).withColumn("copy", F.pmod(F.xxhash64("vid"), F.col("_copies"))).drop("_copies")
    held = placed.drop("asked").join(copies, spot).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).drop("_copies")
    parts = [*spot, "copy"]
    outside = held.repartition(tasks, *parts).groupBy(*parts).cogroup(asked.repartition(tasks, *parts).groupBy(*parts)).applyInArrow(_in_other_tile(k, spot), schema)

    best = Window.partitionBy(*keys, "vid").orderBy("distance2", "other")
    found = inside.unionByName(outside).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    body = F.struct(*[c for c in points.columns if c not in keys and c != "asked"])
    others = points.select(*keys, F.col("vid").alias("_other"), body.alias("_body"))
    found = found.withColumnRenamed("other", "_other").join(others, [*keys, "_other"])
    return found.select(*keys, "vid", F.col("_body").alias("other"), "distance2", "rank")


def _unit(*parts: Column) -> Column:
    """A repeatable number in 0..1 from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def plan_of(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each key that can be balanced needs: its rarer label, how many rows it has and lacks, and the neighbours used.

    Keys with fewer than six risky rows, or too few rare rows for the neighbours asked for, are left out.
    """
    sizes = train.groupBy(*keys).agg(
        F.sum((F.col("label") == 1).cast("long")).alias("_n1"), F.sum((F.col("label") == 0).cast("long")).alias("_n0"))
    plan = sizes.select(
        *keys, F.when(F.col("_n1") <= F.col("_n0"), 1).otherwise(0).alias("label"),
        F.least("_n1", "_n0").alias("_rare"), F.abs(F.col("_n1") - F.col("_n0")).alias("_need"),
        F.least(F.lit(NEIGHBOURS), F.col("_n1") - 1).cast("int").alias("_k"), "_n1")
    return plan.filter((F.col("_n1") >= LEAST_RISKY) & (F.col("_rare") > F.col("_k")))


def oversample(train: DataFrame, keys: Sequence[str], id_column: str, seed: int = 42,
               features: Sequence[str] = K.FEATURES) -> DataFrame:
    """Synthetic rows (keys, label, features) that bring the rarer class to parity.

    Keys without a plan get none. Repeated vectors are searched once and count as their own neighbours.
    """
    keys = list(keys)
    plan = plan_of(train, keys).filter("_need > 0")

    rare = train.join(plan, [*keys, "label"]).withColumn("_h", F.xxhash64(F.col(id_column), F.lit(seed)))
    ranked = with_position(rare, keys, ["_h", id_column], F.shiftright("_h", 52))
    quota = F.floor(F.col("_need") / F.col("_rare")) + (F.col("pos") < F.col("_need") % F.col("_rare")).cast("long")
    vectors = materialize(ranked.withColumn("_quota", quota).groupBy(*keys, "label", *features).agg(
        F.count(F.lit(1)).alias("copies"), F.min(id_column).alias("vid"), F.sum("_quota").alias("_quota"),
        F.max("_k").alias("_k")), "rare-vectors")

    # only vectors that synthetic rows start from need their neighbours
    asked = vectors.filter("_quota > 0").select(*keys, "vid", F.lit(True).alias("asked")).distinct()
    points = vectors.select(*keys, "vid", "copies", *[F.col(f).cast("double").alias(f) for f in features]).join(asked, [*keys, "vid"], "left")
    found = nearest(points.withColumn("asked", F.coalesce("asked", F.lit(False))), keys, NEIGHBOURS, features)
    # at most NEIGHBOURS rows per vector
    listed = found.groupBy(*keys, "vid").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("other.copies").alias("copies"),
        F.struct(*[F.col(f"other.{f}").alias(f) for f in features]).alias("at")))).alias("_near"))
    own = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    joined = vectors.filter(F.col("_quota") > 0).join(listed, [*keys, "vid"], "left")
    self_copies = F.array_repeat(own, F.least(F.col("copies") - 1, F.col("_k").cast("long")).cast("int"))
    others = F.flatten(F.transform(F.col("_near"), lambda o: F.array_repeat(
        o["at"], F.least(o["copies"], F.lit(NEIGHBOURS).cast("long")).cast("int"))))
    choices = F.when(F.col("_near").isNull(), self_copies).otherwise(F.concat(self_copies, others))
    ready = joined.select(*keys, "label", "vid", "_quota", own.alias("_from"),
                          F.slice(choices, F.lit(1), F.col("_k")).alias("_to"))

    # one vector may need very many rows: cut its quota into batches before making them
    batches = ready.withColumn("_batch", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_quota") - 1) / BATCH))))
    even = batches.repartition(*keys, "vid", "_batch")
    made = even.withColumn("_i", F.explode(F.sequence(
        F.col("_batch") * BATCH, F.least((F.col("_batch") + 1) * BATCH, F.col("_quota")) - 1)))
    pick = F.get("_to", F.pmod(F.xxhash64("vid", "_i", F.lit(seed + 1)), F.size("_to")).cast("int"))
    step = _unit(F.col("vid"), F.col("_i"), F.lit(seed + 2))
    drawn = made.select(*keys, "label", "vid", "_i", "_from", pick.alias("_end"), step.alias("_u"))
    return drawn.select(*keys, "label", F.concat("vid", F.lit("~"), F.col("_i").cast("string")).alias(id_column), *[
        (F.col(f"_from.{f}") + F.col("_u") * (F.col(f"_end.{f}") - F.col(f"_from.{f}"))).alias(f) for f in features])


def balance(train: DataFrame, keys: Sequence[str], id_column: str, features: Sequence[str] = K.FEATURES) -> DataFrame:
    """Training rows plus their synthetic ones: keys, label, id, features and ``sample_weight``.

    Rows keep the weight they came with (1 without one) where their key could not be balanced. Balancing voids the
    weights, so all rows of a balanced key weigh 1.
    """
    keys = list(keys)
    own = F.coalesce(F.col("sample_weight").cast("double"), F.lit(1.0)) if "sample_weight" in train.columns else F.lit(1.0)
    kept = materialize(train.select(
        *keys, "label", id_column, *[F.col(f).cast("double").alias(f) for f in features], own.alias("_own")), "train-rows")
    balanced = plan_of(kept, keys).select(*keys, F.lit(True).alias("_balanced"))
    weighed = kept.join(balanced, keys, "left").select(
        *keys, "label", id_column, *features, F.when(F.col("_balanced"), 1.0).otherwise(F.col("_own")).alias("sample_weight"))
    made = oversample(kept, keys, id_column, features=features)
    return weighed.unionByName(made.withColumn("sample_weight", F.lit(1.0)))
