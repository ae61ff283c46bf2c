"""Random forests of many keys at once, kept as tables of trees.

Values are cut at quantiles into at most ``BINS`` bins, rows are packed into blocks of at most ``BLOCK`` rows of a key,
a row's bins in one number, and a tree grows a level at a time from counts of its open nodes by feature and bin. A key
of at most ``HELD`` blocks is grown where its blocks meet, some trees a task, and its rows keep their places in a tree from level to
level. The blocks of a larger key are dealt to bundles, and the counts of a level are summed by Spark over
(key, tree, group of nodes), ``SUMMED`` bundles at a time, so no task ever holds such a key. Both ways use
the same functions, and grow the same trees. The number of Spark jobs does not depend on the number of keys.

Draws are hashes of the row's id, the tree and the node: a rerun on other machines grows the same forest.

A tree is a row of arrays, one place a node, by node number: the root is 1, the children of n are 2n (value at most
the threshold) and 2n + 1; leaves have feature -1. Scoring packs the rows of a model into blocks, meets its
trees there and walks whole blocks down each tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deployrisk import contract as K
from deployrisk.session import materialize

BINS = 32
BLOCK = 100_000     # rows of a key handled together
HELD = 64           # blocks of a key that one task may hold
BUNDLE = 32         # blocks of a larger key that are counted together
STEP = 65_536       # rows taken down a tree together
SCORED = 20_000     # rows scored together
NODE_GROUP = 16     # nodes whose counts are summed together
SUMMED = 64         # bundles of blocks whose counts are summed together
FEATURES_TRIED = 4  # the root of ten features, rounded up

ARRAYS = "node array<int>, feature array<int>, threshold array<double>, p array<double>, gain array<double>, weight array<double>"
_POISSON = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.06131324019524039, 0.015328310048810098,
                      0.0030656620097620196, 0.0005109436682936699, 7.299195261338141e-05, 9.123994076672677e-06])
#: The same for whole 64-bit numbers, of which 53 bits count; and how often a row is drawn by the first 16 bits, 255 where they don't decide.
_LIMITS = np.array([int(np.ceil(p * 2.0 ** 53)) << 11 for p in _POISSON], np.uint64)
_BY_FIRST = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
_BY_FIRST = np.where(np.searchsorted(_LIMITS, _BY_FIRST, "right") == np.searchsorted(_LIMITS, _BY_FIRST + np.uint64((1 << 48) - 1), "right"),
                     np.searchsorted(_LIMITS, _BY_FIRST, "right"), 255).astype(np.uint8)
#: A bin takes five bits; a row's word holds its label, then the bins of so many features.
BITS, WORD = 5, 12


@dataclass(frozen=True)
class Growth:
    """How a tree grows."""

    depth: int = 8
    leaf_rows: int = 3
    seed: int = 42


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        values ^= values >> np.uint64(shift)
        if factor:
            values *= np.uint64(factor)
    return values


def drawn(ids: np.ndarray, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows drawn for the tree, and how often each: a Poisson number of mean one."""
    unit = mixed(ids ^ mixed(np.array([seed * 1_000_003 + tree], np.uint64)))
    times = _BY_FIRST.take((unit >> np.uint64(48)).view(np.int64))
    close = np.flatnonzero(times == 255)
    times[close] = np.searchsorted(_LIMITS, unit[close], "right")
    rows = np.flatnonzero(times != 0)
    return rows, times.take(rows)


def draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row was drawn for the tree."""
    times = np.zeros(len(ids), np.int64)
    rows, times_drawn = drawn(ids, tree, seed)
    times[rows] = times_drawn
    return times


def tried(nodes: np.ndarray, tree: int, features: int, seed: int) -> np.ndarray:
    """The features each node may split on, a row a node."""
    base = mixed(np.array([seed * 7_368_787 + tree], np.uint64))
    order = mixed((nodes.astype(np.uint64)[:, None] * np.uint64(64) + np.arange(features, dtype=np.uint64)) ^ base)
    return np.argsort(order, axis=1)[:, :FEATURES_TRIED]


# --- growing -------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes so far; open ones are those of the last level that were not made leaves."""

    node: np.ndarray
    feature: np.ndarray
    cut: np.ndarray         # a bin: rows of at most this bin go left
    p: np.ndarray
    gain: np.ndarray
    weight: np.ndarray

    @staticmethod
    def empty() -> Tree:
        return Tree(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float, float)))

    def grown(self, other: Tree) -> Tree:
        return Tree(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in Tree.__dataclass_fields__))

    def part(self, which: np.ndarray) -> Tree:
        return Tree(*(getattr(self, f)[which] for f in Tree.__dataclass_fields__))

    def open(self, level: int) -> np.ndarray:
        """Numbers of the nodes to be counted at this level."""
        if not level:
            return np.array([1])
        split = self.node[(self.feature >= 0) & (self.node >= 1 << level - 1)]
        return np.sort(np.concatenate([split * 2, split * 2 + 1]))


@dataclass
class Level:
    """The nodes of a level of a tree, for rows on their way down: places count from the level's first node."""

    word: np.ndarray | None     # where a row has several words, the one that holds the feature
    mask: np.ndarray
    cut: np.ndarray             # shifted like the feature's bin
    leaf: np.ndarray
    leaves: bool

    @staticmethod
    def of(tree: Tree, level: int, words: int) -> Level:
        size = 1 << level
        there = np.flatnonzero((tree.node >= size) & (tree.node < 2 * size) & (tree.feature >= 0))
        place, (word, at) = tree.node[there] - size, np.divmod(tree.feature[there], WORD)
        made = Level(np.zeros(size, np.int64) if words > 1 else None, np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, bool), len(there) < size)
        if words > 1:
            made.word[place] = word
        made.mask[place], made.cut[place], made.leaf[place] = (BINS - 1) << at * BITS + 1, tree.cut[there] << at * BITS + 1, False
        return made


def _picked(words: np.ndarray, which: np.ndarray | None) -> np.ndarray:
    return words[0] if which is None else words[which, np.arange(words.shape[1])]


@dataclass
class Sample:
    """Rows drawn for a tree, and the place of each in its level."""

    words: np.ndarray           # [word, row]
    times: np.ndarray
    weight: np.ndarray | None   # of the drawn rows; None where the label decides it
    at: np.ndarray

    @staticmethod
    def of(block: Packed, part: slice, tree: int, seed: int) -> Sample:
        rows, times = drawn(block.ids[part], tree, seed)
        weight = None if len(block.weight) == 2 else block.weight[part].take(rows) * times
        return Sample(np.stack([w[part].take(rows) for w in block.words]), times.astype(float), weight, np.zeros(len(rows), np.int64))

    def kept(self, rows: np.ndarray) -> Sample:
        return Sample(self.words.take(rows, axis=1), self.times.take(rows), None if self.weight is None else self.weight.take(rows), self.at.take(rows))

    def down(self, level: Level) -> Sample:
        """The rows a level further down; those in leaves have arrived."""
        going = np.flatnonzero(~level.leaf.take(self.at)) if level.leaves else self.at
        sample = self if len(going) == len(self.at) else self.kept(going)
        right = _picked(sample.words, None if level.word is None else level.word.take(sample.at)) & level.mask.take(sample.at)
        sample.at = 2 * sample.at + (right > level.cut.take(sample.at))
        return sample


class Counts:
    """Counts of the open nodes of a level of one tree, by tried feature, bin and label."""

    def __init__(self, nodes: np.ndarray, tree: int, level: int, features: int, growth: Growth):
        self.nodes, self.first, self.features = nodes, 1 << level, tried(nodes, tree, features, growth.seed)
        self.slot = None
        if len(nodes) < self.first:
            self.slot = np.full(self.first, -1)
            self.slot[nodes - self.first] = np.arange(len(nodes))
        self.word, self.shift = np.divmod(self.features, WORD)
        self.shift *= BITS
        self.several = features > WORD
        size = (self.features.shape[1], len(nodes) * BINS * 2)
        self.rows, self.weight, self.by_label = np.zeros(size), None, None

    def add(self, sample: Sample, by_label: np.ndarray) -> None:
        """Counts rows, all of which are at open nodes. ``by_label`` has the weight of each label, if it decides."""
        slot = sample.at if self.slot is None else self.slot.take(sample.at)
        base = slot * (BINS * 2)
        base += sample.words[0] & 1
        weight = sample.weight
        if weight is None:
            known = by_label if self.by_label is None else np.where(np.isnan(self.by_label), by_label, self.by_label)
            if self.weight is None and (np.isnan(by_label) | (known == by_label)).all():
                self.by_label = known
            else:
                weight = by_label.take(sample.words[0] & 1) * sample.times
        if weight is not None and self.weight is None:      # from here on weights differ among rows of a label
            self.weight = self._weighed()
        for tried_ in range(self.features.shape[1]):
            word = _picked(sample.words, self.word[:, tried_].take(slot) if self.several else None)
            key = word >> self.shift[:, tried_].take(slot)
            key &= (BINS - 1) * 2
            key += base
            np.add.at(self.rows[tried_], key, sample.times)
            if weight is not None:
                np.add.at(self.weight[tried_], key, weight)

    def _weighed(self) -> np.ndarray:
        by_label = np.zeros(2) if self.by_label is None else np.nan_to_num(self.by_label)
        return (self.rows.reshape(-1, 2) * by_label).reshape(self.rows.shape)

    def found(self) -> np.ndarray:
        """[node, tried feature, bin, (weight of fine rows, weight of risky rows, rows)]."""
        shape = (self.features.shape[1], len(self.nodes), BINS, 2)
        weight = (self._weighed() if self.weight is None else self.weight).reshape(shape)
        return np.concatenate([weight, self.rows.reshape(shape).sum(axis=-1, keepdims=True)], axis=-1).swapaxes(0, 1)


def counts(block: Block, tree: int, nodes: np.ndarray, at: np.ndarray, growth: Growth) -> np.ndarray:
    """The counts of a block whose rows are at the given nodes of one level."""
    packed, level = Packed.of(block), int(nodes[0]).bit_length() - 1
    sample = Sample.of(packed, slice(None), tree, growth.seed)
    sample.at = at.take(drawn(packed.ids, tree, growth.seed)[0]) - (1 << level)
    made = Counts(nodes, tree, level, block.bins.shape[1], growth)
    made.add(sample.kept(np.flatnonzero(np.isin(sample.at + (1 << level), nodes))), packed.weight[:2])
    return made.found()


def split(found: np.ndarray, nodes: np.ndarray, tree: int, features: int, level: int, growth: Growth) -> Tree:
    """The nodes of a level with their best splits, from their counts; those of the last level too, as leaves."""
    total = found[:, 0].sum(axis=1)

    def leaves(nodes: np.ndarray, total: np.ndarray) -> Tree:
        weight = total[:, 0] + total[:, 1]
        p = np.divide(total[:, 1], weight, out=np.zeros(len(nodes)), where=weight > 0)
        return Tree(nodes, np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), p, np.zeros(len(nodes)), weight)

    own = leaves(nodes, total)
    if level >= growth.depth:
        return own

    def impurity(fine: np.ndarray, risky: np.ndarray) -> np.ndarray:
        """Gini impurity times weight."""
        both = fine + risky
        return np.divide(2 * fine * risky, both, out=np.zeros_like(both), where=both > 0)

    left = np.cumsum(found, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    gain = impurity(total[:, 0], total[:, 1])[:, None, None] - impurity(left[..., 0], left[..., 1]) - impurity(right[..., 0], right[..., 1])
    allowed = (left[..., 2] >= growth.leaf_rows) & (right[..., 2] >= growth.leaf_rows)
    gain = np.where(allowed, gain, -1.0).reshape(len(nodes), -1)
    best = gain.argmax(axis=1)
    every = np.arange(len(nodes))
    most = gain[every, best]
    splits = most > 1e-9 * np.maximum(own.weight, 1e-300)
    which, cut = np.divmod(best, BINS - 1)
    feature = tried(nodes, tree, features, growth.seed)[every, which]
    own = Tree(nodes, np.where(splits, feature, -1), np.where(splits, cut, 0), own.p, np.where(splits, most, 0.0), own.weight)
    if level + 1 < growth.depth or not splits.any():
        return own
    sides = [part.reshape(len(nodes), -1, 3)[every, best][splits] for part in (left, right)]
    return own.grown(leaves(np.concatenate([nodes[splits] * 2, nodes[splits] * 2 + 1]), np.maximum(np.concatenate(sides), 0.0)))


def grow_together(blocks: Sequence[Packed], tree: int, growth: Growth, features: int) -> Tree:
    """A whole tree from the blocks of a key."""
    samples = [(Sample.of(b, slice(i, i + STEP), tree, growth.seed), b.weight[:2]) for b in blocks for i in range(0, len(b.ids), STEP)]
    grown = Tree.empty()
    for level in range(max(growth.depth, 1)):
        nodes = grown.open(level)
        if not len(nodes):
            break
        if level:
            above = Level.of(grown, level - 1, -(-features // WORD))
            samples = [(sample.down(above), weight) for sample, weight in samples]
        made = Counts(nodes, tree, level, features, growth)
        for sample, weight in samples:
            made.add(sample, weight)
        grown = grown.grown(split(made.found(), nodes, tree, features, level, growth))
    return grown


def grow(block: Block, tree: int, growth: Growth) -> Tree:
    """A whole tree from one block."""
    return grow_together([Packed.of(block)], tree, growth, block.bins.shape[1])


def count_level(blocks: Sequence[Packed], tree: int, grown: Tree, level: int, growth: Growth, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The open nodes of a tree grown so far and their counts in the blocks."""
    nodes = grown.open(level)
    made = Counts(nodes, tree, level, features, growth)
    above = [Level.of(grown, i, -(-features // WORD)) for i in range(level)]
    for block in blocks if len(nodes) else ():
        for i in range(0, len(block.ids), STEP):
            sample = Sample.of(block, slice(i, i + STEP), tree, growth.seed)
            for one in above:
                sample = sample.down(one)
            made.add(sample, block.weight[:2])
    return nodes, made.found()


# --- blocks --------------------------------------------------------------------

@dataclass
class Block:
    """Rows of a key."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    ids: np.ndarray


@dataclass
class Packed:
    """Rows of a key in few bytes."""

    words: list[np.ndarray]     # each row's label and bins
    weight: np.ndarray          # of each row, or of the two labels where these decide it (NaN for one that no row has)
    ids: np.ndarray

    @staticmethod
    def of(block: Block) -> Packed:
        words = []
        for start in range(0, block.bins.shape[1], WORD):
            word = (block.label == 1).astype(np.int64)
            for i, own in enumerate(block.bins[:, start:start + WORD].T):
                word |= own.astype(np.int64) << i * BITS + 1
            words.append(word)
        risky, by_label = block.label == 1, np.zeros(2)
        for label in (0, 1):
            own = block.weight[risky == label]
            if len(own) and own.min() != own.max():
                # one row more, so that two rows are not taken for two labels
                return Packed(words, np.append(block.weight, 0.0).astype(float), block.ids)
            by_label[label] = own[0] if len(own) else np.nan
        return Packed(words, by_label, block.ids)

    @staticmethod
    def read(column: Callable[[str], pa.Scalar]) -> Packed:
        ids = np.frombuffer(column("ids").as_buffer(), "<u8")
        return Packed(list(np.frombuffer(column("words").as_buffer(), "<i8").reshape(-1, len(ids))) if len(ids) else [], np.frombuffer(column("weights").as_buffer(), "<f8"), ids)


def cut_points(rows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys and ``cuts``: for each feature the middles between its distinct quantiles, fewer than ``BINS``."""
    steps = [i / (BINS - 1) for i in range(BINS)]
    met = rows.groupBy(*keys).agg(*[F.percentile_approx(F.col(f).cast("double"), steps, 10_000).alias(f"_{i}") for i, f in enumerate(features)],
                                  F.count(F.lit(1)).alias("rows"))

    def middles(values: Column) -> Column:
        values = F.array_distinct(values)
        return F.transform(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), lambda v, i: (v + F.get(values, i)) / 2)
    return met.select(*keys, "rows", F.array(*[middles(F.col(f"_{i}")) for i in range(len(features))]).alias("cuts"))


def _pack(keys: Sequence[str], features: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def pack(rows: pa.Table, cuts: pa.Table) -> pa.Table:
        names = [*keys, "block", "blocks", "cuts", "words", "weights", "ids"]
        if not rows.num_rows or not cuts.num_rows:
            types = [rows.schema.field(k).type for k in keys] + [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))] + [pa.binary()] * 3
            return pa.table([pa.array([], t) for t in types], names)
        thresholds = cuts.column("cuts")[0].as_py()
        bins = np.stack([np.searchsorted(np.array(t, float), rows.column(f).to_numpy().astype(float)) for f, t in zip(features, thresholds, strict=True)], axis=1)
        block = Packed.of(Block(bins.astype(np.uint8), rows.column("label").to_numpy(), rows.column("weight").to_numpy(), rows.column("row_hash").to_numpy()))
        parts = [np.stack(block.words).astype("<i8"), block.weight.astype("<f8"), block.ids.astype("<i8")]
        first = cuts.slice(0, 1)
        return pa.table([*(first.column(k) for k in [*keys, "block", "blocks", "cuts"]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names)
    return pack


def blocks_of(rows: DataFrame, keys: Sequence[str], id_column: str, features: Sequence[str], seed: int) -> DataFrame:
    """One row a block: keys, block, blocks, cuts and the packed rows.

    ``rows`` has keys, the id, label, weight and the features, none of them null.
    """
    keys = list(keys)
    cuts = materialize(cut_points(rows, keys, features).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long")), "forest-cuts")
    sizes = cuts.select(*keys, "blocks")
    dealt = rows.select(*keys, "label", "weight", *features, F.xxhash64(F.col(id_column), F.lit(seed)).alias("row_hash")).join(sizes, keys)
    # apart from the draws, which use the hash's other bits
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row_hash"), F.col("blocks"))).drop("blocks")
    spread = cuts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*keys, "block", "blocks", "cuts")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", block long, blocks long, cuts array<array<double>>, words binary, weights binary, ids binary"
    parts = [*keys, "block"]
    return dealt.groupBy(*parts).cogroup(spread.groupBy(*parts)).applyInArrow(_pack(keys, features), schema)


def _rows(tree: Tree, cuts: list[list[float]] | None) -> dict[str, list]:
    order = np.argsort(tree.node)
    feature, cut = tree.feature[order].tolist(), tree.cut[order].tolist()
    threshold = [float(c) if cuts is None else (cuts[f][c] if f >= 0 else 0.0) for f, c in zip(feature, cut, strict=True)]
    return {"node": tree.node[order].tolist(), "feature": feature, "threshold": threshold, "p": tree.p[order].tolist(),
            "gain": tree.gain[order].tolist(), "weight": tree.weight[order].tolist()}


def _arrays(rows: list[dict], keys: pa.Schema) -> pa.RecordBatch:
    types = {"tree": pa.int32(), "node": pa.list_(pa.int32()), "feature": pa.list_(pa.int32()), **{c: pa.list_(pa.float64()) for c in ("threshold", "p", "gain", "weight")}}
    types = {**{f.name: f.type for f in keys}, **types}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))


def _key_schema(frame: DataFrame, keys: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    return "".join(f"{k} {types[k]}, " for k in keys)


def _blocks(table: pa.Table) -> list[Packed]:
    """The blocks of a table in order."""
    return [Packed.read(lambda name, i=i: table.column(name)[i]) for i in np.argsort(table.column("block").to_numpy())]


def fit(rows: DataFrame, keys: Sequence[str], id_column: str, trees: int, growth: Growth = Growth(), features: Sequence[str] = K.FEATURES) -> DataFrame:
    """keys, tree and the arrays of each tree: a forest for each key.

    ``rows`` has keys, the id, label (0 or 1), weight and the features.
    """
    keys, spark = list(keys), rows.sparkSession
    blocks = materialize(blocks_of(rows, keys, id_column, features, growth.seed), "forest-blocks")
    schema = _key_schema(blocks, keys) + "tree int, " + ARRAYS
    width = len(features)
    # as many groups of trees as keep the cluster's cores busy, however few bytes the blocks are
    tasks = 8 * max(spark.sparkContext.defaultParallelism, 1)
    every, many, most = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("blocks") > HELD).cast("long")), F.lit(0)), F.max("blocks")).first()

    def whole(table: pa.Table) -> pa.Table:
        held, first = _blocks(table), table.slice(0, 1).select([*keys, "cuts", "group", "groups"]).to_pylist()[0]
        own = [t for t in range(trees) if t * first["groups"] // trees == first["group"]]
        made = [{**{k: first[k] for k in keys}, "tree": t, **_rows(grow_together(held, t, growth, width), first["cuts"])} for t in own]
        return pa.Table.from_batches([_arrays(made, pa.schema([table.schema.field(k) for k in keys]))])

    # the more rows a key has, the fewer of its trees a task grows
    groups = F.least(F.lit(trees), F.ceil(F.col("blocks") * F.lit(tasks / max(every, 1)))).cast("int")
    spot = [*keys, "group"]
    small = blocks.filter(F.col("blocks") <= HELD).withColumn("groups", groups).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    # more partitions than groups, so that few share one
    grown = small.repartition(4 * tasks, *spot).groupBy(*spot).applyInArrow(whole, schema)
    if not many:
        return grown
    large = _by_levels(blocks.filter(F.col("blocks") > HELD), keys, trees, growth, width, many, most)
    return large if many == every else grown.unionByName(large)


def _read_trees(table: pa.Table) -> dict[int, Tree]:
    return {t["tree"]: Tree(*(np.array(t[c], k) for c, k in (("node", np.int64), ("feature", np.int64), ("threshold", np.int64), ("p", float), ("gain", float), ("weight", float))))
            for t in table.to_pylist()}


def _by_levels(blocks: DataFrame, keys: list[str], trees: int, growth: Growth, width: int, many: int, most: int) -> DataFrame:
    """Forests of keys with many blocks: the counts of a level are summed over bundles of blocks.

    There are ``many`` blocks, and ``most`` of one key. A bundle meets all trees of its key in one task, or in
    several where the bundles are fewer than the tasks.
    """
    key_schema, spark = _key_schema(blocks, keys), blocks.sparkSession
    work = max(spark.sparkContext.defaultParallelism, 1)
    size = min(BUNDLE, max(1, many // (4 * work)))
    many, most = -(-many // size), -(-most // size)
    groups = min(trees, max(1, -(-2 * work // many)))
    per = -(-trees // groups)
    spot = [*keys, "bundle", "group"]
    # a few bundles a task at most, however few bytes they are, and few that share one where there are cores for more
    tasks = max(32 * work, -(-many * groups // 4))
    held = blocks.select(*keys, "block", F.floor(F.col("block") / size).alias("bundle"), "words", "weights", "ids").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    places = materialize(held.select(*spot).distinct(), "forest-places")
    names = [*keys, "tree", "part", "bundle", "nodes", "counts"]
    partial_schema = f"{key_schema}tree int, part int, bundle long, nodes array<int>, counts binary"
    tree_schema = f"{key_schema}tree int, {ARRAYS}"
    pieces = [*keys, "tree", "part"]
    # cuts as bins
    state = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(tree_schema).fields])

    def table_of(own: pa.Table, rows: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.Table:
        columns = [pa.array([own.column(k)[0].as_py()] * len(rows), own.schema.field(k).type) for k in keys]
        tree, part, bundle, nodes, found = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.table([*columns, pa.array(tree, pa.int32()), pa.array(part, pa.int32()), pa.array(bundle, pa.int64()), pa.array([n.tolist() for n in nodes], pa.list_(pa.int32())),
                         pa.array([f.tobytes() for f in found], pa.binary())], names)

    def count(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def work(own: pa.Table, known: pa.Table) -> pa.Table:
            made, forest = [], _read_trees(known)
            if not own.num_rows:
                return table_of(own, made)
            held, bundle, group = _blocks(own), own.column("bundle")[0].as_py(), own.column("group")[0].as_py()
            for t in range(group * per, min(trees, (group + 1) * per)):
                nodes, found = count_level(held, t, forest.get(t, Tree.empty()), level, growth, width)
                made += [(t, i // NODE_GROUP, bundle, nodes[i:i + NODE_GROUP], found[i:i + NODE_GROUP]) for i in range(0, len(nodes), NODE_GROUP)]
            return table_of(own, made)
        return work

    def summed(table: pa.Table) -> np.ndarray:
        # bundles in order, so that a rerun adds up the same
        return sum(np.frombuffer(c, float) for c in table.sort_by("bundle").column("counts").to_pylist()).reshape(-1, min(width, FEATURES_TRIED), BINS, 3)

    def fold(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        return table_of(table, [(first["tree"], first["part"], first["bundle"] // SUMMED, np.array(first["nodes"]), summed(table))])

    def best(level: int) -> Callable[[pa.Table], pa.Table]:
        def work(table: pa.Table) -> pa.Table:
            first = table.slice(0, 1).to_pylist()[0]
            found = split(summed(table), np.array(first["nodes"]), first["tree"], width, level, growth)
            # nodes of one level a row, so that rows in order are nodes in order
            levels = [found.part(found.node >> level == 1), found.part(found.node >> level + 1 == 1)]
            made = [{**{k: first[k] for k in keys}, "tree": first["tree"], **_rows(t, None)} for t in levels if len(t.node)]
            return pa.Table.from_batches([_arrays(made, pa.schema([table.schema.field(k) for k in keys]))])
        return work

    for level in range(max(growth.depth, 1)):
        asked = held.repartition(tasks, *spot).groupBy(*spot)
        sent = places.join(state.withColumn("group", F.floor(F.col("tree") / per).cast("int")), [*keys, "group"]).repartition(tasks, *spot).groupBy(*spot)
        partial, left = asked.cogroup(sent).applyInArrow(count(level), partial_schema), most
        while left > SUMMED:
            partial, left = partial.groupBy(*pieces, F.floor(F.col("bundle") / SUMMED)).applyInArrow(fold, partial_schema), -(-left // SUMMED)
        found = materialize(partial.repartition(tasks, *pieces).groupBy(*pieces).applyInArrow(best(level), tree_schema), "forest-level")
        if found.isEmpty():
            break
        both = state.unionByName(found).groupBy(*keys, "tree").agg(*[
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.get("node", F.lit(0)).alias("first"), F.col(c).alias("own")))), lambda x: x.own)).alias(c)
            for c in ("node", "feature", "threshold", "p", "gain", "weight")])
        state = materialize(both, "forest-grown")
    # bins become values
    cuts = blocks.filter("block = 0").select(*keys, "cuts")
    named = state.join(cuts, keys)
    value = F.transform("threshold", lambda c, i: F.when(F.get("feature", i) >= 0, F.get(F.get("cuts", F.get("feature", i)), c.cast("int"))).otherwise(0.0))
    return named.select(*keys, "tree", "node", "feature", value.alias("threshold"), "p", "gain", "weight")


# --- scoring -------------------------------------------------------------------

def _lists(table: pa.Table, column: str) -> list[np.ndarray]:
    """A column of lists, an array a row."""
    values = table.column(column).combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    ends = np.cumsum(values.value_lengths().to_numpy())
    return np.split(values.flatten().to_numpy(), ends[:-1])


def walked(values: np.ndarray, trees: pa.Table) -> np.ndarray:
    """Mean probability of the trees for each row of values.

    A value becomes its place among the thresholds of its feature, and a row's places lie in few 64-bit words.
    """
    nodes, features, thresholds, chances = (_lists(trees, c) for c in ("node", "feature", "threshold", "p"))
    feature, threshold = np.concatenate(features), np.concatenate(thresholds)
    known = [np.unique(threshold[feature == f]) for f in range(values.shape[1])]
    words, word, shift, used = [np.zeros(len(values), np.int64)], np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), 0
    for f, own in enumerate(known):
        bits = len(own).bit_length()
        if used + bits > 62:
            words, used = [*words, np.zeros(len(values), np.int64)], 0
        word[f], shift[f], used = len(words) - 1, used, used + bits
        # an unknown value goes left, as if it were the least
        words[-1] |= np.where(np.isnan(values[:, f]), 0, np.searchsorted(own, values[:, f])) << shift[f]
    words, total = np.stack(words), np.zeros(len(values))
    masks = np.array([(1 << len(own).bit_length()) - 1 for own in known]) << shift
    for node, own, limit, p in zip(nodes, features, thresholds, chances, strict=True):
        order = np.argsort(node)
        node, own, limit = node[order].astype(np.int64), own[order].astype(np.int64), limit[order]
        inner = np.flatnonzero(own >= 0)
        # leaves lead to themselves; a right child follows its left one
        left, mask, cut, which = np.arange(len(node)), np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        left[inner], mask[inner], which[inner] = np.searchsorted(node, 2 * node[inner]), masks[own[inner]], word[own[inner]]
        for f in np.unique(own[inner]):
            there = own == f
            cut[there] = np.searchsorted(known[f], limit[there]) << shift[f]
        at = np.zeros(len(values), np.int64)
        for _ in range(int(node[-1]).bit_length() - 1):
            held = _picked(words, which.take(at) if len(words) > 1 else None)
            at = left.take(at) + ((held & mask.take(at)) > cut.take(at))
        total += p[order].take(at)
    return total / max(len(nodes), 1)


def predict(trees: DataFrame, rows: DataFrame, keys: Sequence[str], id_column: str, features: Sequence[str] = K.FEATURES, as_: str = "p") -> DataFrame:
    """The rows that have a forest under their keys, with its probability.

    Rows of a key are dealt into blocks by a hash of their id, and the key's trees are sent to each block.
    """
    keys = list(keys)
    columns = rows.columns
    # written, so that Spark knows how few they are and the rows stay where they lie
    sizes = materialize(rows.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / min(BLOCK, SCORED)) + 1).alias("_blocks")), "scored-sizes")
    names = [f"_f{i}" for i in range(len(features))]
    dealt = rows.select(*columns, *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)]).join(sizes, keys)
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(id_column), F.col("_blocks"))).drop("_blocks")
    sent = trees.select(*keys, "tree", "node", "feature", "threshold", "p").join(sizes, keys)
    sent = sent.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")

    def score(held: pa.Table, forest: pa.Table) -> pa.Table:
        if not held.num_rows or not forest.num_rows:
            return held.select(columns).slice(0, 0).append_column(as_, pa.array([], pa.float64()))
        values = np.stack([held.column(n).to_numpy() for n in names], axis=1)
        return held.select(columns).append_column(as_, pa.array(walked(values, forest.sort_by("tree"))))

    schema = rows.select(*columns).withColumn(as_, F.lit(0.0)).schema
    parts = [*keys, "_block"]
    # some blocks a task, however few bytes they are
    blocks = sizes.agg(F.sum("_blocks")).first()[0] or 1
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-blocks // 8))
    return dealt.repartition(tasks, *parts).groupBy(*parts).cogroup(sent.repartition(tasks, *parts).groupBy(*parts)).applyInArrow(score, schema)


def nodes(trees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a node."""
    zipped = F.explode(F.arrays_zip("node", "feature", "threshold", "p", "gain", "weight")).alias("_n")
    return trees.select(*keys, "tree", zipped).select(*keys, "tree", "_n.*")


def importances(trees: DataFrame, keys: Sequence[str], features: Sequence[str] = K.FEATURES) -> DataFrame:
    """keys and ``importances`` in contract order: each tree's impurity gains as shares, averaged; zeros for stumps."""
    keys = list(keys)
    gains = nodes(trees, keys).groupBy(*keys, "tree").agg(*[
        F.coalesce(F.sum(F.when(F.col("feature") == i, F.col("gain"))), F.lit(0.0)).alias(f"_{i}") for i in range(len(features))])
    total = sum((F.col(f"_{i}") for i in range(len(features))), F.lit(0.0))
    shares = gains.select(*keys, *[F.when(total > 0, F.col(f"_{i}") / total).otherwise(0.0).alias(f"_{i}") for i in range(len(features))])
    summed = shares.groupBy(*keys).agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(features))])
    return summed.select(*keys, F.array(*[F.when(total > 0, F.col(f"_{i}") / total).otherwise(0.0) for i in range(len(features))]).alias("importances"))


def from_saved(saved: DataFrame) -> DataFrame:
    """tree and arrays from the node table that MLlib saves with a random forest (``treeID`` and ``nodeData``)."""
    def number(rows: list[dict]) -> list[dict]:
        by_id = {r["id"]: r for r in rows}
        found, waiting = [], [(0, 1)]
        while waiting:
            at, node = waiting.pop()
            r = by_id[at]
            inner = r["leftChild"] >= 0
            stats = r["impurityStats"]
            whole = sum(stats) or 1.0
            found.append({"node": node, "feature": r["split"]["featureIndex"] if inner else -1,
                          "threshold": r["split"]["leftCategoriesOrThreshold"][0] if inner else 0.0, "p": stats[1] / whole,
                          "gain": max(r["gain"], 0.0) * whole if inner else 0.0, "weight": float(sum(stats))})
            if inner:
                waiting += [(r["leftChild"], 2 * node), (r["rightChild"], 2 * node + 1)]
        return sorted(found, key=lambda r: r["node"])

    def convert(table: pa.Table) -> pa.Table:
        made = number([r["nodeData"] for r in table.to_pylist()])
        own = {"tree": table.column("treeID")[0].as_py(), **{c: [r[c] for r in made] for c in ("node", "feature", "threshold", "p", "gain", "weight")}}
        return pa.Table.from_batches([_arrays([own], pa.schema([]))])

    return saved.select("treeID", "nodeData").groupBy("treeID").applyInArrow(convert, "tree int, " + ARRAYS)
