"""Gradient-boosted trees on histograms, fitted by Spark tasks.

Values are binned once: numbers by quantiles, categories by frequency, and what is null (or unseen) has a bin of its own. Blocks of binned
rows are staged as Parquet. For a level of a tree, each task computes the margins of its rows from the trees so far and sums gradients and
Hessians by node, feature and bin; the sums of tasks are added up as a tree, and the driver, which holds one such sum (its size is that of the model: nodes,
features and bins, whatever the rows), takes the best split of each node. Of two siblings only the lighter is summed, the other is what
is left of their parent. A split is a set of bins: numbers are cut in their order, categories in the order of their mean gradient, and
the bin of nulls goes to the side where it gains more.

Tasks hold no state between levels, so a lost executor costs its blocks alone, read again from the staged table. Every ``FOLD`` trees the
margins so far are kept with the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.sources import files

#: Bins of a feature, the first for nulls.
BINS = 64
#: Relative error of quantiles is 1 / ACCURACY.
ACCURACY = 2000
FOLD = 16
FEW_PARTITIONS = 16
#: Grid of probabilities on which precision and recall of the validation rows are summed.
GRID = 4096


@dataclass
class Settings:
    """``rows`` and ``columns``: the shares drawn for each tree. ``patience``: trees without a better average precision on the validation rows before fitting ends; one tree stays at least."""

    trees: int = 60
    depth: int = 5
    step: float = 0.15
    l1: float = 0.0
    l2: float = 1.0
    least_hessian: float = 1.0
    least_gain: float = 0.0
    rows: float = 0.8
    columns: float = 0.8
    patience: int = 10
    seed: int = 7


@dataclass
class Tree:
    """Nodes from the root, children after their parent. ``left`` is 0 at a leaf; ``table`` says by bin whether a row goes left; ``cover`` is the node's Hessian."""

    feature: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    table: list[np.ndarray] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for own, new in ((self.feature, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.cover, cover), (self.gain, 0.0), (self.table, np.zeros(BINS, dtype=bool))):
            own.append(new)
        return len(self.value) - 1

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row (a column of ``bins``) has come to."""
        at = np.zeros(bins.shape[1], dtype=np.int64)
        feature, left, right, table = np.array(self.feature), np.array(self.left), np.array(self.right), np.stack(self.table)
        every = np.arange(bins.shape[1])
        while levels is None or levels > 0:
            inner = left[at] > 0
            if not inner.any():
                break
            goes = table[at, bins[feature[at], every]]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
            levels = None if levels is None else levels - 1
        return at

    def as_json(self) -> dict:
        return {**{k: getattr(self, k) for k in ("feature", "left", "right", "value", "cover", "gain")}, "table": [np.packbits(t).tobytes().hex() for t in self.table]}

    @classmethod
    def of_json(cls, data: dict) -> Tree:
        return cls(**{**data, "table": [np.unpackbits(np.frombuffer(bytes.fromhex(t), np.uint8))[:BINS].astype(bool) for t in data["table"]]})


@dataclass
class Boosted:
    """``edges`` of each number's bins, ``levels`` of each category from the second bin on, and the trees; features are numbered numbers first."""

    edges: dict[str, list[float]]
    levels: dict[str, list[str]]
    trees: list[Tree]

    @property
    def features(self) -> list[str]:
        return [*self.edges, *self.levels]

    def columns(self, rows: DataFrame) -> list[Column]:
        """The features as columns of ``rows``, null where it lacks them; NaN counts as null."""
        have = set(rows.columns)
        numbers = [F.nanvl(F.col(f).cast("double"), F.lit(None)) if f in have else F.lit(None).cast("double") for f in self.edges]
        words = [F.col(f).cast("string") if f in have else F.lit(None).cast("string") for f in self.levels]
        return [c.alias(f"_x{i}") for i, c in enumerate([*numbers, *words])]

    def binned(self, values: list) -> np.ndarray:
        """One row a feature: the bins of its values."""
        out = np.zeros((len(values), len(values[0]) if values else 0), dtype=np.uint8)
        for i, (own, e) in enumerate(zip(values, self.edges.values(), strict=False)):
            x = np.asarray(own, dtype=float)
            out[i] = np.where(np.isnan(x), 0, np.searchsorted(np.asarray(e), x) + 1)
        for i, levels in enumerate(self.levels.values(), start=len(self.edges)):
            place = {v: n + 1 for n, v in enumerate(levels)}
            out[i] = [place.get(v, 0) for v in values[i]]
        return out

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        total = np.zeros(bins.shape[1])
        for t in self.trees[first:]:
            total += np.asarray(t.value)[t.nodes(bins)]
        return total

    def score(self, rows: DataFrame, to: str = "_raw") -> DataFrame:
        """Adds the probability before calibration; the columns of ``rows`` go along as one struct."""
        model = rows.sparkSession.sparkContext.broadcast(self)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = model.value
            for b in batches:
                values = [c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sigmoid(own.margins(own.binned(values))))], ["row", to])

        whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *self.columns(rows))
        out = whole.mapInArrow(scored, T.StructType([whole.schema["row"], T.StructField(to, T.DoubleType())]))
        return out.select("row.*", to)

    def gains(self) -> np.ndarray:
        out = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(out, t.feature, t.gain)
        return out

    def as_json(self) -> dict:
        return {"edges": self.edges, "levels": self.levels, "trees": [t.as_json() for t in self.trees]}

    @classmethod
    def of_json(cls, data: dict) -> Boosted:
        return cls(data["edges"], data["levels"], [Tree.of_json(t) for t in data["trees"]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def bins_of(rows: DataFrame, numbers: list[str], categories: list[str]) -> Boosted:
    """A model without trees: quantile edges of the numbers, and the most frequent values of the categories (the others share the bin of nulls)."""
    at = [i / (BINS - 1) for i in range(1, BINS - 1)]
    own = [F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), at, ACCURACY) for f in numbers]
    found = rows.agg(*[c.alias(f"e{i}") for i, c in enumerate(own)]).first() if own else []
    edges = {f: sorted(set(found[i] or [])) for i, f in enumerate(numbers)}
    levels = {}
    for c in categories:
        counted = rows.select(F.col(c).cast("string").alias("v")).filter("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count"), "v")
        levels[c] = [r["v"] for r in counted.limit(BINS - 1).collect()]
    return Boosted(edges, levels, [])


@dataclass
class Block:
    """Binned rows of a task: bins (features x rows), labels, weights, whether a row validates, its margin so far, and a number for drawing."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    val: np.ndarray
    margin: np.ndarray
    number: int


def _blocks(rows: DataFrame, model: Boosted, label: str, weight: str, val: str) -> DataFrame:
    """Staged blocks of binned rows, as bytes."""
    shape = model.columns(rows)
    own = rows.select(F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"), F.col(val).alias("val"), *shape)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = [c.to_numpy(zero_copy_only=False) for c in b.columns[3:]]
                columns = [model.binned(values).tobytes(), *(np.asarray(b.column(i).to_numpy(zero_copy_only=False), dtype=k).tobytes() for i, k in enumerate((float, float, bool)))]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns] + [pa.array([b.num_rows])], ["bins", "label", "weight", "val", "n"])

    staged = own.mapInArrow(binned, "bins binary, label binary, weight binary, val binary, n long")
    return files.kept(staged.withColumn("number", F.monotonically_increasing_id()), "blocks")


def _open(row) -> Block:
    n = row["n"]
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, n)
    return Block(bins, np.frombuffer(row["label"]), np.frombuffer(row["weight"]), np.frombuffer(row["val"], bool), np.zeros(n), row["number"])


def _score_counts(block: Block, margin: np.ndarray) -> np.ndarray:
    """Weightless counts of validation rows by label and grid point of the probability."""
    at = (_sigmoid(margin[block.val]) * (GRID - 1)).astype(np.int64)
    return np.bincount(at + GRID * (block.label[block.val] > 0), minlength=2 * GRID).astype(float)


def _level(block: Block, trees: list[Tree], first: int, tree: Tree, slots: dict[int, int], columns: np.ndarray, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and Hessians by slot (of the nodes to be summed), drawn feature and bin, and, at the root, the counts of validation scores before this tree."""
    model = Boosted({}, {}, trees)
    margin = block.margin + model.margins(block.bins, first)
    scores = _score_counts(block, margin) if 0 in slots else np.zeros(0)
    drawn = ~block.val
    if share < 1:
        drawn &= np.random.default_rng((seed, len(trees), block.number)).random(len(drawn)) < share
    slot_of = np.full(len(tree.value), -1)
    slot_of[list(slots)] = list(slots.values())
    rows = np.flatnonzero(drawn)
    slot = slot_of[tree.nodes(block.bins[:, rows])]
    rows, slot = rows[slot >= 0], slot[slot >= 0]
    p = _sigmoid(margin[rows])
    gradient, hessian = block.weight[rows] * (p - block.label[rows]), block.weight[rows] * p * (1 - p)
    out = np.zeros((len(columns), 2, len(slots) * BINS))
    for i, f in enumerate(columns):
        key = slot * BINS + block.bins[f, rows]
        out[i, 0] = np.bincount(key, weights=gradient, minlength=len(slots) * BINS)
        out[i, 1] = np.bincount(key, weights=hessian, minlength=len(slots) * BINS)
    return out.reshape(len(columns), 2, len(slots), BINS), scores


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def average_precision(counts: np.ndarray) -> float:
    """Of counts by label and rising score, ties together."""
    negative, positive = counts[:GRID][::-1], counts[GRID:][::-1]
    hits, seen = np.cumsum(positive), np.cumsum(positive + negative)
    return float((positive * hits / np.maximum(1, seen)).sum() / max(1.0, hits[-1]))


class _Splitter:
    def __init__(self, s: Settings, columns: np.ndarray, numbers: int):
        self.s, self.columns, self.ordered = s, columns, columns >= numbers

    def worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.square(np.sign(g) * np.maximum(0, np.abs(g) - self.s.l1)) / (h + self.s.l2)

    def value(self, g: float, h: float) -> float:
        return float(-self.s.step * np.sign(g) * max(0.0, abs(g) - self.s.l1) / (h + self.s.l2))

    def best(self, sums: np.ndarray) -> tuple[float, int, np.ndarray, np.ndarray, np.ndarray] | None:
        """gain, feature, table, and sums (gradient, Hessian) on both sides of the best split of a node, from its sums (features x 2 x bins); None if none gains."""
        g, h = sums[:, 0], sums[:, 1]
        # categories in the order of their mean gradient; numbers stay in their own; the bin of nulls stays first
        order = np.tile(np.arange(BINS), (len(g), 1))
        mean = g[self.ordered] / (h[self.ordered] + 1.0)
        if len(mean):
            ranked = np.argsort(np.where(h[self.ordered] > 0, mean, np.inf), axis=1, kind="stable")
            order[self.ordered, 1:] = ranked[ranked > 0].reshape(len(mean), -1)
        g, h = np.take_along_axis(g, order, 1), np.take_along_axis(h, order, 1)
        total = np.stack([g.sum(axis=1), h.sum(axis=1)])
        whole = self.worth(*total)[:, None]
        sides = []
        for null_left in (False, True):
            gl, hl = np.cumsum(g[:, 1:], axis=1), np.cumsum(h[:, 1:], axis=1)
            if null_left:
                gl, hl = gl + g[:, :1], hl + h[:, :1]
            gr, hr = total[0][:, None] - gl, total[1][:, None] - hl
            gain = self.worth(gl, hl) + self.worth(gr, hr) - whole
            sides.append(np.where((hl >= self.s.least_hessian) & (hr >= self.s.least_hessian), gain, -np.inf))
        gains = np.stack(sides)
        side, f, cut = np.unravel_index(int(gains.argmax()), gains.shape)
        if not gains[side, f, cut] > max(self.s.least_gain, 1e-12):
            return None
        table = np.zeros(BINS, dtype=bool)
        table[order[f, 1 : cut + 2]] = True
        table[0] = bool(side)
        left = sums[f][:, table].sum(axis=1)
        return float(gains[side, f, cut]), int(self.columns[f]), table, left, sums[f].sum(axis=1) - left


def fit(rows: DataFrame, numbers: list[str], categories: list[str], label: str, weight: str, val: str, s: Settings | None = None) -> Boosted:
    """Trees of the rows where ``val`` is false, as many as are best by average precision of the rows where it is true (all, if none are).

    ``label`` is 0 or 1; null features are no reason to leave a row out. Equal rows weigh as often as they are there. No rows are an error.
    """
    s = s or Settings()
    model = bins_of(rows.filter(~F.col(val)), numbers, categories)
    staged = _blocks(rows, model, label, weight, val)
    blocks = staged.rdd.map(_open).persist(StorageLevel.MEMORY_AND_DISK)
    draw, best, folded, held = np.random.default_rng(s.seed), (-1.0, 0), 0, [blocks]
    try:
        while True:
            columns = np.sort(draw.choice(len(model.features), max(1, round(s.columns * len(model.features))), replace=False))
            tree, precision = _grown(held[-1], model.trees, folded, columns, len(model.edges), s)
            if precision is not None and model.trees and precision > best[0]:
                best = (precision, len(model.trees))
            stale = precision is not None and model.trees and len(model.trees) - best[1] >= s.patience
            if tree is None or stale:
                break
            model.trees.append(tree)
            if len(model.trees) - folded >= FOLD and len(model.trees) < s.trees:
                held.append(_folded(held[-1], model.trees, folded))
                folded = len(model.trees)
        return Boosted(model.edges, model.levels, model.trees[: best[1]] if best[0] >= 0 else model.trees)
    finally:
        for b in held:
            b.unpersist()
        files.release(staged)


def _folded(blocks: RDD, trees: list[Tree], first: int) -> RDD:
    own = Boosted({}, {}, list(trees))

    def fold(b: Block) -> Block:
        return Block(b.bins, b.label, b.weight, b.val, b.margin + own.margins(b.bins, first), b.number)

    return blocks.map(fold).persist(StorageLevel.MEMORY_AND_DISK)


def _grown(blocks: RDD, trees: list[Tree], first: int, columns: np.ndarray, numbers: int, s: Settings) -> tuple[Tree | None, float | None]:
    """The next tree, none if there are enough or nothing gains, and the average precision on the validation rows before it, none without such rows."""
    splitter, tree, share, seed = _Splitter(s, columns, numbers), Tree(), s.rows, s.seed
    root = tree.add(0.0, 0.0)
    level, sums, precision = [root], {}, None
    build, siblings = [root], {}
    for depth in range(s.depth):
        slots = {n: i for i, n in enumerate(build)}
        summed = blocks.map(lambda b, t=tree, sl=slots: _level(b, trees, first, t, sl, columns, share, seed))
        # a few sums are added up sooner than a further stage starts
        found, scores = summed.reduce(_added) if blocks.getNumPartitions() <= FEW_PARTITIONS else summed.treeReduce(_added)
        if depth == 0:
            precision = average_precision(scores) if scores[GRID:].any() else None
            if len(trees) >= s.trees:
                return None, precision
            tree.cover[root] = float(found[0, 1].sum())
            tree.value[root] = splitter.value(found[0, 0].sum(), tree.cover[root])
        own = {n: found[:, :, i] for n, i in slots.items()}
        own |= {n: sums[parent] - own[other] for n, (parent, other) in siblings.items()}
        sums, level_next, build, siblings = own, [], [], {}
        for n in level:
            split = splitter.best(sums[n])
            if split is None:
                continue
            tree.gain[n], tree.feature[n], tree.table[n], left, right = split
            kids = [tree.add(splitter.value(*side), float(side[1])) for side in (left, right)]
            tree.left[n], tree.right[n] = kids
            light, heavy = kids if left[1] <= right[1] else kids[::-1]
            build.append(light)
            siblings[heavy] = (n, light)
            level_next += kids
        level = level_next
        if not level:
            break
    return (tree, precision) if tree.left[root] else (None, precision)
