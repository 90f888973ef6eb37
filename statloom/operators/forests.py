"""Random forests of regression trees: rows are cut into bins once, then a level of all trees is one pass over them.

The forest is the one pyspark.ml describes: each tree weighs the rows by Poisson(1) draws, each node sees a random part of the
columns, a column has at most ``BINS`` bins, and a split takes the largest fall in variance.  A task adds up one tree after the
other, so that its sums stay in the processor's cache; they are then added up by tree.  The driver holds the trees alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import fresh_path

BINS = 32
PIECE = 2048  # rows stored together while they are dealt to tasks
BLOCK = 32768  # rows that are weighed together
SHARE = 1 << 22  # rows of a task at most; it sends as many sums whatever their number
TOP = 4  # levels that all rows go down together
NOISE = 1e-12  # a gain below this part of the sums it is the difference of is none

# Poisson(1) by a table over 16 random bits; cells that hold a step of the distribution function are marked and drawn finer
_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
_LOW, _HIGH = (np.searchsorted(_STEPS, (np.arange(65536) + e) / 65536, side=s) for e, s in ((0, "right"), (1, "left")))
_MARK = 255
_DRAWS = np.where(_LOW == _HIGH, _LOW, _MARK).astype(np.uint8)


@dataclass
class Tree:
    """Nodes in the order of their making; a row goes from ``child`` to ``child + 1`` if its bin is above the cut.  A leaf is its
    own child."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.full(1, BINS, np.uint8))
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    value: np.ndarray | None = field(default_factory=lambda: np.zeros(1))
    live: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))  # nodes that may be split next
    gains: np.ndarray | None = None  # by column
    depth: int = 0

    def find(self, flat: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        """Deepest node of each of the rows; ``flat`` holds the bins of n rows, one column after the other.

        Down the first ``TOP`` levels all n rows go together, a node after the other by comparisons of bytes; below, each row looks
        up its own way.
        """
        heap, place = np.zeros(1, np.int64), np.zeros(n, np.uint8)  # the nodes of a level, and the place of each row in it
        here, above, turn = np.empty(n, bool), np.empty(n, bool), np.empty(n, bool)
        top = min(self.depth, TOP)
        for _ in range(top):
            split = self.child[heap] != heap
            turn[:] = False
            for j in np.flatnonzero(split).tolist():
                low = int(self.feature[heap[j]]) * n
                np.greater(flat[low:low + n], self.cut[heap[j]], out=above)
                if len(heap) > 1:
                    np.equal(place, j, out=here)
                    above &= here
                turn |= above
            place += place
            place |= turn.view(np.uint8)
            heap = np.column_stack([self.child[heap], self.child[heap] + split]).ravel()
        node = heap.take(place.take(rows))
        if self.depth > top:
            places, child, at = self.feature * np.int64(n), self.child.astype(np.int64), np.empty(len(rows), np.int64)
            for _ in range(self.depth - top):
                np.take(places, node, out=at, mode="clip")
                at += rows
                above = flat.take(at) > self.cut.take(node)
                np.take(child, node, out=at, mode="clip")
                np.add(at, above, out=node)
        return node


class _Level:
    """Where the sums of a tree's live nodes lie: bins after bins of the columns each of them sees."""

    def __init__(self, sizes: np.ndarray, slots: np.ndarray):
        self.slots = slots  # a line a node
        own = sizes[slots]
        self.starts = np.cumsum([0, *own.ravel()[:-1]]).reshape(own.shape)
        self.cells = int(own.sum())
        self.own = own

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell, which column of which node it belongs to, counted on, and its bin."""
        lines = np.repeat(np.arange(self.own.size), self.own.ravel())
        return lines, np.arange(self.cells) - self.starts.ravel()[lines]


def draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """Poisson(1) weights of a block's rows in one tree, the same in every pass."""
    rng = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, tree, block]))
    bits = rng.bit_generator.random_raw((n + 3) // 4).view(np.uint16)[:n]  # what rng.bytes(2 * n) gives, sooner
    found = _DRAWS.take(bits)
    marked = np.flatnonzero(found == _MARK)
    found[marked] = np.searchsorted(_STEPS, (bits[marked] + rng.random(len(marked))) / 65536, side="right")
    return found


# ---------------------------------------------------------------- bins

def _values(batches):
    """For each column its distinct values, none if there are more than ``BINS``; beside it rows and the sum of the labels."""
    known, n, total = None, 0, 0.0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not np.isfinite(columns[0]).all():
            raise ValueError("labels must not be null, NaN or infinite")
        n, total = n + batch.num_rows, total + float(columns[0].sum())
        known = known or [np.empty(0)] * (len(columns) - 1)
        for i, c in enumerate(columns[1:]):
            if not np.isfinite(c).all():
                raise ValueError("predictors must not be infinite")
            if known[i] is not None:
                known[i] = np.union1d(known[i], c)
                known[i] = known[i] if len(known[i]) <= BINS else None
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(known)), pa.int32()), pa.array([n] * len(known), pa.int64()), pa.array([total] * len(known)),
             pa.array([None if v is None else v.tolist() for v in known], pa.list_(pa.float64()))], ["column", "n", "total", "seen"])


def _cuts(rows: DataFrame) -> tuple[list[np.ndarray], int, float]:
    """Cuts of each column, the number of rows and the mean label: midpoints of few values, else quantiles of all rows."""
    names = rows.columns[1:]
    found = rows.mapInArrow(_values, "column int, n bigint, total double, seen array<double>").collect()
    if not found:
        raise ValueError("a forest needs at least one row")
    cuts: list = []
    for i in range(len(names)):
        parts = [r["seen"] for r in found if r["column"] == i]
        seen = None if None in parts else np.unique(np.concatenate(parts))
        cuts.append(None if seen is None or len(seen) > BINS else (seen[:-1] + seen[1:]) / 2)
    many = [i for i, c in enumerate(cuts) if c is None]
    if many:
        steps = [i / BINS for i in range(1, BINS)]
        at = rows.agg(*[F.percentile_approx(names[i], steps, 10000).alias(f"q{i}") for i in many]).first()
        for i in many:
            cuts[i] = np.unique(at[f"q{i}"])
    first = [r for r in found if r["column"] == 0]
    n = sum(r["n"] for r in first)
    return cuts, n, sum(r["total"] for r in first) / n


def _coded(rows: DataFrame, cuts: list[np.ndarray], tasks: int) -> DataFrame:
    """Pieces of rows, dealt evenly: labels, and the bins of one column after the other."""
    def run(batches):
        for batch in batches:
            parts = -(-batch.num_rows // PIECE)
            for low, high in ((i * batch.num_rows // parts, (i + 1) * batch.num_rows // parts) for i in range(parts)):
                part = batch.slice(low, high - low)
                codes = np.stack([np.searchsorted(c, x.to_numpy(zero_copy_only=False)) for c, x in zip(cuts, part.columns[1:])])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays([0, high - low], part.column(0)), pa.array([codes.astype(np.uint8).tobytes()])],
                    ["label", "codes"])

    return rows.mapInArrow(run, "label array<double>, codes binary").repartition(tasks)


def _joined(batches, width: int):
    """Pieces of a task put together to blocks: labels and bins, a line a column."""
    labels, codes = [], []
    for batch in batches:
        for y, x in zip(batch.column(0), batch.column(1)):
            labels.append(y.values)
            codes.append(np.frombuffer(x.as_py(), np.uint8).reshape(width, -1))
            if sum(map(len, labels)) > BLOCK - PIECE:
                yield pa.concat_arrays(labels), np.concatenate(codes, axis=1)
                labels, codes = [], []
    if labels:
        yield pa.concat_arrays(labels), np.concatenate(codes, axis=1)


def _blocks(pieces: DataFrame, width: int, mean: float) -> DataFrame:
    """Numbered blocks, labels less their mean."""
    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for number, (labels, codes) in enumerate(_joined(batches, width), part):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([(labels.to_numpy() - mean).tobytes()]), pa.array([codes.tobytes()])],
                ["block", "label", "codes"])

    return pieces.mapInArrow(run, "block bigint, label binary, codes binary")


# ---------------------------------------------------------------- levels

def _sums(shared, sizes: np.ndarray, seed: int):
    """For each tree the sums of weights and of weighted labels in the cells of its level, one line a task."""
    def run(batches):
        blocks = [(i, np.frombuffer(y, np.float64), np.frombuffer(x, np.uint8))
                  for b in batches for i, y, x in zip(*(b.column(c).to_pylist() for c in range(3)))]
        for number, (tree, slots) in (shared.value.items() if blocks else ()):
            level = _Level(sizes, slots)
            nodes, width = len(tree.child), level.slots.shape[1]
            columns, starts = np.zeros((width, nodes), np.int64), np.full((width, nodes), level.cells)  # rows of leaves go behind the cells
            columns[:, tree.live], starts[:, tree.live] = level.slots.T, level.starts.T
            size = level.cells + BINS
            counts, totals = np.zeros(size), np.zeros(size)
            for block, labels, flat in blocks:
                n = len(labels)
                weights = draws(seed, number, block, n)
                rows = np.flatnonzero(weights != 0)
                weights = weights.take(rows).astype(np.float64)
                labels = labels.take(rows)
                labels *= weights
                node = tree.find(flat, n, rows)
                for places, first in zip(columns * n, starts):
                    at = places.take(node)
                    at += rows
                    bins = flat.take(at)
                    at = first.take(node)
                    at += bins
                    counts += np.bincount(at, weights, size)
                    totals += np.bincount(at, labels, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), *(pa.array([a[:level.cells].tobytes()]) for a in (counts, totals))], ["tree", "n", "s"])
    return run


def best(level: _Level, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """A line a node: column (-1: no split), cut, gain, rows and sum of the node, rows and sum of its lower part."""
    nodes, width = level.slots.shape
    n, s = np.zeros((nodes * width, BINS)), np.zeros((nodes * width, BINS))
    places = level.places()
    n[places], s[places] = counts, totals
    n, s = (np.cumsum(a, axis=1).reshape(nodes, width, BINS) for a in (n, s))
    rows, total = n[:, :, -1:], s[:, :, -1:]
    low_n, low_s = n[:, :, :-1], s[:, :, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = low_s ** 2 / low_n + (total - low_s) ** 2 / (rows - low_n)
        gain = parts - total ** 2 / rows
        gain = np.where((low_n > 0) & (low_n < rows) & (gain > NOISE * parts), gain, 0.0).reshape(nodes, -1)
    at, each = gain.argmax(axis=1), np.arange(nodes)
    top = gain[each, at]
    slot, step = at // (BINS - 1), at % (BINS - 1)
    return np.column_stack([np.where(top > 0, level.slots[each, slot], -1), step, top, rows[:, 0, 0], total[:, 0, 0],
                            low_n[each, slot, step], low_s[each, slot, step]])


def _splits(shared, sizes: np.ndarray):
    """Adds up the lines of each tree as they come, then looks for its splits."""
    def run(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for number, *parts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                parts = [np.frombuffer(p, np.float64) for p in parts]
                if number in sums:
                    for a, p in zip(sums[number], parts):
                        a += p
                else:
                    sums[number] = [p.copy() for p in parts]
        for number, (counts, totals) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([best(_Level(sizes, shared.value[number][1]), counts, totals).tobytes()])], ["tree", "found"])
    return run


def _split(tree: Tree, found: np.ndarray, mean: float) -> None:
    """Gives the live nodes of a tree the children that were found for them."""
    if len(tree.child) == 1:
        tree.value = mean + found[:1, 4] / np.maximum(found[:1, 3], 1)
    cleft = found[:, 0] >= 0
    at, found = tree.live[cleft], found[cleft]
    first, made = len(tree.child), 2 * len(at)
    tree.feature = np.append(tree.feature, np.zeros(made, np.int32))
    tree.cut = np.append(tree.cut, np.full(made, BINS, np.uint8))
    tree.child = np.append(tree.child, first + np.arange(made, dtype=np.int32))
    n = np.column_stack([found[:, 5], found[:, 3] - found[:, 5]]).ravel()
    s = np.column_stack([found[:, 6], found[:, 4] - found[:, 6]]).ravel()
    tree.value = np.append(tree.value, mean + s / n)
    tree.feature[at], tree.cut[at], tree.child[at] = found[:, 0], found[:, 1], first + np.arange(0, made, 2)
    np.add.at(tree.gains, found[:, 0].astype(int), found[:, 2])
    tree.live = (first + np.flatnonzero(n > 1)).astype(np.int32)
    tree.depth += bool(made)


class Forest:
    """Fitted trees and the cuts of the columns."""

    def __init__(self, trees: list[Tree], cuts: list[np.ndarray], tasks: int):
        self.trees, self.cuts, self.tasks = trees, cuts, tasks

    def importances(self) -> np.ndarray:
        """Gains by column, each tree's as shares, then those of all trees as shares."""
        shares = sum((t.gains / t.gains.sum() for t in self.trees if t.gains.any()), np.zeros(len(self.cuts)))
        return shares / shares.sum() if shares.any() else shares

    def predict(self, rows: DataFrame) -> DataFrame:
        """``label`` and the mean ``prediction`` of the trees; rows are the label, then the columns."""
        trees, width = rows.sparkSession.sparkContext.broadcast(self.trees), len(self.cuts)

        def run(batches):
            for labels, codes in _joined(batches, width):
                flat, n = codes.ravel(), len(labels)
                total, each = np.zeros(n), np.arange(n)
                for tree in trees.value:
                    total += tree.value.take(tree.find(flat, n, each))
                yield pa.RecordBatch.from_arrays([labels, pa.array(total / len(trees.value))], ["label", "prediction"])

        return _coded(rows, self.cuts, self.tasks).mapInArrow(run, "label double, prediction double")


def fit(rows: DataFrame, trees: int, depth: int, seed: int) -> Forest:
    """Rows are the label, then the columns, all double and without nulls; a node sees a third of the columns."""
    spark, width = rows.sparkSession, len(rows.columns) - 1
    cuts, n, mean = _cuts(rows)
    cores = spark.sparkContext.defaultParallelism
    tasks = min(cores * -(-n // (cores * SHARE)), -(-n // BLOCK))  # as many for each core
    kept = fresh_path(spark, "forest")  # stored, so that a block has the same rows and draws in all passes
    _blocks(_coded(rows, cuts, tasks), width, mean).write.parquet(kept)
    blocks = spark.read.schema("block bigint, label binary, codes binary").parquet(kept)
    sizes, third = np.array([len(c) + 1 for c in cuts]), -(-width // 3)
    grown = [Tree(gains=np.zeros(width)) for _ in range(trees)]
    for height in range(depth):
        live = {}
        for i, tree in enumerate(grown):
            if len(tree.live):
                order = np.random.default_rng([seed & 0xFFFFFFFF, i, height]).random((len(tree.live), width)).argsort(axis=1)
                live[i] = replace(tree, value=None, gains=None), order[:, :third].astype(np.int32)
        if not live:
            break
        shared = spark.sparkContext.broadcast(live)
        sums = blocks.mapInArrow(_sums(shared, sizes, seed), "tree int, n binary, s binary")
        for r in sums.repartition(min(tasks, trees), "tree").mapInArrow(_splits(shared, sizes), "tree int, found binary").collect():
            _split(grown[r["tree"]], np.frombuffer(r["found"], np.float64).reshape(-1, 7), mean)
        shared.destroy()
    return Forest(grown, cuts, tasks)
