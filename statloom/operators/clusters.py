"""K-means for many models at once: every round is one aggregation over all sets of points, starts and numbers of clusters.

A model is a set of points, a k and the centres it starts from.  One pass assigns each point to a centre in every model
of its set and adds up sizes and sums inside the tasks; what reaches the driver is as large as the models.  Set 0 is the table.
The other sets are uniform points over the ranges of its columns, made anew in each pass from the seed, so they are never stored;
those of large sets are made part by part of the box, so that a task has neighbouring ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256  # points assigned together
MADE = 8192  # uniform points that one seed makes
HELD = 128 * MADE  # points of one set that a task sorts into cells together
SPREAD = 16 * MADE  # as few points are not sorted
CELL = 1024  # points of a cell, about
LEEWAY = 1e-6  # a centre this close to taking part in a cell does, so rounding never leaves one out
SAMPLE = 2000  # distinct rows that starting centres are drawn from


@dataclass
class Model:
    """A start and, after the rounds, the partition it led to."""

    points: int
    k: int
    centres: np.ndarray
    sizes: np.ndarray | None = None
    squares: np.ndarray | None = None
    wss: float = math.inf
    rounds: int = 0


@dataclass
class Box:
    """Ranges of the columns, their middle (taken off before squaring) and the number of rows."""

    names: list[str]
    low: np.ndarray
    high: np.ndarray
    middle: np.ndarray
    n: int


def numeric_rows(df: DataFrame, cols: dict[str, Column]) -> tuple[DataFrame, Box]:
    """The complete rows as doubles ``x0``, ``x1``, ..., persisted, and their ranges."""
    names = [f"x{i}" for i in range(len(cols))]
    rows = df.select(*[c.cast("double").alias(x) for x, c in zip(names, cols.values())]).dropna()
    tasks = df.sparkSession.sparkContext.defaultParallelism
    rows = (rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows).persist()
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{t}{x}") for x in names for t, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))]).first()
    low, high, middle = (np.array([one[f"{t}{x}"] or 0.0 for x in names]) for t in ("lo", "hi", "m"))
    return rows, Box(list(cols), low, high, middle, int(one["n"]))


def row_starts(rows: DataFrame, box: Box, ks: list[int], starts: int, seed: int) -> list[Model]:
    """Starts at distinct rows: each draws k of the ``SAMPLE`` distinct rows with the smallest seeded hashes."""
    names = rows.columns
    some = rows.distinct().orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(max(SAMPLE, max(ks))).toArrow()
    found = np.column_stack([some.column(x).to_numpy() for x in names]) - box.middle
    rng = np.random.Generator(np.random.Philox(seed))
    out = []
    for k in ks:
        for _ in range(starts):
            pick = rng.permutation(len(found))[:k]
            out.append(Model(0, len(pick), found[pick]))
    return out


def box_starts(box: Box, sets: int, ks: list[int], starts: int, seed: int) -> list[Model]:
    """Starts at uniform points for the uniform sets 1, 2, ..., ``sets``."""
    rng = np.random.Generator(np.random.Philox([seed, 1]))
    wide = box.high - box.low
    return [Model(b, k, box.low + rng.random((k, len(wide))) * wide - box.middle) for b in range(1, sets + 1) for k in ks for _ in range(starts)]


def _region(box: Box, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of the box that a piece of a large uniform set lies in: halved time and again, so all are equally large and
    neighbouring pieces lie together."""
    low, high = np.zeros(len(box.low)), np.ones(len(box.low))
    first, pieces = 0, -(-box.n // MADE)
    while pieces > 1:
        side, half = int((high - low).argmax()), pieces // 2
        at = low[side] + (high[side] - low[side]) * half / pieces
        if piece < first + half:
            high[side], pieces = at, half
        else:
            low[side], first, pieces = at, first + half, pieces - half
    wide = box.high - box.low
    return box.low + low * wide, box.low + high * wide


@lru_cache(maxsize=64)
def _piece_sizes(n: int, points: int, seed: int) -> np.ndarray:
    """How many of n uniform points lie in each of as many equal parts as there are pieces."""
    pieces = -(-n // MADE)
    return np.random.Generator(np.random.Philox(key=[seed, points << 40 | 1 << 39])).multinomial(n, np.full(pieces, 1 / pieces))


def uniform_points(box: Box, points: int, piece: int, seed: int) -> np.ndarray:
    """A piece of one uniform set, ``MADE`` points or so; the same ones whenever and wherever they are made.

    A piece of a large set lies in its own part of the box: how many of the set's points do is drawn first.
    """
    rng = np.random.Generator(np.random.Philox(key=[seed, (points << 40) + piece]))
    if box.n <= SPREAD:
        low, high, size = box.low, box.high, min(MADE, box.n - piece * MADE)
    else:
        (low, high), size = _region(box, piece), int(_piece_sizes(box.n, points, seed)[piece])
    return low + rng.random((size, len(low))) * (high - low) - box.middle


def _cells(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points sorted by the cell of a grid over their ranges, and the edges of the cells that have points."""
    low, high = points.min(0), points.max(0)
    side = max(1, int((len(points) / CELL) ** (1 / points.shape[1])))
    cell = np.zeros(len(points), np.int64)
    for c in range(points.shape[1]):
        wide = (high[c] - low[c]) or 1.0
        cell = cell * side + np.minimum(((points[:, c] - low[c]) / wide * side).astype(np.int64), side - 1)
    cell = np.unique(cell, return_inverse=True)[1].ravel() if side ** points.shape[1] > 65536 else cell
    order = np.argsort(cell.astype(np.uint16 if cell.max() < 65536 else np.int64), kind="stable")
    return points.take(order, axis=0), np.append(np.flatnonzero(np.diff(cell.take(order), prepend=-1)), len(points))


def _shares(far: np.ndarray, values: np.ndarray, kind) -> np.ndarray:
    """Sums of the values of the points that are nearest to each centre; ``far`` is by model, centre and point."""
    nearest = far == far.min(axis=1, keepdims=True)
    found = nearest.reshape(-1, far.shape[2]).astype(kind) @ values
    if found[:, 0].sum() > far.shape[0] * far.shape[2]:  # equally near centres: the first one counts
        nearest[:] = False
        np.put_along_axis(nearest, far.argmin(axis=1)[:, None], True, axis=1)
        found = nearest.reshape(-1, far.shape[2]).astype(kind) @ values
    return found


class _Sums:
    """Sizes, sums and squared lengths of the clusters of one set's models, grouped by k.

    With ``exact`` false, for sets that are random anyway, distances are taken in single precision, and the squared length of
    all points stands in each model's first cluster.
    """

    def __init__(self, models: list[tuple[int, np.ndarray]], exact: bool):
        self.kind, self.exact, self.groups = np.float64 if exact else np.float32, exact, []
        by_k: dict = {}
        for number, centres in models:
            by_k.setdefault(len(centres), []).append((number, centres))
        for k, members in sorted(by_k.items()):
            centres = np.concatenate([c for _, c in members])
            sides = np.column_stack([-2 * centres, (centres * centres).sum(1)]).astype(self.kind)
            self.groups.append((k, [n for n, _ in members], sides, np.zeros((len(centres), centres.shape[1] + 2))))

    def add(self, points: np.ndarray) -> None:
        for low in range(0, len(points), CHUNK):
            part = points[low:low + CHUNK]
            square = (part * part).sum(1)
            values = np.column_stack([np.ones(len(part)), part, square]).astype(self.kind)
            ahead = np.vstack([part.T, np.ones(len(part))]).astype(self.kind)
            for k, numbers, sides, sums in self.groups:
                far = (sides @ ahead).reshape(len(numbers), k, len(part))
                found = _shares(far, values, self.kind)
                if not self.exact:
                    found[:, -1] = 0
                    sums[::k, -1] += square.sum()
                sums += found

    def add_many(self, points: np.ndarray, edges: np.ndarray | None = None) -> None:
        """Like ``add``, by cells of neighbouring points: a centre takes part in a cell only if it can be the nearest for a point of
        the cell's box, and a cell that one centre has whole is added as its sums.  ``edges`` are those of cells that the points
        already lie in."""
        if edges is None and len(points) < SPREAD:
            return self.add(points)
        if edges is None:
            points, edges = _cells(points)
        values = np.column_stack([np.ones(len(points)), points, (points * points).sum(1)])
        whole = np.add.reduceat(values, edges[:-1])
        low, high = np.minimum.reduceat(points, edges[:-1]), np.maximum.reduceat(points, edges[:-1])
        middle, half = (low + high) / 2, (high - low) / 2
        alive, counts, single = [], [], []
        for k, numbers, sides, _ in self.groups:
            centres = sides[:, :-1].astype(np.float64).reshape(len(numbers), k, -1) / -2
            near = ((centres * centres).sum(2)[None] - 2 * (middle @ centres.reshape(len(numbers) * k, -1).T).reshape(len(middle), len(numbers), k))
            first = near.argmin(2)
            own = centres[np.arange(len(numbers)), first]
            near -= near.min(2, keepdims=True)
            near -= LEEWAY * (np.abs(centres).max() + np.abs(middle).max() + 1) ** 2
            for c in range(half.shape[1]):
                near -= 2 * np.abs(centres[None, :, :, c] - own[:, :, None, c]) * half[:, c, None, None]
            can = near <= 0
            alive.append(can.reshape(len(middle), -1))
            counts.append(can.sum(2))
            single.append((can & (counts[-1] == 1)[:, :, None]).reshape(len(middle), -1).T.astype(np.float64) @ whole)
        alive, sums = np.concatenate(alive, axis=1), np.concatenate(single)
        counts = np.concatenate([np.repeat(n, k, axis=1) for (k, *_), n in zip(self.groups, counts)], axis=1)  # for each centre
        sides = np.concatenate([g[2] for g in self.groups])
        ahead = np.vstack([points.T, np.ones(len(points))]).astype(self.kind)
        values = values.astype(self.kind)
        for cell, (start, end) in enumerate(zip(edges[:-1], edges[1:])):
            here, line = alive[cell], values[start:end]
            for c in np.unique(counts[cell][here]):
                if c == 1:
                    continue
                at = np.flatnonzero(here & (counts[cell] == c)).reshape(-1, c)
                if c == 2:
                    second = (sides[at[:, 1]] - sides[at[:, 0]]) @ ahead[:, start:end] < 0
                    found = second.astype(self.kind) @ line
                    sums[at[:, 1]] += found
                    sums[at[:, 0]] += whole[cell] - found
                else:
                    far = (sides[at.ravel()] @ ahead[:, start:end]).reshape(len(at), c, end - start)
                    sums[at.ravel()] += _shares(far, line, self.kind)
        low = 0
        for k, _, own, into in self.groups:
            part = sums[low:low + len(own)]
            if not self.exact:
                part[:, -1] = 0
                part[::k, -1] += whole[:, -1].sum()
            into += part
            low += len(own)

    def lines(self):
        for k, numbers, _, sums in self.groups:
            yield np.repeat(numbers, k), np.tile(np.arange(k), len(numbers)), sums


def _batch(kept: list[_Sums], width: int):
    lines = [line for sums in kept for line in sums.lines()]
    if lines:
        model, cluster, sums = (np.concatenate(x) for x in zip(*lines))
        columns = [pa.array(model, pa.int32()), pa.array(cluster, pa.int32())] + [pa.array(np.ascontiguousarray(sums[:, c])) for c in range(width + 2)]
        yield pa.RecordBatch.from_arrays(columns, ["model", "cluster", *[f"s{c}" for c in range(width + 2)]])


def _of_rows(shared, middle: np.ndarray):
    def run(batches):
        sums = _Sums(shared.value[0], True)
        held, n = [], 0
        for batch in batches:
            held.append(np.column_stack([np.asarray(c, np.float64) for c in batch.columns]) - middle)
            n += batch.num_rows
            if n >= HELD:
                sums.add_many(np.concatenate(held))
                held, n = [], 0
        for points in [np.concatenate(held)] if n >= SPREAD else held:
            sums.add_many(points)
        yield from _batch([sums], len(middle))
    return run


def _of_box(shared, box: Box, pieces: int, seed: int):
    def run(batches):
        kept: dict = {}
        held: list = []

        def put(points):
            if held:
                if box.n > SPREAD:  # a piece is a cell
                    parts = [p for i in held if len(p := uniform_points(box, points, i, seed))]
                    if parts:
                        kept[points].add_many(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
                elif len(held) * MADE < SPREAD:
                    for i in held:
                        kept[points].add(uniform_points(box, points, i, seed))
                else:
                    kept[points].add_many(np.concatenate([uniform_points(box, points, i, seed) for i in held]))
                held.clear()

        last = None
        for batch in batches:
            for i in batch.column(0).to_pylist():
                points = i // pieces + 1
                models = shared.value.get(points)
                if models:
                    if points != last or len(held) * MADE >= HELD:
                        put(last)
                        last = points
                    if points not in kept:
                        kept[points] = _Sums(models, False)
                    held.append(i % pieces)
        put(last)
        yield from _batch(list(kept.values()), len(box.low))
    return run


def _round(rows: DataFrame, box: Box, models: list[Model], live: list[int], seed: int) -> dict:
    """Sizes, sums and squared lengths of the clusters of the live models: model number to a matrix with a line a cluster."""
    spark, width = rows.sparkSession, len(box.low)
    by_set: dict = {}
    for number in live:
        by_set.setdefault(models[number].points, []).append((number, models[number].centres))
    shared = spark.sparkContext.broadcast(by_set)
    schema = "model int, cluster int, " + ", ".join(f"s{c} double" for c in range(width + 2))
    parts = []
    if 0 in by_set:
        parts.append(rows.mapInArrow(_of_rows(shared, box.middle), schema))
    sets = max(by_set)
    if sets:
        pieces = -(-box.n // MADE)
        tasks = min(sets * pieces, max(spark.sparkContext.defaultParallelism, sets * pieces * MADE // HELD))
        parts.append(spark.range(0, sets * pieces, 1, tasks).mapInArrow(_of_box(shared, box, pieces, seed), schema))
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = lines.groupBy("model", "cluster").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(width + 2)]).toArrow()
    shared.unpersist()
    table = np.column_stack([found.column(c).to_numpy() for c in range(width + 4)])
    out = {number: np.zeros((models[number].k, width + 2)) for number in live}
    numbers, clusters = table[:, 0].astype(int), table[:, 1].astype(int)
    order = np.lexsort((clusters, numbers))
    edges = np.searchsorted(numbers[order], live + [np.iinfo(np.int64).max])
    for i, number in enumerate(live):
        own = order[edges[i]:edges[i + 1]]
        out[number][clusters[own]] = table[own, 2:]
    return out


def lloyd(rows: DataFrame, box: Box, models: list[Model], max_iter: int = 20, tol: float = 1e-4, seed: int = 1) -> list[Model]:
    """Rounds until no centre of a model moves by more than ``tol``, each model at its own pace; ties go to the earlier centre.

    A cluster without points keeps its centre.  ``wss`` is the sum of squares of the last partition around its means.
    """
    live = list(range(len(models))) if box.n else []
    for step in range(1, max_iter + 1):
        if not live:
            break
        found = _round(rows, box, models, live, seed)
        going = []
        for number in live:
            model, sums = models[number], found[number]
            filled = sums[:, 0] > 0
            moved = model.centres.copy()
            moved[filled] = sums[filled, 1:-1] / sums[filled, :1]
            far = ((moved - model.centres) ** 2).sum(1).max()
            model.centres, model.sizes, model.squares, model.rounds = moved, sums[:, 0].astype(np.int64), sums[:, -1], step
            model.wss = float(max(sums[:, -1].sum() - ((sums[filled, 1:-1] ** 2).sum(1) / sums[filled, 0]).sum(), 0.0))
            if far > tol * tol:
                going.append(number)
        live = going
    return models


def best_of(models: list[Model]) -> dict[tuple[int, int], Model]:
    """The model with the smallest sum of squares for each set and k; the first of equal ones."""
    out: dict = {}
    for m in models:
        key = m.points, m.k
        if key not in out or m.wss < out[key].wss:
            out[key] = m
    return out


def _silhouettes(shared, middle: np.ndarray):
    def run(batches):
        models = shared.value
        sums = np.zeros(len(models))
        for batch in batches:
            every = np.column_stack([np.asarray(c, np.float64) for c in batch.columns]) - middle
            for low in range(0, len(every), CHUNK):
                points = every[low:low + CHUNK]
                square = (points * points).sum(1)
                for number, (centres, sizes, means, squares) in enumerate(models):
                    label = ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)
                    n = np.maximum(sizes, 1)
                    gap = square[:, None] + squares / n - 2 * points @ means.T
                    at = np.arange(len(points))
                    own = gap[at, label] * n[label] / np.maximum(n[label] - 1, 1)
                    gap[:, sizes == 0] = np.inf
                    gap[at, label] = np.inf
                    other = gap.min(1)
                    # distances to other clusters are missing where one cluster has all points
                    size = np.maximum(np.maximum(own, other), 1e-300)
                    sums[number] += np.where((sizes[label] > 1) & np.isfinite(other), (other - own) / size, 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(sums)], ["model", "s"])
    return run


def silhouettes(rows: DataFrame, box: Box, models: list[Model]) -> list[float]:
    """Average silhouette by squared distances of every model's assignment to its centres: two passes for all models."""
    again = [Model(0, m.k, m.centres) for m in models]
    found = _round(rows, box, again, list(range(len(again))), 0)
    told = []
    for number, model in enumerate(again):
        sums = found[number]
        told.append((model.centres, sums[:, 0], sums[:, 1:-1] / np.maximum(sums[:, :1], 1), sums[:, -1]))
    shared = rows.sparkSession.sparkContext.broadcast(told)
    out = rows.mapInArrow(_silhouettes(shared, box.middle), "model int, s double").groupBy("model").agg(F.sum("s").alias("s")).collect()
    return [r["s"] / box.n for r in sorted(out, key=lambda r: r["model"])]


def total_squares(box: Box, rows: DataFrame) -> float:
    """Sum of squares around the mean over all columns: the cost of one cluster."""
    one = rows.agg(*[(F.var_pop(x) * F.count(x)).alias(x) for x in rows.columns]).first()
    return float(sum(v or 0.0 for v in one))


def kmeans(df: DataFrame, cols: dict[str, Column], ks: list[int], starts: int = 30, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """(k, cluster, size, centre, wss) of the best of several starts for each k; clusters by size, largest first.

    With fewer distinct rows than k there are as many clusters as distinct rows.
    """
    rows, box = numeric_rows(df, cols)
    models = lloyd(rows, box, row_starts(rows, box, ks, starts, seed), max_iter, seed=seed) if box.n else []
    rows.unpersist()
    lines = []
    for i, k in enumerate(ks if box.n else []):
        best = min(models[i * starts:(i + 1) * starts], key=lambda m: m.wss)
        order = np.lexsort((best.centres[:, 0], -best.sizes))
        lines += [(k, c, int(best.sizes[j]), (best.centres[j] + box.middle).tolist(), best.wss) for c, j in enumerate(order)]
    return df.sparkSession.createDataFrame(lines, "k int, cluster int, size bigint, centre array<double>, wss double")


def kmeans_wss(df: DataFrame, cols: dict[str, Column], max_k: int = 10, starts: int = 1, seed: int = 1) -> DataFrame:
    """Within-cluster sum of squares for k = 1..max_k."""
    rows, box = numeric_rows(df, cols)
    lines = [(1, total_squares(box, rows))]
    if max_k > 1 and box.n:
        models = lloyd(rows, box, row_starts(rows, box, list(range(2, max_k + 1)), starts, seed), seed=seed)
        lines += [(k + 2, min(m.wss for m in models[k * starts:(k + 1) * starts])) for k in range(max_k - 1)]
    rows.unpersist()
    return df.sparkSession.createDataFrame(lines, "k int, wss double")


def kmeans_silhouette(df: DataFrame, cols: dict[str, Column], max_k: int = 10, starts: int = 1, seed: int = 1) -> DataFrame:
    """Average silhouette (squared distances) for k = 2..max_k."""
    rows, box = numeric_rows(df, cols)
    lines = []
    if box.n:
        models = lloyd(rows, box, row_starts(rows, box, list(range(2, max_k + 1)), starts, seed), seed=seed)
        best = [min(models[k * starts:(k + 1) * starts], key=lambda m: m.wss) for k in range(max_k - 1)]
        lines = [(k + 2, s) for k, s in enumerate(silhouettes(rows, box, best))]
    rows.unpersist()
    return df.sparkSession.createDataFrame(lines, "k int, silhouette double")


def kmeans_gap(df: DataFrame, cols: dict[str, Column], max_k: int = 10, references: int = 50, starts: int = 25, seed: int = 1,
               max_iter: int = 10) -> DataFrame:
    """Gap statistic against uniform reference sets of the same size over the column ranges, best of ``starts`` for every k and set.

    ``se`` is the standard deviation over the reference sets times sqrt(1 + 1 / references).
    """
    rows, box = numeric_rows(df, cols)
    ks = list(range(2, max_k + 1))
    models = row_starts(rows, box, ks, starts, seed) + box_starts(box, references, ks, starts, seed)
    # one cluster of a uniform set needs its mean only: a start with one centre ends after two rounds
    models += [Model(b, 1, np.zeros((1, len(box.low)))) for b in range(1, references + 1)]
    best = best_of(lloyd(rows, box, models, max_iter, seed=seed))
    own = [total_squares(box, rows)] + [best[0, k].wss if (0, k) in best else 0.0 for k in ks]
    rows.unpersist()

    def log(v):
        return math.log(v) if v > 0 else -math.inf

    lines = []
    for k in range(1, max_k + 1):
        refs = np.array([log(best[b, k].wss) for b in range(1, references + 1)])
        mean, sd = float(refs.mean()), float(refs.std(ddof=1)) if references > 1 else 0.0
        lines.append((k, log(own[k - 1]), mean, mean - log(own[k - 1]), sd * math.sqrt(1 + 1 / references)))
    return df.sparkSession.createDataFrame(lines, "k int, log_w double, e_log_w double, gap double, se double")
