"""Normal mixtures with full covariances for many numbers of classes at once: a round of EM is one pass that serves them all.

Starts are those of pyspark.ml's ``GaussianMixture`` (beyond ``LIBRARY`` points with draws of our own, because the library reads the
table twice for each number of classes), and a round does its arithmetic: a class's density is bounded below by ``LEAST``, and
directions without spread are left out of it.  Points are stored as pieces, dealt evenly to tasks.  What reaches the driver is as
large as the models for each task.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 2048  # points weighed together
SHARE = 1 << 20  # points of a task, about
LIBRARY = 1 << 17  # points of a table whose starts the library draws
DRAWN = 5  # points that a class starts from
LEAST = 2.0 ** -52
FAINT = -90.0  # logarithm of a density that is nothing beside LEAST
CLOSE = 1e-10  # error of a log density that is allowed for
STEEP = 60.0  # logarithm of a density that the table of exponentials ends at

# exp(u / STEPS) is a table's entry for the integer next to u, times a cubic of the rest; adding ROUND leaves that integer in the last bits
STEPS = 256 / math.log(2)
ROUND = 1.5 * 2.0 ** 52
_FIRST = math.floor(FAINT * STEPS)
_TABLE = np.exp(np.arange(_FIRST, math.ceil((STEEP + 1) * STEPS)) / STEPS) / (6 * STEPS ** 3)
_TABLE[0] = 0.0
_BASE = int(np.array(ROUND).view(np.int64)) + _FIRST
_ROOT = -1.5960716379833215  # 6 + 6x + 3x^2 + x^3 = (x - _ROOT) ((x + _HALF)^2 + _REST)
_HALF = (3 + _ROOT) / 2
_REST = -6 / _ROOT - _HALF ** 2


def _exp(u: np.ndarray, whole: np.ndarray, out: np.ndarray) -> None:
    """exp(u / STEPS) to 13 digits, nothing below FAINT; overwrites ``u`` and ``whole``."""
    np.add(u, ROUND, out=whole)
    at = out.view(np.int64)
    np.subtract(whole.view(np.int64), _BASE, out=at)
    whole -= ROUND
    u -= whole
    np.take(_TABLE, at, out=whole, mode="clip")
    np.add(u, _HALF * STEPS, out=out)
    out *= out
    out += _REST * STEPS ** 2
    u -= _ROOT * STEPS
    out *= u
    out *= whole


@dataclass
class Mixture:
    """Weights, means and covariances of the classes; after the rounds, the likelihood that the last of them started from."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = -1.7976931348623157e308
    before: float = 0.0
    rounds: int = 0


def starts(ready: DataFrame, ks: list[int], seed: int) -> list[Mixture]:
    """What ``GaussianMixture`` starts from for each k, drawn side by side: its models after no iteration.  ``ready`` has arrays
    ``features``."""
    def start(k):
        model = GaussianMixture(k=k, seed=seed, maxIter=0).fit(ready)
        laws = model.gaussians
        return Mixture(np.array(model.weights), np.array([g.mean.toArray() for g in laws]), np.array([g.cov.toArray() for g in laws]))

    if not ks:
        return []
    with ThreadPoolExecutor(len(ks)) as pool:
        return list(pool.map(inheritable_thread_target(ready.sparkSession)(start), ks))


class _Classes:
    """The classes of several mixtures under one another, ready to weigh points."""

    def __init__(self, mixtures: list[Mixture]):
        self.sizes = [len(m.weights) for m in mixtures]
        self.edges = np.cumsum([0, *self.sizes[:-1]])  # where a mixture's classes begin
        self.weights = np.concatenate([m.weights for m in mixtures])
        roots, heights = [], []
        for cov in np.concatenate([m.covs for m in mixtures]):
            values, vectors = np.linalg.eigh(cov)
            kept = values > LEAST * values.max() * len(values)
            if not kept.any():
                raise ValueError("a class of the mixture has no spread in any direction")
            roots.append(np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0)[:, None] * vectors.T)
            heights.append(-0.5 * (len(values) * math.log(2 * math.pi) + np.log(values[kept]).sum()))
        means, roots = np.concatenate([m.means for m in mixtures]), np.array(roots)
        self.heights, self.width = np.array(heights)[:, None], means.shape[1]
        at = np.einsum("kij,kj->ki", roots, means)
        # one direction of all classes after the other
        self.roots = np.concatenate([np.column_stack([-at[:, c], roots[:, c]]) for c in range(self.width)])
        # logarithms of weighted densities as sums over the features of a point
        squares = np.einsum("kij,kil->kjl", roots, roots)
        first, second = np.triu_indices(self.width)
        with np.errstate(divide="ignore"):
            peaks = self.heights[:, 0] + np.log(self.weights)
        self.forms = np.column_stack([peaks - 0.5 * (at * at).sum(1), np.einsum("kij,ki->kj", roots, at),
                                      squares[:, first, second] * np.where(first == second, -0.5, -1.0)])
        self.sizable, self.steep = np.abs(self.forms), not peaks.max() < STEEP
        self.forms *= STEPS
        self.room: tuple = ()

    def _densities(self, features: np.ndarray) -> np.ndarray:
        n, k = features.shape[1], len(self.weights)
        if not self.room or self.room[0].shape[1] != n:
            self.room = np.empty((k, n)), np.empty((k, n)), np.empty((k, n))
        found, far, whole = self.room
        error = LEAST * (self.sizable @ np.abs(features).max(1)).max()
        if error < CLOSE and not self.steep:
            np.matmul(self.forms, features, out=far)
            _exp(far, whole, found)
            return found
        ahead = features[:1 + self.width]  # too steep for sums over features: by directions
        found[:] = 0
        for low in range(0, len(self.roots), k):
            np.matmul(self.roots[low:low + k], ahead, out=far)
            far *= far
            found += far
        found *= -0.5
        found += self.heights
        np.maximum(found, FAINT, out=found)
        np.exp(found, out=found)
        found *= self.weights[:, None]
        return found

    def posteriors(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of points, a column a point, to posterior probabilities (a line a class) and the densities they were divided
        by (a line a mixture).  The next call overwrites the former."""
        found = self._densities(features)
        found += LEAST
        parts = [found[low:low + size] for low, size in zip(self.edges, self.sizes)]
        total = np.array([part.sum(0) for part in parts])
        for part, share in zip(parts, 1 / total):
            part *= share
        return found, total


def _features(points: np.ndarray) -> np.ndarray:
    """Points as columns to their features: 1, the coordinates, and the products of two coordinates."""
    width, (first, second) = len(points), np.triu_indices(len(points))
    out = np.empty((1 + width + len(first), points.shape[1]))
    out[0], out[1:1 + width] = 1, points
    np.multiply(points[first], points[second], out=out[1 + width:])
    return out


def _chunks(batch: pa.RecordBatch, width: int):
    """The first ``width`` columns as lines, in parts of equal size."""
    points, parts = np.array([batch.column(i) for i in range(width)]).reshape(width, -1), -(-batch.num_rows // CHUNK)
    for i in range(parts):
        yield points[:, i * batch.num_rows // parts:(i + 1) * batch.num_rows // parts]


def pieces(rows: DataFrame, n: int) -> DataFrame:
    """The n rows as pieces of at most ``CHUNK`` points, one column after the other, dealt evenly to tasks."""
    width, cores = len(rows.columns), rows.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes() for part in _chunks(batch, width)])], ["points"])

    return rows.mapInArrow(run, "points binary").repartition(cores * max(1, -(-n // (cores * SHARE))))


def _stored(batches, width: int):
    """Features of the points of each piece."""
    for batch in batches:
        for piece in batch.column(0):
            yield _features(np.frombuffer(piece.as_buffer(), np.float64).reshape(width, -1))


def _moments(shared, width: int):
    def run(batches):
        numbers, classes = shared.value
        sums, logs = np.zeros(classes.forms.shape), np.zeros(len(numbers))
        for features in _stored(batches, width):
            found, total = classes.posteriors(features)
            sums += found @ features.T
            logs += np.log(total).sum(1)
        own = [np.repeat(numbers, classes.sizes), np.concatenate([np.arange(k) for k in classes.sizes])]
        lines = [*(pa.array(x, pa.int32()) for x in own), pa.array(np.repeat(logs, classes.sizes)), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)]
        yield pa.RecordBatch.from_arrays(lines, ["model", "class", "logs", *[f"s{c}" for c in range(sums.shape[1])]])
    return run


def drawn_starts(stored: DataFrame, width: int, ks: list[int], seed: int) -> list[Mixture]:
    """Starts by the library's rule for each k from two passes for all: a class has the mean and the variances of ``DRAWN`` points that
    are drawn with replacement."""
    sizes = {r["part"]: r["n"] for r in stored.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum(F.length("points") / (8 * width)).cast("bigint").alias("n")).collect()}
    parts = sorted(sizes)
    edges = np.cumsum([0, *(sizes[part] for part in parts)])
    picks = [np.random.Generator(np.random.Philox(key=[seed, k])).integers(0, edges[-1], DRAWN * k) for k in ks]
    wanted = np.unique(np.concatenate([[], *picks]).astype(np.int64))
    of = np.searchsorted(edges, wanted, side="right") - 1
    places = {part: wanted[of == i] - edges[i] for i, part in enumerate(parts)}
    bases = {part: int(edges[i]) for i, part in enumerate(parts)}

    def run(batches):
        part, low = TaskContext.get().partitionId(), 0
        for features in _stored(batches, width) if len(places.get(part, ())) else ():
            high = low + features.shape[1]
            at = places[part][(places[part] >= low) & (places[part] < high)]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at + bases[part]), *map(pa.array, features[1:1 + width][:, at - low])],
                                                 ["at", *[f"x{c}" for c in range(width)]])
            low = high

    found = stored.mapInArrow(run, "at bigint, " + ", ".join(f"x{c} double" for c in range(width))).toArrow().sort_by("at")
    points = np.column_stack([found.column(c + 1).to_numpy() for c in range(width)])
    out = []
    for k, pick in zip(ks, picks):
        drawn = points[np.searchsorted(wanted, pick)].reshape(k, DRAWN, width)
        out.append(Mixture(np.full(k, 1 / k), drawn.mean(1), np.array([np.diag(v) for v in drawn.var(1)])))
    return out


def fit_all(stored: DataFrame, width: int, mixtures: list[Mixture], max_iter: int = 100, tol: float = 1e-4) -> list[Mixture]:
    """Rounds of EM on ``pieces`` until the log-likelihood of a mixture changes by no more than ``tol``, each mixture at its own pace."""
    spark = stored.sparkSession
    pairs, names = np.triu_indices(width), [f"s{c}" for c in range(1 + width + width * (width + 1) // 2)]
    schema = "model int, class int, logs double, " + ", ".join(f"{c} double" for c in names)
    live = list(range(len(mixtures)))
    for _ in range(max_iter):
        live = [i for i in live if abs(mixtures[i].loglik - mixtures[i].before) > tol]
        if not live:
            break
        shared = spark.sparkContext.broadcast((live, _Classes([mixtures[i] for i in live])))
        found = stored.mapInArrow(_moments(shared, width), schema).toArrow()  # a line a class and task
        shared.unpersist()
        table = np.column_stack([found.column(c).to_numpy() for c in range(found.num_columns)])
        places, at = np.unique(table[:, :2], axis=0, return_inverse=True)
        sums = np.zeros((len(places), table.shape[1] - 2))
        np.add.at(sums, at.ravel(), table[:, 2:])
        table = np.column_stack([places, sums])
        for i in live:
            own, m = table[table[:, 0] == i], mixtures[i]
            n = own[:, 3]
            m.weights, m.means = n / n.sum(), own[:, 4:4 + width] / n[:, None]
            m.covs = np.empty((len(n), width, width))
            m.covs[:, pairs[0], pairs[1]] = m.covs[:, pairs[1], pairs[0]] = \
                own[:, 4 + width:] / n[:, None] - m.means[:, pairs[0]] * m.means[:, pairs[1]]
            m.before, m.loglik, m.rounds = m.loglik, float(own[0, 2]), m.rounds + 1
    return mixtures


def certainties(stored: DataFrame, width: int, mixtures: list[Mixture]) -> list[float]:
    """Sum over the points of the logarithm of the largest posterior probability, for each mixture: one pass."""
    if not mixtures:
        return []
    shared = stored.sparkSession.sparkContext.broadcast(_Classes(mixtures))

    def run(batches):
        classes = shared.value
        sums = np.zeros(len(classes.sizes))
        for features in _stored(batches, width):
            found, _ = classes.posteriors(features)
            sums += np.log(np.maximum.reduceat(found, classes.edges, axis=0)).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["model", "s"])

    found = stored.mapInArrow(run, "model int, s double").groupBy("model").agg(F.sum("s").alias("s")).collect()
    return [r["s"] for r in sorted(found, key=lambda r: r["model"])]


def labelled(rows: DataFrame, points: list[str], keep: list[str], mixture: Mixture, name: str) -> DataFrame:
    """``keep`` columns of the rows and the number of each row's likeliest class; the first of equally likely ones."""
    width, classes = len(points), _Classes([mixture])

    def run(batches):
        for batch in batches:
            label = [classes.posteriors(_features(part))[0].argmax(0) for part in _chunks(batch, width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[width:], pa.array(np.concatenate([[], *label]), pa.int32())], [*keep, name])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*points, *keep).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"{name} int"]))
