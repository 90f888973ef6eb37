"""Hard negatives by a secondary sort: candidates come to an anchor's reader by falling score, positives open windows.

Each task scores its rows against a block of anchors and sends what can matter: the best positives first, then, when
the windows they open are known, the best negatives of each window.  The keys (anchor, falling score, id) are dealt by anchor and sorted
inside the partitions, and a reader that goes through them once holds no more than the open windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.store import keep, settled

BLOCK = 4096  # anchors that one pass answers
ROWS = 2048  # rows scored at a time
ANCHORS = 512  # anchors scored at a time
LIMIT = 2**62 - 1  # scores beyond are held at this size
ABSENT = 2**63 - 1  # stands for a null id, which comes last among ties

# anchor, order (-2 * score, +1 for a negative), id, whether the id is null
KEYS = "anchor long, descending long, id long, unnamed boolean"


def _matrix(column) -> np.ndarray:
    """Vectors as whole numbers floor(256 x) held in doubles; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(column), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256 * out))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two matrices of whole numbers; vectors of other lengths end in zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = (np.abs(a).max(initial=0) * width) * np.abs(b).max(initial=0)
    if largest < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a).dot(whole(b).T), -LIMIT, LIMIT).astype(np.int64)


def _number(batches):
    """Numbers the rows of a partition; the table is stored before the numbers are used."""
    first = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(batch))), *batch.columns], ["row", *batch.schema.names])
        first += len(batch)


def _tiles(batches, shared):
    """Scores of some anchors against some rows, with what names both."""
    rows, labels, vectors, windows = shared.value
    for batch in batches:
        for low in range(0, len(batch), ROWS):
            part = batch.slice(low, ROWS)
            number, label = np.asarray(part.column(0), np.int64), np.asarray(part.column(2), np.int64)
            unnamed = part.column(1).is_null().to_numpy(zero_copy_only=False)
            ids = part.column(1).fill_null(ABSENT).to_numpy(zero_copy_only=False)
            matrix = _matrix(part.column(3))
            order = np.lexsort((unnamed, ids))
            number, label, unnamed, ids, matrix = number[order], label[order], unnamed[order], ids[order], matrix[order]
            for at in range(0, len(rows), ANCHORS):
                block = slice(at, at + ANCHORS)
                yield rows[block], labels[block], windows[block] if windows else None, _scores(vectors[block], matrix), number, label, ids, unnamed


def _first(scores: np.ndarray, count: int) -> np.ndarray:
    """The places of the ``count`` largest scores, ties to the earlier place."""
    if len(scores) > count:
        bar = np.partition(scores, len(scores) - count)[len(scores) - count]
        above, ties = np.flatnonzero(scores > bar), np.flatnonzero(scores == bar)
        return np.concatenate([above, ties[:count - len(above)]])
    return np.arange(len(scores))


class _Best:
    """The best candidates of each key so far."""

    def __init__(self, count: int):
        self.count, self.found = count, {}

    def add(self, key, *rows) -> None:
        """Rows are given as scores, ids, marks of null ids and row numbers, by id."""
        if not len(rows[0]):
            return
        if key in self.found:
            rows = [np.concatenate(x) for x in zip(self.found[key], rows)]
            order = np.lexsort((rows[2], rows[1]))
            rows = [x[order] for x in rows]
        best = np.sort(_first(rows[0], self.count))
        self.found[key] = [x[best] for x in rows]


def _keys(best: dict, extra: int) -> pa.RecordBatch:
    anchors = [np.full(len(found[0]), key, np.int64) for key, found in best.items()]
    scores, ids, unnamed = (np.concatenate([found[i] for found in best.values()]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(-2 * scores + extra), pa.array(ids), pa.array(unnamed)],
                                      ["anchor", "descending", "id", "unnamed"])


def _positives(shared, count: int):
    def run(batches):
        best = _Best(count)
        for rows, labels, _, scores, number, label, ids, unnamed in _tiles(batches, shared):
            for i, row in enumerate(rows):
                own = np.flatnonzero((label == labels[i]) & (number != row))
                best.add(row, scores[i, own], ids[own], unnamed[own], number[own])
        if best.found:
            yield _keys(best.found, 0)
    return run


def _negatives(shared, count: int):
    def run(batches):
        best = _Best(count)
        for rows, labels, windows, scores, number, label, ids, unnamed in _tiles(batches, shared):
            for i, row in enumerate(rows):
                other = label != labels[i]
                for low, high in windows[i]:
                    inside = np.flatnonzero(other & (scores[i] >= low) & (scores[i] <= high))
                    best.add((row, low, high), scores[i, inside], ids[inside], unnamed[inside], number[inside])
        whole: dict = {}
        for (row, _, _), found in best.found.items():
            whole.setdefault(row, []).append(found)
        for row, parts in whole.items():  # a row in several windows of an anchor is sent once
            together = [np.concatenate(x) for x in zip(*parts)]
            _, once = np.unique(together[3], return_index=True)
            whole[row] = [x[once] for x in together]
        if whole:
            yield _keys(whole, 1)
    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest whole score s with low * score <= 100 * s <= high * score."""
    return max(-(-low * score // 100), -LIMIT), min(high * score // 100, LIMIT)


def _windows(positives: int, low: int, high: int):
    """The windows of each anchor's first positives, from sorted keys of positives."""
    def run(batches):
        anchor, met = None, 0
        for batch in batches:
            out = []
            for a, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                anchor, met = a, met + 1 if a == anchor else 1
                if met <= positives:
                    out.append((a, *window(-(key // 2), low, high)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "low", "high"])
    return run


def _read(shared, positives: int, negatives: int, low: int, high: int):
    """Goes once through sorted keys; state: the anchor, the positives met, and what each open window has given."""
    def run(batches):
        names = shared.value
        anchor, met, opened = None, 0, []
        for batch in batches:
            out = []
            for a, key, i, unnamed in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    anchor, met, opened = a, 0, []
                name = None if unnamed else i
                if key % 2 == 0:
                    if met < positives:
                        opened.append([*window(-(key // 2), low, high), name, -(key // 2), 0])
                        met += 1
                    continue
                score = (1 - key) // 2
                for w in opened:
                    if w[0] <= score <= w[1] and w[4] < negatives:
                        w[4] += 1
                        out.append((names[anchor], w[2], w[4], name, w[3], score))
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return run


def _sorted(keys: DataFrame) -> DataFrame:
    """Keys dealt by anchor, each partition in the order of (anchor, falling score, id)."""
    return keys.repartition("anchor").sortWithinPartitions("anchor", "descending", "id", "unnamed")


def usable(vectors: DataFrame, anchors: Column, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector, is_anchor) of rows with a label, a vector, and no null or non-finite component."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(label.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"))


@settled
def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` is a condition, ``label`` a column of whole numbers (default: ``label``).  Components count as
    floor(256 x), a score is the exact inner product, higher first, ties by smaller id.  For each of an anchor's first
    ``positives`` other rows of its label: the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Anchors go to the tasks in blocks of about ``block`` by the hash of their row number; each block's results are stored.
    A task keeps ``positives`` and then ``positives * negatives`` rows an anchor, so pairs are neither shuffled nor stored.

    Rows without label or vector, or with a null or non-finite component, take no part.  A vector shorter than another
    counts as ending in zeros.  Null ids come last among ties, are reported as null and are no anchors by a condition
    on the id; rows that repeat an id are rows of their own, also as anchors.  Scores beyond 2^62 are held there.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    rows = usable(vectors, anchors, label, id_col, vector_col)
    rows = keep(rows.mapInArrow(_number, "row long, id long, label long, vector array<double>, is_anchor boolean"), "vectors")
    wanted = rows.filter("is_anchor")
    blocks = -(-wanted.count() // block)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    results = [spark.createDataFrame([], schema)]
    for b in range(blocks):
        one = wanted.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "id", "label", "vector").toArrow()
        number, names = one.column("row").to_numpy(), dict(zip(one.column("row").to_pylist(), one.column("id").to_pylist()))
        if not len(number):
            continue
        known = number, one.column("label").to_numpy(), _matrix(one.column("vector"))
        shared = spark.sparkContext.broadcast((*known, None))
        plain = rows.select("row", "id", "label", "vector")
        found = keep(plain.mapInArrow(_positives(shared, positives), KEYS), "positives")
        windows: dict = {}
        for r in _sorted(found).mapInArrow(_windows(positives, low, high), "anchor long, low long, high long").collect():
            windows.setdefault(r["anchor"], set()).add((r["low"], r["high"]))
        shared = spark.sparkContext.broadcast((*known, [sorted(windows.get(n, ())) for n in number.tolist()]))
        keys = found.unionByName(plain.mapInArrow(_negatives(shared, negatives), KEYS))
        called = spark.sparkContext.broadcast(names)
        results.append(keep(_sorted(keys).mapInArrow(_read(called, positives, negatives, low, high), schema), "negatives"))
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out
