"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL, calibrated."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm import tokens
from statloom.llm.store import lean, release

SIZES = (1, 2, 3)  # characters in an n-gram
BITS = 16  # n-grams are hashed into 2**BITS columns
SAMPLE = 1000  # labelled texts a language to fit on
UNKNOWN = "und"


def _grams(texts: list, sizes=SIZES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Column of every character n-gram of lower-cased texts, and the row limits."""
    clean = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    limits = np.concatenate(([0], np.cumsum([len(t) for t in clean])))
    room = np.repeat(limits[1:], np.diff(limits)) - np.arange(len(points))
    columns, fits = [], []
    for size in sizes:
        code = np.full(len(points), size, np.uint64)
        for j in range(size):
            code[:len(points) - j] = code[:len(points) - j] * np.uint64(0x100000001B3) + points[j:]
        code *= np.uint64(tokens.BASE)
        columns.append((code >> np.uint64(64 - bits)).astype(np.int32))
        fits.append(room >= size)
    columns, fits = np.stack(columns, 1).reshape(-1), np.stack(fits, 1).reshape(-1)
    ends = np.concatenate(([0], np.cumsum(fits)))[limits * len(sizes)]
    return columns[fits], ends


def _parts(texts, size: int = 1 << 18):
    """Ranges of rows with about ``size`` characters."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


@dataclass
class LanguageModel:
    labels: list
    weights: np.ndarray  # columns x labels, each row already times its IDF
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        for a, b in _parts(texts):
            columns, ends = _grams(texts[a:b])
            n = np.diff(ends)
            some = np.flatnonzero(n)
            if len(some):
                out[a + some] += np.add.reduceat(self.weights[columns], ends[some], axis=0) / n[some, None]
        return out

    def predict(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest label, and its calibrated probability."""
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _document_counts(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many texts each column occurs, and the number of texts: one pass over all of them.

    Each task adds up its own counts, so 2**bits numbers a task are summed and nothing that grows with the corpus.
    """
    def run(batches):
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _parts(texts):
                columns, ends = _grams(texts[a:b])
                for i, j in zip(ends[:-1], ends[1:]):
                    total[np.unique(columns[i:j])] += 1
            n += len(texts)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(filled, -1)), pa.array(np.append(total[filled], n))], ["col", "n"])

    rows = docs.select("text").mapInArrow(lean(run), "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << bits)
    at = rows["col"] >= 0
    counts[rows["col"][at]] = rows["n"][at]
    return counts, int(rows["n"][~at].sum())


class _Rows:
    """Texts as (columns, TF-IDF values), the last column the constant; made when asked for, so that the sample stays small."""

    def __init__(self, ends, cols, vals, idf):
        self.ends, self.cols, self.vals, self.idf = ends, cols, vals, idf

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[i], self.ends[i + 1])
        columns = self.cols[part].astype(np.int64)
        return np.append(columns, len(self.idf)), np.append(self.vals[part] * self.idf[columns] * 10.0, 1.0)


def _follow(rows, target: np.ndarray, n_columns: int, n_labels: int, passes: int = 4, alpha: float = 0.5, beta: float = 1.0,
            l1: float = 1e-3, l2: float = 1e-3, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, a step a text: per-coordinate rates, L1 makes weights exactly zero, L2 shrinks."""
    chosen = np.arange(len(rows)) if chosen is None else chosen
    z, squares = np.zeros((n_columns + 1, n_labels)), np.zeros((n_columns + 1, n_labels))
    rng = np.random.default_rng(7)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(passes):
        for i in chosen[rng.permutation(len(chosen))]:
            columns, values = rows[i]
            w = weights(z[columns], squares[columns])
            p = _softmax((values @ w)[None])[0]
            p[target[i]] -= 1.0
            g = values[:, None] * p
            rate = (np.sqrt(squares[columns] + g * g) - np.sqrt(squares[columns])) / alpha
            z[columns] += g - rate * w
            squares[columns] += g * g
    w = weights(z, squares)
    return w[:-1], w[-1]


def smallest(rows: DataFrame, group: str, draw: Column, sample: int) -> dict:
    """For each group the ``sample``-th smallest of its different draws, or the largest if there are fewer.

    Each task keeps ``sample`` numbers a group, and no more reach the driver from a task.
    """
    def run(batches):
        kept: dict = {}
        for batch in batches:
            keys, numbers = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
            places = keys.indices.to_numpy(zero_copy_only=False)
            for i, key in enumerate(keys.dictionary.to_pylist()):
                kept[key] = np.unique(np.append(kept.get(key, np.zeros(0, np.int64)), numbers[places == i]))[:sample]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in kept for _ in kept[k]]), pa.array(np.concatenate(list(kept.values())))],
                                             ["key", "draw"])

    few = rows.select(F.col(group).cast("string").alias("key"), draw.alias("draw")).mapInArrow(lean(run), "key string, draw long").distinct()
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("draw"))).filter(F.col("rank") <= sample)
    return {r["key"]: r["last"] for r in ranked.groupBy("key").agg(F.max("draw").alias("last")).collect()}  # one row a group


def fit_language_model(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
                       sample: int = SAMPLE, bits: int = BITS) -> LanguageModel:
    """Learn from rows with a label.  Inverse document frequencies cover all of them; weights are fitted on at most
    ``sample`` different texts a label, those with an id whose hashes of (id, text) are smallest.  A fifth of these only sets
    the temperature.

    Without a usable label the model knows no language and ``identify_language`` answers ``und`` everywhere.
    """
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.col(label_col).cast("string").alias("label")).filter("label is not null and text is not null")
    picked = smallest(known.filter("id is not null"), "label", F.xxhash64("id", "text"), sample)
    if not picked:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros(0), 1.0)
    labels = sorted(picked)
    counts, n = _document_counts(known, bits)
    idf = np.log((1 + n) / (1 + counts)) + 1.0
    limit = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(picked[k]))])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cols, vals = [], []
            for a, b in _parts(texts):
                columns, ends = _grams(texts[a:b])
                for i, j in zip(ends[:-1], ends[1:]):
                    c, k = np.unique(columns[i:j], return_counts=True)
                    cols.append(c)
                    vals.append(k / max(j - i, 1))
            ends = np.concatenate(([0], np.cumsum([len(c) for c in cols]))).astype(np.int32)
            flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, flat(cols, np.int32)),
                 pa.ListArray.from_arrays(ends, flat(vals, np.float32)), batch.column(2)], ["id", "cols", "vals", "label"])

    # rows with the same id, text and label are one example
    chosen = known.filter("id is not null").withColumn("draw", F.xxhash64("id", "text"))
    chosen = chosen.filter(F.col("draw") <= F.try_element_at(limit, F.col("label"))).dropDuplicates(["draw", "label"]).drop("draw")
    table = chosen.mapInArrow(lean(run), "id string, cols array<int>, vals array<float>, label string").toArrow().sort_by(
        [("id", "ascending"), ("label", "ascending")])
    cols, vals = (table[k].combine_chunks() for k in ("cols", "vals"))
    ends, cols, vals = cols.offsets.to_numpy(), cols.values.to_numpy(), vals.values.to_numpy()
    rows = _Rows(ends, cols, vals, idf)
    target = np.array([labels.index(x) for x in table["label"].to_pylist()])
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held)
    weights, bias = _follow(rows, target, 1 << bits, len(labels), chosen=train)
    model = LanguageModel(labels, np.ascontiguousarray(weights * idf[:, None] * 10.0), bias, 1.0)
    if held.any():
        logits = np.stack([(rows[i][1][:-1] @ weights[rows[i][0][:-1]]) + bias for i in np.flatnonzero(held)])
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(logits)), target[held]] + 1e-12).mean()
                  for t in np.geomspace(0.02, 20, 61)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; input columns of these names are replaced.

    A text that is null, empty or without a letter is ``und`` with score 0.  Texts are read whole, in parts.
    """
    inputs = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x labels numbers

    @F.pandas_udf("struct<label:string,score:double>")
    def guess(text):
        import pandas as pd
        m = shared.value
        if not m.labels:
            return pd.DataFrame({"label": [UNKNOWN] * len(text), "score": 0.0})
        best, score = m.predict(text.tolist())
        release()
        return pd.DataFrame({"label": np.array(m.labels, object)[best], "score": score})

    letters = F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in inputs]).alias("row")
    out = docs.select(row, letters.alias("letters"), guess(F.col(f"`{text_col}`").cast("string")).alias("guess"))
    return out.select("row.*", F.when(F.col("letters"), F.col("guess.label")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(F.col("letters"), F.col("guess.score")).otherwise(0.0).alias("score"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the id's CRC falls into the fold that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
