"""Gramian core: one aggregation holds everything least squares needs.

``gram`` reduces any number of rows to one array of cross-product sums per group;
solves, residual sums, partial fits and cross-validation errors then follow from
that array without touching the rows again.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from statloom.functions.vectors import vector_udf

EXPRESSION_LIMIT = 55  # cross products kept as plain sum expressions; beyond it Arrow batches
HELD_GROUPS = 4000  # groups a task sums up before it hands them on

RESERVED = {"n", "w", "g", "f", "beta", "se", "rss", "df", "sigma2", "inv"}  # result columns of a fit


def pack(matrix: np.ndarray) -> list[float]:
    return matrix[np.triu_indices(matrix.shape[0])].tolist()


def unpack(flat) -> np.ndarray:
    flat = np.asarray(flat, dtype=float)
    k = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


def gram(df: DataFrame, cols: list[Column], keys: list[str] = (), weight: Column | None = None) -> DataFrame:
    """(keys, n, w, g): row count, weight sum, packed upper triangle of the weighted X'X.

    Rows with a null or NaN in any column are left out, however many columns there are.
    """
    taken = RESERVED & set(keys)
    if taken:
        raise ValueError(f"rename the grouping columns {sorted(taken)}")
    # The columns stay unnamed expressions: a projection with many aliases of the same
    # inputs makes the optimizer's constraint inference grow out of hand.
    cols = [c.cast("double") for c in cols]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if len(pairs) <= EXPRESSION_LIMIT:
        rows = df.filter(reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in cols]))
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"),
                                       F.array(*[F.sum(w * cols[i] * cols[j]) for i, j in pairs]).alias("g"))
    rows = df.select(*keys, w.alias("__w"), F.array(*cols).alias("__x"))
    keys = list(keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    schema = (fields + ", " if fields else "") + "n bigint, w double, g array<double>"

    upper = np.triu_indices(k)

    key_types = {f.name: to_arrow_type(f.dataType) for f in rows.schema.fields if f.name in keys}

    def table(held: dict) -> pa.RecordBatch:
        labels = list(zip(*held.keys())) if keys else []
        n, ws, g = zip(*held.values())
        return pa.RecordBatch.from_arrays(
            [*[pa.array([None if pd.isna(v) else v for v in c], key_types[name]) for name, c in zip(keys, labels)],
             pa.array(n, pa.int64()), pa.array(ws, pa.float64()), pa.array([v.tolist() for v in g], pa.list_(pa.float64()))],
            names=[*keys, "n", "w", "g"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for arrow in batches:
            x = arrow.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            whole = ~np.isnan(x).any(axis=1)
            if not whole.any():
                continue
            x = x[whole]
            wt = arrow.column("__w").to_numpy(zero_copy_only=False)[whole]
            batch = arrow.select(keys).to_pandas()[whole] if keys else pd.DataFrame(index=range(len(x)))
            groups = batch.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(batch), int)
            order = np.argsort(groups, kind="stable")
            starts = np.flatnonzero(np.diff(groups[order], prepend=-1))
            x, wt = x[order], wt[order]
            if len(starts) == 1:
                cross = (x.T @ (x * wt[:, None]))[upper][None, :]
            else:
                cross = np.add.reduceat(x[:, upper[0]] * x[:, upper[1]] * wt[:, None], starts)
            labels = batch[keys].iloc[order[starts]].itertuples(index=False, name=None) if keys else [()]
            sizes, wsum = np.diff(np.append(starts, len(x))), np.add.reduceat(wt, starts)
            for label, n, ws, g in zip(labels, sizes, wsum, cross):
                n0, w0, g0 = held.get(label, (0, 0.0, 0.0))
                held[label] = (n0 + int(n), w0 + float(ws), g0 + g)
            if len(held) > HELD_GROUPS:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    parts = rows.mapInArrow(partial, schema)
    cells = (parts.select(*keys, "n", "w", F.posexplode("g").alias("pos", "val"))
             .groupBy(*keys, "pos").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("val").alias("val")))
    return cells.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("w").alias("w"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "val"))), lambda s: s["val"]).alias("g"))


def _solve(gxx: np.ndarray, gxy: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(gxx, gxy)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(gxx, gxy, rcond=None)[0]


def fit_from_gram(n: float, w: float, flat) -> dict:
    """Least squares of the last column on all columns before it."""
    m = unpack(flat)
    gxx, gxy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    p = len(gxy)
    scale = np.sqrt(np.maximum(np.diag(gxx), 1e-300))
    inv = np.linalg.pinv(gxx / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    beta = _solve(gxx / np.outer(scale, scale), gxy / scale) / scale
    rss = max(yy - 2 * beta @ gxy + beta @ gxx @ beta, 0.0)
    df = n - p
    sigma2 = rss / df if df > 0 else float("nan")
    return {"beta": beta.tolist(), "se": np.sqrt(np.maximum(np.diag(inv) * sigma2, 0)).tolist(),
            "rss": float(rss), "df": int(df), "sigma2": float(sigma2), "inv": pack(inv)}


FIT = "beta array<double>, se array<double>, rss double, df bigint, sigma2 double, inv array<double>"


@vector_udf(FIT)
def _fit(n: pd.Series, w: pd.Series, g: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fit_from_gram(a, b, c) for a, b, c in zip(n, w, g)],
                        columns=["beta", "se", "rss", "df", "sigma2", "inv"])


def least_squares(df: DataFrame, y: Column, xs: list[Column], keys: list[str] = (),
                  weight: Column | None = None) -> DataFrame:
    """One fit per group: (keys, n, w, g, beta, se, rss, df, sigma2, inv); callers add the intercept column.

    Runs as one aggregation; the p x p solve happens on the reduced rows.
    """
    packed = gram(df, [*xs, y], keys, weight)
    packed = packed.filter(F.col("n") > 0)
    return packed.withColumn("f", _fit("n", "w", "g")).select(*keys, "n", "w", "g", "f.*")


def linear_predictor(beta: str, xs: list[Column]) -> Column:
    out = F.lit(0.0)
    for i, x in enumerate(xs):
        out = out + F.col(beta)[i] * x
    return out


def quadratic_form(packed: str, xs: list[Column]) -> Column:
    """x' M x for a packed symmetric M held in an array column."""
    out, pos = F.lit(0.0), 0
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            term = F.col(packed)[pos] * xs[i] * xs[j]
            out = out + (term if i == j else 2 * term)
            pos += 1
    return out
