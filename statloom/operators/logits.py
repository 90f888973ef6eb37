"""Logistic models by Newton's method on distinct patterns.

Rows are reduced to one line per combination of label and predictors.  A Newton round is
one pass over these lines that serves every candidate model of a search at once and
returns its likelihood, gradient and information.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    """Coefficients (intercept first), their covariance, and the log likelihood."""
    beta: np.ndarray
    cov: np.ndarray
    loglik: float

    @property
    def aic(self) -> float:
        return 2 * len(self.beta) - 2 * self.loglik


def patterns(df: DataFrame, label: Column, cols: list[Column], weight: Column | None = None) -> DataFrame:
    """(label, x, weight): one row for each combination without nulls; weights of 0 are left out."""
    names = [f"__f{i}" for i in range(len(cols))]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(label.cast("double").alias("label"), *[c.cast("double").alias(n) for n, c in zip(names, cols)], w.alias("__w")).dropna()
    counted = rows.filter("__w > 0").groupBy("label", *names).agg(F.sum("__w").alias("weight"))
    return counted.select("label", F.array(*[F.col(n) for n in names]).cast("array<double>").alias("x"), "weight")


def _sums(lines: DataFrame, width: int, tries: list[tuple[list[int], np.ndarray]]) -> list[np.ndarray]:
    """For each (columns, coefficients): log likelihood, gradient and information in one flat array, from one pass."""
    def partial(batches):
        held = [np.zeros(1 + len(b) + len(b) ** 2) for _, b in tries]
        for batch in batches:
            y, w = (batch.column(c).to_numpy() for c in ("label", "weight"))
            x = np.column_stack([np.ones(len(y)), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)])
            for sums, (columns, beta) in zip(held, tries):
                z = x[:, [0, *[c + 1 for c in columns]]]
                eta = z @ beta
                mu = np.exp(-np.logaddexp(0.0, -eta))
                sums[0] += w @ (y * eta - np.logaddexp(0.0, eta))
                sums[1:1 + len(beta)] += z.T @ (w * (y - mu))
                sums[1 + len(beta):] += (z.T @ (z * (w * mu * (1 - mu))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tries)), pa.int32()), pa.array([h.tolist() for h in held], pa.list_(pa.float64()))], ["m", "v"])

    cells = lines.mapInArrow(partial, "m int, v array<double>").select("m", F.posexplode("v").alias("at", "v"))
    out = [np.zeros(1 + len(b) + len(b) ** 2) for _, b in tries]
    for r in cells.groupBy("m", "at").agg(F.sum("v").alias("v")).collect():  # a few numbers a model
        out[r["m"]][r["at"]] = r["v"]
    return out


def fit_all(lines: DataFrame, width: int, models: list[list[int]], starts: list[np.ndarray] | None = None, rounds: int = 50,
            tol: float = 1e-10) -> list[Fit]:
    """One fit for each list of columns of ``x``, all by the same passes over ``lines`` (from :func:`patterns`).

    A step that lowers the likelihood is halved; a model stops when its deviance changes by less than ``tol`` of
    itself, so separated classes end with large coefficients.  Repeated columns share their effect.
    """
    beta = [np.zeros(len(c) + 1) for c in models] if starts is None else [np.array(s, dtype=float) for s in starts]
    before = list(beta)
    last = [-np.inf] * len(models)
    done: dict[int, Fit] = {}
    for turn in range(rounds):
        open_ = [i for i in range(len(models)) if i not in done]
        if not open_:
            break
        for i, flat in zip(open_, _sums(lines, width, [(models[i], beta[i]) for i in open_])):
            k = len(beta[i])
            loglik, gradient, info = float(flat[0]), flat[1:1 + k], flat[1 + k:].reshape(k, k)
            if loglik < last[i] - tol * (abs(last[i]) + 0.1) and turn + 1 < rounds:
                beta[i] = (beta[i] + before[i]) / 2
                continue
            scale = np.sqrt(np.maximum(np.diag(info), 1e-300))
            cov = np.linalg.pinv(info / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)
            if abs(loglik - last[i]) <= tol * (abs(loglik) + 0.05) or turn + 1 == rounds:
                done[i] = Fit(beta[i], cov, loglik)
                continue
            before[i], last[i] = beta[i], loglik
            beta[i] = beta[i] + cov @ gradient
    return [done[i] for i in range(len(models))]
