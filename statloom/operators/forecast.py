"""Forecasters for many keyed series at once, and their accuracy.

Every forecaster returns (keys, model, h, index, mean, sd).  Sums, lag products and
last values come from grouped aggregates; only short per-key vectors (coefficients,
last values, one calendar-length series for smoothing) reach Arrow-batched helpers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.nulls import join_null_safe
from statloom.functions.scalars import box_cox, inv_box_cox, norm_cdf, norm_pdf, normal_score
from statloom.functions.vectors import vector_udf
from statloom.operators.linear import gram, least_squares, linear_predictor, quadratic_form, unpack
from statloom.operators.series import _levinson, acf, along, autocov, lagged, ndiffs, nsdiffs, portmanteau
from statloom.operators.tabulate import histogram


def transformed(df: DataFrame, y: str, lam: float | None) -> DataFrame:
    """Series on the model scale; ``lam=0`` is the log."""
    return df if lam is None else df.withColumn(y, box_cox(F.col(y), lam)).filter(F.col(y).isNotNull())


def horizon(table: DataFrame, h: int, last: str, index: str) -> DataFrame:
    """One row per step, with the index running on day by day from ``last``."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(h)))
    return table.withColumn("h", steps).withColumn(index, F.date_add(last, F.col("h")))


def _shape(df: DataFrame, keys, model: str, index: str) -> DataFrame:
    return df.select(*keys, F.lit(model).alias("model"), "h", index, "mean", "sd")


# ---------------------------------------------------------------- closed forms

def fc_mean(df, keys, index, y, h, lam=None) -> DataFrame:
    """Historical mean."""
    fit = transformed(df, y, lam).groupBy(*keys).agg(
        F.max(index).alias("__last"), F.avg(y).alias("mean"), (F.stddev_samp(y) * F.sqrt(1 + 1 / F.count(y))).alias("sd"))
    return _shape(horizon(fit, h, "__last", index), keys, "mean", index)


def fc_rw(df, keys, index, y, h, lam=None) -> DataFrame:
    """Last value, with variance growing by the mean squared step."""
    rows = transformed(df, y, lam)
    step = F.col(y) - F.lag(y).over(along(keys, index))
    fit = rows.withColumn("__d", step).groupBy(*keys).agg(
        F.max(index).alias("__last"), F.max_by(y, index).alias("mean"), F.avg(F.col("__d") * F.col("__d")).alias("__s2"))
    return _shape(horizon(fit, h, "__last", index).withColumn("sd", F.sqrt(F.col("h") * F.col("__s2"))), keys, "rw", index)


def fc_snaive(df, keys, index, y, h, period=7, lam=None) -> DataFrame:
    """The value one season ago."""
    rows = transformed(df, y, lam)
    w = along(keys, index)
    rows = rows.withColumns({"__d": F.col(y) - F.lag(y, period).over(w),
                             "__back": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(index).desc()))})
    fit = rows.groupBy(*keys).agg(F.max(index).alias("__last"), F.avg(F.col("__d") * F.col("__d")).alias("__s2"))
    tail = rows.filter(F.col("__back") <= period).select(*keys, "__back", F.col(y).alias("mean"))
    steps = horizon(fit, h, "__last", index).withColumn("__back", (period - F.pmod(F.col("h") - 1, F.lit(period))).cast("int"))
    out = join_null_safe(steps, tail, [*keys, "__back"])
    return _shape(out.withColumn("sd", F.sqrt(F.col("__s2") * (F.floor((F.col("h") - 1) / period) + 1))), keys, "snaive", index)


def fc_tslm(df, keys, index, y, h, trend=True, season: list[Column] = (), lam=None) -> DataFrame:
    """Regression on intercept, day number and season dummies (expressions of the index column)."""
    rows = transformed(df, y, lam)
    xs = [F.lit(1.0)] + ([F.unix_date(index).cast("double") / 1000.0] if trend else []) + [s.cast("double") for s in season]
    fit = least_squares(rows, F.col(y), xs, keys)
    ends = rows.groupBy(*keys).agg(F.max(index).alias("__last"))
    out = horizon(join_null_safe(fit, ends, keys), h, "__last", index)
    out = out.withColumns({"mean": linear_predictor("beta", xs),
                           "sd": F.sqrt(F.col("sigma2") * (1 + quadratic_form("inv", xs)))})
    return _shape(out, keys, "tslm", index)


# ---------------------------------------------------------------- autoregressions

def last_values(df, keys, index, y, count: int) -> DataFrame:
    """(keys, __last, tail): the newest ``count`` values, oldest first."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(index).desc()))
    rows = df.select(*keys, index, F.col(y).alias("__y")).withColumn("__b", back).filter(F.col("__b") <= count)
    return rows.groupBy(*keys).agg(
        F.max(index).alias("__last"),
        F.transform(F.sort_array(F.collect_list(F.struct(index, "__y"))), lambda s: s["__y"]).alias("tail"))


AR = "p int, phi array<double>, sigma2 double, aic double"


def ar_fit(df, keys, index, y, max_order: int = 10, order: int | None = None) -> DataFrame:
    """(keys, n, mean, p, phi, sigma2, aic): Yule-Walker, order by AIC unless given."""
    @vector_udf(AR)
    def choose(n: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for size, cov in zip(n, c):
            coefs, var, _ = _levinson(cov)
            aic = [size * math.log(v) + 2 * (k + 1) if v > 0 else -math.inf for k, v in enumerate(var)]
            k = int(np.argmin(aic)) if order is None else order
            out.append((k, coefs[k].tolist(), float(var[k] * size / max(size - k - 1, 1)), float(aic[k])))
        return pd.DataFrame(out, columns=["p", "phi", "sigma2", "aic"])

    c = autocov(df, keys, index, y, max_order if order is None else max(order, 1))
    return c.withColumn("f", choose("n", "c")).select(*keys, "n", "mean", "f.*")


@vector_udf("array<struct<mean:double,sd:double>>")
def _arima_path(tail: pd.Series, etail: pd.Series, const: pd.Series, phi: pd.Series, theta: pd.Series, sigma2: pd.Series,
                d: pd.Series, h: pd.Series) -> pd.Series:
    """Means and standard deviations of an ARIMA recursion started from its last values."""
    out = []
    for y, e, c, ar, ma, s2, diff, steps in zip(tail, etail, const, phi, theta, sigma2, d, h):
        y, ar, ma = np.asarray(y, dtype=float), np.asarray(ar, dtype=float), np.asarray(ma, dtype=float)
        w = list(np.diff(y, n=int(diff)))
        e = list(np.asarray(e, dtype=float)) if e is not None else []
        level, path = (y[-1] if len(y) else 0.0), []
        for _ in range(int(steps)):
            nxt = c + sum(a * w[-i] for i, a in enumerate(ar, 1) if i <= len(w)) + sum(b * e[-i] for i, b in enumerate(ma, 1) if i <= len(e))
            w.append(nxt)
            e.append(0.0)
            level = level + nxt if diff else nxt
            path.append(level)
        psi = [1.0]
        for k in range(1, int(steps)):
            psi.append((ma[k - 1] if k <= len(ma) else 0.0) + sum(ar[i] * psi[k - 1 - i] for i in range(min(len(ar), k))))
        psi = np.cumsum(psi) if diff else np.asarray(psi)
        sd = np.sqrt(s2 * np.cumsum(psi ** 2))
        out.append([{"mean": float(m), "sd": float(s)} for m, s in zip(path, sd)])
    return pd.Series(out)


def _unroll(df: DataFrame, keys, index, model: Column) -> DataFrame:
    rows = df.select(*keys, "__last", model.alias("model"), F.posexplode("path").alias("pos", "r"))
    return rows.select(*keys, "model", (F.col("pos") + 1).alias("h"), F.date_add("__last", F.col("pos") + 1).alias(index),
                       "r.mean", "r.sd")


def fc_ar(df, keys, index, y, h, max_order=10, order=None, lam=None) -> DataFrame:
    rows = transformed(df, y, lam)
    fit = ar_fit(rows, keys, index, y, max_order, order)
    both = join_null_safe(fit, last_values(rows, keys, index, y, max(max_order, order or 0, 1)), keys)
    const = F.col("mean") * (1 - F.aggregate("phi", F.lit(0.0), lambda a, b: a + b))
    none = F.array().cast("array<double>")
    both = both.withColumn("path", _arima_path("tail", none, const, "phi", none, "sigma2", F.lit(0), F.lit(h)))
    return _unroll(both, keys, index, F.lit("ar"))


ORDERS = [(p, d, q) for d in (0, 1) for p in (0, 1, 2) for q in (0, 1)]


def arima_fits(df, keys, index, y, orders=ORDERS, long_order: int = 10, constant: bool = False) -> DataFrame:
    """(keys, p, d, q, const, phi, theta, sigma2, aic, etail) for a grid of orders.

    Two-stage regression: residuals of a long autoregression stand in for the unseen
    shocks, then lags of both explain the series.  All orders of one ``d`` share the
    same lag Gramian, so the grid costs two aggregations per ``d``.
    """
    out = None
    for d in sorted({o[1] for o in orders}):
        grid = [(p, q) for p, dd, q in orders if dd == d]
        pm, qm = max(p for p, _ in grid), max(q for _, q in grid)
        w = along(keys, index)
        rows = df.select(*keys, index, F.col(y).alias("__w"))
        for _ in range(d):
            rows = rows.withColumn("__w", F.col("__w") - F.lag("__w").over(w))
        rows = lagged(rows, keys, index, "__w", max(long_order, pm), "__a")
        ones = [F.lit(1.0)] if constant else []
        ar = [*ones, *[F.col(f"__a{k}") for k in range(1, long_order + 1)]]
        long = least_squares(rows, F.col("__w"), ar, keys).select(*keys, F.col("beta").alias("__beta"))
        rows = join_null_safe(rows, long, keys).withColumn("__e", F.col("__w") - linear_predictor("__beta", ar)).drop("__beta")
        rows = lagged(rows, keys, index, "__e", max(qm, 1), "__b")
        design = [*ones, *[F.col(f"__a{k}") for k in range(1, pm + 1)], *[F.col(f"__b{k}") for k in range(1, qm + 1)]]
        g = gram(rows, [*design, F.col("__w")], keys)

        @vector_udf("array<struct<p:int,d:int,q:int,const:double,phi:array<double>,theta:array<double>,sigma2:double,aic:double>>")
        def solve(n: pd.Series, g: pd.Series) -> pd.Series:
            found = []
            for size, flat in zip(n, g):
                m, models = unpack(flat), []
                for p, q in grid:
                    c = 1 if constant else 0
                    idx = [*range(c), *range(c, c + p), *range(c + pm, c + pm + q)]
                    b = np.linalg.lstsq(m[np.ix_(idx, idx)], m[idx, -1], rcond=None)[0] if idx else np.zeros(0)
                    rss = max(m[-1, -1] - (2 * b @ m[idx, -1] - b @ m[np.ix_(idx, idx)] @ b if idx else 0.0), 0.0)
                    s2 = rss / size
                    models.append({"p": p, "d": d, "q": q, "const": float(b[0]) if c else 0.0, "phi": b[c:c + p].tolist(),
                                   "theta": b[c + p:].tolist(), "sigma2": float(s2),
                                   "aic": float(size * (math.log(2 * math.pi * s2) + 1) + 2 * (len(idx) + 1)) if s2 > 0 else -math.inf})
                found.append(models)
            return pd.Series(found)

        fits = g.select(*keys, F.explode(solve("n", "g")).alias("r")).select(*keys, "r.*")
        shocks = last_values(rows.filter(F.col("__e").isNotNull()), keys, index, "__e", max(qm, 1)).select(*keys, F.col("tail").alias("etail"))
        one = join_null_safe(fits, shocks, keys)
        out = one if out is None else out.unionByName(one)
    return out


def fc_arima(df, keys, index, y, h, orders=ORDERS, lam=None, constant=False, fits: DataFrame | None = None) -> DataFrame:
    """Forecasts of every order in ``orders`` (or of the given fits)."""
    rows = transformed(df, y, lam)
    fits = arima_fits(rows, keys, index, y, orders, constant=constant) if fits is None else fits
    both = join_null_safe(fits, last_values(rows, keys, index, y, 4), keys)
    both = both.withColumn("path", _arima_path("tail", "etail", "const", "phi", "theta", "sigma2", "d", F.lit(h)))
    return _unroll(both, keys, index, F.format_string("arima(%d,%d,%d)", "p", "d", "q"))


def auto_arima(df, keys, index, y, h, lam=None, orders=ORDERS) -> DataFrame:
    """Differences by the stationarity test, then the order of smallest AIC per key."""
    rows = transformed(df, y, lam)
    fits = arima_fits(rows, keys, index, y, orders, constant=True)
    need = ndiffs(rows, keys, index, y, 1)
    fits = join_null_safe(fits, need, keys).filter(F.col("d") == F.col("ndiffs")).drop("ndiffs")
    rest = [c for c in fits.columns if c not in keys]
    best = fits.groupBy(*keys).agg(F.min_by(F.struct(*rest), "aic").alias("r")).select(*keys, "r.*")
    return fc_arima(rows, keys, index, y, h, fits=best)


SEASONAL = [(p, q, sp, sq) for p in (0, 1, 2) for q in (0, 1) for sp in (0, 1) for sq in (0, 1)]


def _seasonal_model(m: np.ndarray, ar: list[int], ma: list[int], order, period: int, constant: bool, rounds: int = 200):
    """(const, lag weights of the series, of the shocks, rss) of one multiplicative order on the lag Gramian ``m``.

    The rows of ``m`` are 1, the lags ``ar``, the lags ``ma`` and the response.  (1 - phi(B)) (1 - Phi(B^s)) and its
    like for the shocks are linear in the plain weights when the seasonal ones are held, and the other way round;
    the two least-squares steps take turns until the residual sum stays.
    """
    p, q, sp, sq = order
    place = {("a", k): 1 + i for i, k in enumerate(ar)} | {("e", k): 1 + len(ar) + i for i, k in enumerate(ma)}
    a, b = m[:-1, :-1], m[:-1, -1]
    plain = [("a", k) for k in range(1, p + 1)] + [("e", k) for k in range(1, q + 1)]
    season = [("a", k * period) for k in range(1, sp + 1)] + [("e", k * period) for k in range(1, sq + 1)]

    def step(own, held, weights):
        offset, columns = np.zeros(len(a)), np.zeros((len(a), len(own) + constant))
        for side, lag in held:
            offset[place[side, lag]] += weights[side, lag]
        for i, (side, lag) in enumerate(own):
            columns[place[side, lag], i] += 1.0
            for other, more in held:
                if other == side:
                    columns[place[side, lag + more], i] += weights[other, more] * (-1.0 if side == "a" else 1.0)
        if constant:
            columns[0, -1] = 1.0
        x = np.linalg.lstsq(columns.T @ a @ columns, columns.T @ (b - a @ offset), rcond=None)[0]
        full = offset + columns @ x
        return dict(zip(own, x)), full, float(m[-1, -1] - 2 * full @ b + full @ a @ full)

    full, rss = np.zeros(len(a)), m[-1, -1]
    low, high, last = {}, dict.fromkeys(season, 0.0), math.inf
    for _ in range(rounds):
        low, full, rss = step(plain, season, high)
        if not season:
            break
        high, full, rss = step(season, plain, low)
        if last - rss <= 1e-12 * max(m[-1, -1], 1e-300):
            break
        last = rss
    return float(full[0]), full[1:1 + len(ar)], full[1 + len(ar):], max(rss, 0.0)


def sarima_fits(df, keys, index, y, orders=SEASONAL, diffs=(0, 0), period: int = 7, long_order: int | None = None,
                constant: bool = True) -> DataFrame:
    """(keys, p, d, q, sp, sd, sq, const, phi, theta, sigma2, aic, etail) for seasonal orders (p, q, sp, sq).

    ``diffs`` is (d, sd) for all keys or a table (keys, d, sd) with 0 or 1 of each, so all keys and orders share one lag
    Gramian.  ``phi`` and ``theta`` are the multiplied-out weights, ``phi`` with the differences in it: the model is
    y = const + sum phi_k y_(t-k) + shocks.  Shocks are residuals of an autoregression of ``long_order`` lags
    (three periods unless given).  A constant is fitted where at most one difference is taken.
    """
    pm, qm, spm, sqm = (max(o[i] for o in orders) for i in range(4))
    reach = lambda n, k: sorted({i + period * j for i in range(n + 1) for j in range(k + 1)} - {0})
    ar, ma = reach(pm, spm), reach(qm, sqm)
    long_order = 3 * period if long_order is None else long_order
    w = along(keys, index)
    rows = df.select(*keys, index, F.col(y).cast("double").alias("__y"))
    if isinstance(diffs, DataFrame):
        rows = join_null_safe(rows, diffs.select(*keys, F.col("d").alias("__d"), F.col("sd").alias("__sd")), keys)
    else:
        rows = rows.withColumns({"__d": F.lit(diffs[0]), "__sd": F.lit(diffs[1])})
    rows = rows.withColumn("__s", F.col("__y") - F.when(F.col("__sd") == 0, 0.0).otherwise(F.lag("__y", period).over(w)))
    rows = rows.withColumn("__w", F.col("__s") - F.when(F.col("__d") == 0, 0.0).otherwise(F.lag("__s").over(w)))
    most = max([long_order if ma else 0, *ar, 1])
    rows = lagged(rows.select(*keys, index, "__w", "__d", "__sd"), keys, index, "__w", most, "__a")
    if ma:
        past = [F.lit(1.0), *[F.col(f"__a{k}") for k in range(1, long_order + 1)]]
        long = least_squares(rows, F.col("__w"), past, keys).select(*keys, F.col("beta").alias("__beta"))
        rows = join_null_safe(rows, long, keys).withColumn("__e", F.col("__w") - linear_predictor("__beta", past)).drop("__beta")
        rows = lagged(rows, keys, index, "__e", max(ma), "__b")
    g = gram(rows, [F.lit(1.0), *[F.col(f"__a{k}") for k in ar], *[F.col(f"__b{k}") for k in ma], F.col("__w")], keys)
    taken = rows.groupBy(*keys).agg(F.max("__d").alias("d"), F.max("__sd").alias("sd"))

    @vector_udf("array<struct<p:int,d:int,q:int,sp:int,sd:int,sq:int,const:double,phi:array<double>,theta:array<double>,sigma2:double,aic:double>>")
    def solve(n: pd.Series, g: pd.Series, d: pd.Series, sd: pd.Series) -> pd.Series:
        found = []
        for size, flat, one, seasonal in zip(n, g, d, sd):
            m, models = unpack(flat), []
            drift = constant and one + seasonal < 2
            level = np.convolve([1.0, -1.0] if one else [1.0], [1.0, *[0.0] * (period - 1), -1.0] if seasonal else [1.0])
            for order in orders:
                c, phi, theta, rss = _seasonal_model(m, ar, ma, order, period, drift)
                poly, shocks = np.zeros(max(ar, default=0) + 1), np.zeros(max(ma, default=0))
                poly[0], poly[ar] = 1.0, -phi
                shocks[np.array(ma, dtype=int) - 1] = theta
                p, q, sp, sq = order
                s2 = rss / size
                models.append({"p": p, "d": int(one), "q": q, "sp": sp, "sd": int(seasonal), "sq": sq, "const": c,
                               "phi": (-np.convolve(poly, level)[1:]).tolist(), "theta": shocks.tolist(), "sigma2": float(s2),
                               "aic": float(size * (math.log(2 * math.pi * s2) + 1) + 2 * (sum(order) + drift + 1)) if s2 > 0 else -math.inf})
            found.append(models)
        return pd.Series(found)

    fits = join_null_safe(g, taken, keys)
    fits = fits.select(*keys, F.explode(solve("n", "g", "d", "sd")).alias("r")).select(*keys, "r.*")
    if not ma:
        return fits.withColumn("etail", F.array().cast("array<double>"))
    shocks = last_values(rows.filter(F.col("__e").isNotNull()), keys, index, "__e", max(ma)).select(*keys, F.col("tail").alias("etail"))
    return join_null_safe(fits, shocks, keys)


def fc_sarima(df, keys, index, y, h, orders=SEASONAL, diffs=(0, 0), period: int = 7, lam=None, constant: bool = True,
              fits: DataFrame | None = None) -> DataFrame:
    """Forecasts of every seasonal order in ``orders`` (or of the given fits)."""
    rows = transformed(df, y, lam)
    if fits is None:
        fits = sarima_fits(rows, keys, index, y, orders, diffs, period, constant=constant)
        reach = max(o[0] + period * o[2] for o in orders)
    else:
        reach = max(o[0] + period * o[2] for o in SEASONAL)
    both = join_null_safe(fits, last_values(rows, keys, index, y, reach + period + 1), keys)
    both = both.withColumn("path", _arima_path("tail", "etail", "const", "phi", "theta", "sigma2", F.lit(0), F.lit(h)))
    name = F.format_string(f"arima(%d,%d,%d)(%d,%d,%d)[{period}]", "p", "d", "q", "sp", "sd", "sq")
    return _unroll(both, keys, index, name)


def auto_sarima(df, keys, index, y, h, period: int = 7, lam=None) -> DataFrame:
    """Automatic seasonal orders per key: a seasonal difference by the strength of the season, a plain one by the
    stationarity test of what is left, then the order of ``SEASONAL`` with the smallest AIC."""
    rows = transformed(df, y, lam)
    season = nsdiffs(rows, keys, index, y, F.pmod(F.unix_date(index), F.lit(period)), period)
    season = season.select(*keys, F.coalesce("nsdiffs", F.lit(0)).alias("sd"))
    left = join_null_safe(rows.select(*keys, index, F.col(y).alias("__y")), season, keys)
    left = left.withColumn("__w", F.col("__y") - F.when(F.col("sd") == 0, 0.0).otherwise(F.lag("__y", period).over(along(keys, index))))
    need = ndiffs(left.filter(F.col("__w").isNotNull()), keys, index, "__w", 1).select(*keys, F.col("ndiffs").alias("d"))
    fits = sarima_fits(rows, keys, index, y, SEASONAL, join_null_safe(season, need, keys), period)
    rest = [c for c in fits.columns if c not in keys]
    best = fits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("aic", "p", "q", "sp", "sq")).alias("r")).select(*keys, "r.*")
    return fc_sarima(rows, keys, index, y, h, period=period, fits=best)


# ---------------------------------------------------------------- smoothing

def sorted_series(df, keys, index, y) -> DataFrame:
    """(keys, __last, a): one calendar-length array per key; (key, index) must be unique."""
    return df.groupBy(*keys).agg(
        F.max(index).alias("__last"),
        F.transform(F.sort_array(F.collect_list(F.struct(index, y))), lambda s: s[y].cast("double")).alias("a"))


def fc_ses(df, keys, index, y, h, alphas=tuple(i / 10 for i in range(1, 10)), lam=None) -> DataFrame:
    """Simple smoothing by a JVM fold, with the weight of smallest one-step error per key."""
    rows = sorted_series(transformed(df, y, lam), keys, index, y)
    start = F.struct(F.col("a")[0].alias("l"), F.lit(0.0).alias("sse"))
    rows = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))

    def step(s, x):
        e = x - s["l"]
        return F.struct((s["l"] + F.col("alpha") * e).alias("l"), (s["sse"] + e * e).alias("sse"))

    rows = rows.withColumn("s", F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(1))), start, step))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("__last", "alpha", "s", F.size("a").alias("n")), F.struct("s.sse", "alpha")).alias("b"))
    best = best.select(*keys, "b.__last", "b.alpha", F.col("b.s.l").alias("mean"), F.try_divide(F.col("b.s.sse"), F.col("b.n") - 1).alias("s2"))
    out = horizon(best, h, "__last", index).withColumn("sd", F.sqrt(F.col("s2") * (1 + F.col("alpha") ** 2 * (F.col("h") - 1))))
    return _shape(out, keys, "ses", index)


ETS = ("form string, alpha double, beta double, phi double, gamma double, level double, slope double, season array<double>, "
       "sigma2 double, aic double, n int")


def ets_fit(df, keys, index, y, period: int = 7) -> DataFrame:
    """Best of level, damped-trend and additive-season smoothing per key by AIC over a weight grid."""
    ab = [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]
    forms = {"ANN": [(a, 0.0, 1.0, 0.0) for a in ab],
             "AAdN": [(a, b * a, f, 0.0) for a in ab for b in (0.1, 0.4) for f in (0.9, 0.98)],
             "ANA": [(a, 0.0, 1.0, g) for a in ab for g in (0.05, 0.1, 0.3)],
             "AAdA": [(a, b * a, f, g) for a in ab for b in (0.1, 0.4) for f in (0.9, 0.98) for g in (0.05, 0.1, 0.3)]}
    grid = [(k, *w) for k, ws in forms.items() for w in ws]
    size = {"ANN": 2, "AAdN": 5, "ANA": 3 + period, "AAdA": 6 + period}

    @vector_udf(ETS)
    def fit(series: pd.Series) -> pd.DataFrame:
        kinds = np.array([g[0] for g in grid])
        al, be, ph, ga = (np.array([g[i] for g in grid]) for i in range(1, 5))
        seasonal = np.array([k.endswith("A") and k != "AAdN" and len(k) > 0 and k[-1] == "A" for k in kinds])
        trended = np.array([k.startswith("AAd") for k in kinds])
        pars = np.array([size[k] for k in kinds])
        out = []
        for a in series:
            x = np.asarray(a, dtype=float)
            n = len(x)
            usable = np.where(seasonal, n >= 2 * period, True)
            first = x[:period] if n >= period else x
            fig = np.zeros(period)
            if n >= 2 * period:
                whole = x[:n // period * period].reshape(-1, period)
                fig = (whole - whole.mean(axis=1, keepdims=True)).mean(axis=0)
            level = np.where(seasonal, first.mean(), x[0])
            slope = np.where(trended, (x[min(n - 1, period)] - x[0]) / max(min(n - 1, period), 1), 0.0)
            season = np.where(seasonal[:, None], fig[None, :], 0.0)
            sse = np.zeros(len(grid))
            for t in range(n):
                s = season[:, t % period]
                step = level + ph * slope * trended
                e = x[t] - step - s
                sse += e * e
                slope = ph * slope * trended + be * e
                level = step + al * e
                season[:, t % period] = s + ga * e
            with np.errstate(divide="ignore"):
                aic = np.where(usable, n * np.log(np.maximum(sse / n, 1e-300)) + 2 * pars, np.inf)
            i = int(np.argmin(aic))
            turn = [float(season[i, (n + j) % period]) for j in range(period)]
            out.append((kinds[i], al[i], be[i], ph[i], ga[i], level[i], slope[i] * trended[i], turn, sse[i] / max(n - pars[i], 1), aic[i], n))
        return pd.DataFrame(out, columns=["form", "alpha", "beta", "phi", "gamma", "level", "slope", "season", "sigma2", "aic", "n"])

    return sorted_series(df, keys, index, y).withColumn("f", fit("a")).select(*keys, "__last", "f.*")


def fc_ets(df, keys, index, y, h, period=7, lam=None) -> DataFrame:
    fit = ets_fit(transformed(df, y, lam), keys, index, y, period)
    out = horizon(fit, h, "__last", index)
    k, phi = F.col("h"), F.col("phi")
    damp = F.when(phi == 1, k.cast("double")).otherwise(phi * (1 - F.pow(phi, k)) / (1 - phi))
    mean = F.col("level") + damp * F.col("slope") + F.get("season", F.pmod(k - 1, F.lit(period)).cast("int"))
    steps = F.sequence(F.lit(1), k - 1)
    reach = lambda j: (F.col("alpha") + F.col("beta") * F.when(phi == 1, j.cast("double")).otherwise(phi * (1 - F.pow(phi, j)) / (1 - phi))
                       + F.when(F.pmod(j, F.lit(period)) == 0, F.col("gamma")).otherwise(0.0))
    spread = F.when(k > 1, F.aggregate(F.transform(F.when(k > 1, steps).otherwise(F.array(F.lit(1))), lambda j: reach(j) * reach(j)),
                                       F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)
    return _shape(out.withColumns({"mean": mean, "sd": F.sqrt(F.col("sigma2") * (1 + spread))}), keys, "ets", index)


def fc_croston(df, keys, index, y, h, alpha: float = 0.1) -> DataFrame:
    """Intermittent demand: smoothed size over smoothed gap, from the non-zero rows only."""
    w = along(keys, index)
    pos = F.row_number().over(w)
    rows = df.select(*keys, index, F.col(y).cast("double").alias("__y"), pos.alias("__t"))
    ends = rows.groupBy(*keys).agg(F.max(index).alias("__last"))
    hits = rows.filter(F.col("__y") != 0)
    hits = hits.withColumn("__g", (F.col("__t") - F.coalesce(F.lag("__t").over(w), F.lit(0))).cast("double"))
    arrays = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__t", "__y", "__g"))).alias("s"))

    def smooth(name):
        return F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))), F.col("s")[0][name],
                           lambda l, x: l + F.lit(alpha) * (x[name] - l))

    fit = arrays.select(*keys, smooth("__y").alias("size"), smooth("__g").alias("gap"))
    out = join_null_safe(ends, fit, keys, "left").withColumn("mean", F.coalesce(F.col("size") / F.col("gap"), F.lit(0.0)))
    return _shape(horizon(out, h, "__last", index).withColumn("sd", F.lit(None).cast("double")), keys, "croston", index)


# ---------------------------------------------------------------- pooled learner and covariates

def fc_lag_ml(df, keys, index, y, h, lags: int = 7, trees: int = 20, depth: int = 6, seed: int = 1, lam=None) -> DataFrame:
    """Non-linear autoregression: one forest over the lags of all series, applied step by step."""
    rows = transformed(df, y, lam)
    scale = rows.groupBy(*keys).agg(F.avg(y).alias("__m"), F.greatest(F.stddev_samp(y), F.lit(1e-12)).alias("__s"))
    rows = join_null_safe(rows.select(*keys, index, F.col(y).alias("__y")), scale, keys)
    rows = rows.withColumn("__y", (F.col("__y") - F.col("__m")) / F.col("__s"))
    names = [f"lag{k}" for k in range(1, lags + 1)]
    put = VectorAssembler(inputCols=names, outputCol="features")
    learn = put.transform(lagged(rows, keys, index, "__y", lags).dropna(subset=[*names, "__y"]))
    model = RandomForestRegressor(labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(learn)
    err = model.transform(learn).groupBy(*keys).agg(F.sqrt(F.avg((F.col("__y") - F.col("prediction")) ** 2)).alias("__e"))
    state = join_null_safe(join_null_safe(last_values(rows, keys, index, "__y", lags), scale, keys), err, keys)
    past = [f"lag{k}" for k in range(1, lags + 1)]
    state = state.select(*keys, "__last", "__m", "__s", "__e", *[F.col("tail")[lags - k].alias(f"lag{k}") for k in range(1, lags + 1)],
                         F.array().cast("array<double>").alias("__path"))
    for _ in range(h):  # one row a series goes through all steps and carries its path, so the plan grows by one model a step
        scored = model.transform(put.transform(state))
        state = scored.select(*keys, "__last", "__m", "__s", "__e", F.col("prediction").alias("lag1"),
                              *[F.col(a).alias(b) for a, b in zip(past, past[1:])],
                              F.concat("__path", F.array("prediction")).alias("__path"))
    rows = state.select(*keys, "__last", "__m", "__s", "__e", F.posexplode("__path").alias("__at", "__p"))
    step = F.col("__at") + 1
    out = rows.select(*keys, step.alias("h"), F.date_add("__last", step).alias(index),
                      (F.col("__p") * F.col("__s") + F.col("__m")).alias("mean"),
                      (F.col("__e") * F.col("__s") * F.sqrt(step)).alias("sd"))
    return _shape(out, keys, "lag_forest", index)


def xreg_ar1(df, keys, index, y, xs: list[str], rounds: int = 3) -> DataFrame:
    """(keys, beta, rho, sigma2): regression with AR(1) errors by repeated quasi-differencing."""
    w = along(keys, index)
    rows = df.withColumns({f"__p{c}": F.lag(c).over(w) for c in [y, *xs]})
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    beta = least_squares(rows, F.col(y), cols, keys).select(*keys, "beta")
    prev = [F.lit(1.0), *[F.col(f"__p{x}") for x in xs]]
    for _ in range(rounds):
        e = join_null_safe(rows, beta, keys).withColumns({
            "__e": F.col(y) - linear_predictor("beta", cols), "__l": F.col(f"__p{y}") - linear_predictor("beta", prev)})
        rho = e.filter(F.col("__l").isNotNull()).groupBy(*keys).agg(
            F.try_divide(F.sum(F.col("__e") * F.col("__l")), F.sum(F.col("__l") * F.col("__l"))).alias("rho"))
        q = join_null_safe(rows, rho, keys).filter(F.col(f"__p{y}").isNotNull())
        fit = least_squares(q, F.col(y) - F.col("rho") * F.col(f"__p{y}"), [c - F.col("rho") * p for c, p in zip(cols, prev)], keys)
        beta = fit.select(*keys, "beta")
    return join_null_safe(fit.select(*keys, "beta", "sigma2"), rho, keys)


# ---------------------------------------------------------------- outputs, intervals, accuracy

def augment(df, keys, index, y, fit: DataFrame) -> DataFrame:
    """Rows with fitted values and residuals of an autoregression table from :func:`ar_fit`."""
    top = max(1, fit.agg(F.coalesce(F.max(F.size("phi")), F.lit(0)).alias("k")).collect()[0]["k"])
    rows = lagged(df, keys, index, y, top, "__a")
    both = join_null_safe(rows, fit.select(*keys, F.col("mean").alias("__m"), F.col("phi").alias("__phi")), keys)
    fitted = F.col("__m")
    for k in range(1, top + 1):
        fitted = fitted + F.when(F.size("__phi") >= k, F.get("__phi", F.lit(k - 1)) * (F.col(f"__a{k}") - F.col("__m"))).otherwise(0.0)
    out = both.withColumn("fitted", fitted)
    return out.select(*keys, index, y, "fitted", (F.col(y) - F.col("fitted")).alias("resid"))


def tidy(fit: DataFrame, keys) -> DataFrame:
    """(keys, term, estimate) of an autoregression table."""
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.size("phi"), F.lit(1))), lambda k: F.concat(F.lit("ar"), k.cast("string")))
    ar = fit.filter(F.size("phi") > 0).select(*keys, F.explode(F.arrays_zip(names.alias("term"), F.col("phi").alias("estimate"))).alias("r")).select(*keys, "r.*")
    return ar.unionByName(fit.select(*keys, F.lit("mean").alias("term"), F.col("mean").alias("estimate")))


def resid_check(df, keys, index, resid: str, lags: int = 10, bins: int = 30) -> DataFrame:
    """Long table of residual autocorrelations, Ljung-Box, histogram and normal scores."""
    rows = df.filter(F.col(resid).isNotNull())
    a = acf(rows, keys, index, resid, lags).select(*keys, F.lit("acf").alias("kind"), F.col("lag").cast("double").alias("x"), F.col("acf").alias("value"))
    q = portmanteau(rows, keys, index, resid, lags).select(*keys, F.lit("ljung_box").alias("kind"), F.col("df").cast("double").alias("x"), F.col("ljung_box").alias("value"))
    hist = histogram(rows, resid, bins, keys).select(*keys, F.lit("histogram").alias("kind"), F.col("bin_start").alias("x"), F.col("n").cast("double").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(resid))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    qq = rows.select(*keys, F.lit("qq").alias("kind"), normal_score((rank - 0.5) / n).alias("x"), F.col(resid).alias("value"))
    return a.unionByName(q).unionByName(hist).unionByName(qq)


# Two-sided normal quantiles for 80 and 95 percent.
LEVELS = {80: 1.2815515655446004, 95: 1.959963984540054}


def intervals(fc: DataFrame, levels=(80, 95), lam: float | None = None) -> DataFrame:
    """Normal intervals; with ``lam`` everything is carried back to the data scale."""
    back = (lambda c: c) if lam is None else (lambda c: inv_box_cox(c, lam))
    cols = {}
    for level in levels:
        cols[f"lower_{level}"] = back(F.col("mean") - LEVELS[level] * F.col("sd"))
        cols[f"upper_{level}"] = back(F.col("mean") + LEVELS[level] * F.col("sd"))
    return fc.withColumns({**cols, "point": back(F.col("mean"))})


def naive_scale(train: DataFrame, keys, index, y) -> DataFrame:
    """(keys, scale): in-sample mean absolute step."""
    step = F.abs(F.col(y) - F.lag(y).over(along(keys, index)))
    return train.withColumn("__d", step).groupBy(*keys).agg(F.avg("__d").alias("scale"))


def scored(fc: DataFrame, actual: DataFrame, keys, index, y) -> DataFrame:
    """Forecasts beside actual values with error and CRPS of the normal distribution."""
    both = join_null_safe(fc, actual.select(*keys, index, F.col(y).alias("__y")), [*keys, index])
    e = F.col("__y") - F.col("mean")
    z = F.try_divide(e, F.col("sd"))
    crps = F.when(F.col("sd") > 0, F.col("sd") * (z * (2 * norm_cdf(z) - 1) + 2 * norm_pdf(z) - 1 / math.sqrt(math.pi))).otherwise(F.abs(e))
    return both.withColumns({"error": e, "crps": crps})


def accuracy(fc: DataFrame, actual: DataFrame, train: DataFrame, keys, index, y) -> DataFrame:
    """RMSE, MAE, MAPE, MASE and CRPS per key and model."""
    rows = join_null_safe(scored(fc, actual, keys, index, y), naive_scale(train, keys, index, y), keys)
    e = F.col("error")
    return rows.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.nullif(F.abs("__y"), F.lit(0.0))) * 100).alias("mape"),
        F.try_divide(F.avg(F.abs(e)), F.max("scale")).alias("mase"), F.avg("crps").alias("crps"))


def skill(acc: DataFrame, keys, benchmark: str) -> DataFrame:
    """1 - CRPS / CRPS of the benchmark model."""
    base = acc.filter(F.col("model") == benchmark).select(*keys, F.col("crps").alias("__base"))
    return join_null_safe(acc, base, keys).withColumn("skill", 1 - F.try_divide(F.col("crps"), F.col("__base"))).drop("__base")


def leaderboard(acc: DataFrame, level: str) -> DataFrame:
    """Mean metrics per hierarchy level and model in one pass; skill in percent."""
    metrics = [c for c in ("rmse", "mae", "mape", "mase", "crps") if c in acc.columns]
    extra = [(F.avg("skill") * 100).alias("skill_pct")] if "skill" in acc.columns else []
    return acc.groupBy(level, "model").agg(*[F.avg(m).alias(m) for m in metrics], *extra)
