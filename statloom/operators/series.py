"""Keyed series on a regular index: panels, autocorrelation, stationarity, decomposition.

Rows are summed to one line per (key, index) before any window runs, so a window holds
at most one line per calendar step of a key, however many rows the key has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.nulls import join_null_safe
from statloom.functions.scalars import box_cox
from statloom.functions.tails import chi2_p
from statloom.functions.vectors import vector_udf
from statloom.operators.linear import _fit, gram, unpack


def along(keys: list[str], index: str):
    return Window.partitionBy(*keys).orderBy(index)


def resample(df: DataFrame, keys: list[str], index: str, y: str, unit: str = "month") -> DataFrame:
    """Totals per calendar unit (day, month, quarter, year)."""
    return df.groupBy(*keys, F.to_date(F.date_trunc(unit, index)).alias(index)).agg(F.sum(y).alias(y))


def duplicates(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    return df.groupBy(*keys, index).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def checked(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The table itself when (keys, index) is unique; an error naming a clash otherwise."""
    clash = duplicates(df, keys, index).first()
    if clash is not None:
        raise ValueError(f"key and index are not unique: {clash.asDict()}")
    return df


def fill_gaps(df: DataFrame, keys: list[str], index: str, fill: dict[str, float], step: str = "1 day") -> DataFrame:
    """Every key on every step between the first and last index of the whole table."""
    span = df.agg(F.min(index).alias("__a"), F.max(index).alias("__b"))
    steps = span.select(F.explode(F.sequence("__a", "__b", F.expr(f"INTERVAL {step}"))).alias(index))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(steps))
    out = join_null_safe(grid, df, [*keys, index], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def autocov(df: DataFrame, keys: list[str], index: str, y: str, lags: int) -> DataFrame:
    """(keys, n, mean, c): c[k] = sum (y_t - m)(y_{t-k} - m) / n for k = 0..lags."""
    w = along(keys, index)
    means = df.groupBy(*keys).agg(F.avg(y).alias("__m"))
    rows = join_null_safe(df.select(*keys, index, F.col(y).alias("__y")), means, keys)
    rows = rows.withColumn("__e", F.col("__y") - F.col("__m"))
    rows = rows.select(*keys, "__m", "__e", *[F.lag("__e", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)])
    n = F.count("__e")
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.first("__m").alias("mean"),
        F.array(F.sum(F.col("__e") * F.col("__e")) / n,
                *[F.coalesce(F.sum(F.col("__e") * F.col(f"__l{k}")), F.lit(0.0)) / n for k in range(1, lags + 1)]).alias("c"))


def acf(df: DataFrame, keys: list[str], index: str, y: str, lags: int) -> DataFrame:
    """(keys, lag, acf, band) for lags 1..L; a constant series has none."""
    c = autocov(df, keys, index, y, lags).filter(F.col("c")[0] > 0)
    rows = c.select(*keys, "n", F.posexplode(F.transform("c", lambda v: v / F.col("c")[0])).alias("lag", "acf"))
    return rows.filter("lag > 0").withColumn("band", 1.96 / F.sqrt("n")).drop("n")


def _levinson(c) -> tuple[list[np.ndarray], list[float], list[float]]:
    """Coefficients, innovation variances and partial autocorrelations for orders 0..len(c)-1."""
    c = np.asarray(c, dtype=float)
    phi, v = np.zeros(0), c[0]
    coefs, variances, partial = [phi], [v], []
    for k in range(1, len(c)):
        a = (c[k] - phi @ c[k - 1:0:-1]) / v if v > 0 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        coefs.append(phi)
        variances.append(v)
        partial.append(a)
    return coefs, variances, partial


@vector_udf("array<double>")
def _pacf(c: pd.Series) -> pd.Series:
    return pd.Series([[float(v) for v in _levinson(x)[2]] for x in c])


def pacf(df: DataFrame, keys: list[str], index: str, y: str, lags: int) -> DataFrame:
    """(keys, lag, pacf, band)."""
    c = autocov(df, keys, index, y, lags).filter(F.col("c")[0] > 0)
    rows = c.select(*keys, "n", F.posexplode(_pacf("c")).alias("p", "pacf"))
    return rows.select(*keys, (F.col("p") + 1).alias("lag"), "pacf", (1.96 / F.sqrt("n")).alias("band"))


def lagged(df: DataFrame, keys: list[str], index: str, y: str, lags: int, prefix: str = "lag") -> DataFrame:
    w = along(keys, index)
    return df.withColumns({f"{prefix}{k}": F.lag(y, k).over(w) for k in range(1, lags + 1)})


def eacf(df: DataFrame, keys: list[str], index: str, y: str, ar_max: int = 7, ma_max: int = 7) -> DataFrame:
    """(keys, ar, ma, eacf, significant): extended autocorrelations for choosing orders.

    Autoregressions of all needed orders come from one lag Gramian per key; the
    autocorrelations of the filtered series follow from the autocovariances.
    """
    top = ar_max + ma_max + 1
    rows = lagged(df, keys, index, y, top)
    g = gram(rows, [F.lit(1.0), F.col(y), *[F.col(f"lag{k}") for k in range(1, top + 1)]], keys)
    c = autocov(df, keys, index, y, top + ar_max + 1).filter(F.col("c")[0] > 0)

    @vector_udf("array<struct<ar:int,ma:int,eacf:double,significant:boolean>>")
    def grid(n: pd.Series, c: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for size, cov, flat in zip(n, c, g):
            m, cov = unpack(flat), np.asarray(cov)
            fits = {}
            for k in range(1, top + 1):
                idx = [0, *range(2, k + 2)]
                fits[k] = np.linalg.lstsq(m[np.ix_(idx, idx)], m[idx, 1], rcond=None)[0][1:]
            cells = []
            for j in range(ma_max + 1):
                for k in range(ar_max + 1):
                    a = np.concatenate([[1.0], -fits[k][:k]]) if k else np.ones(1)
                    auto = lambda h: sum(a[p] * a[q] * cov[abs(h + p - q)] for p in range(len(a)) for q in range(len(a)))
                    r = auto(j + 1) / auto(0) if auto(0) > 0 else 0.0
                    cells.append({"ar": k, "ma": j, "eacf": float(r), "significant": bool(abs(r) > 2 / np.sqrt(max(size - k - j, 1)))})
                step = {}
                for k in range(1, top - j):
                    nxt, cur = fits[k + 1], fits[k]
                    ratio = nxt[k] / cur[k - 1] if abs(cur[k - 1]) > 1e-12 else 0.0
                    step[k] = nxt[:k] - np.concatenate([[-1.0], cur[:k - 1]]) * ratio
                fits = {**fits, **step}
            out.append(cells)
        return pd.Series(out)

    both = join_null_safe(c, g.select(*keys, "g"), keys)
    return both.select(*keys, F.explode(grid("n", "c", "g")).alias("r")).select(*keys, "r.*")


def portmanteau(df: DataFrame, keys: list[str], index: str, y: str, lags: int, fitted: int = 0) -> DataFrame:
    """Box-Pierce and Ljung-Box statistics over the first ``lags`` autocorrelations."""
    c = autocov(df, keys, index, y, lags).filter(F.col("c")[0] > 0)
    n = F.col("n")
    r2 = [F.pow(F.col("c")[k] / F.col("c")[0], F.lit(2.0)) for k in range(1, lags + 1)]
    bp = n * sum(r2[1:], r2[0])
    lb = n * (n + 2) * sum((r / (n - k) for k, r in enumerate(r2[1:], 2)), r2[0] / (n - 1))
    out = c.select(*keys, bp.alias("box_pierce"), lb.alias("ljung_box"), F.lit(lags - fitted).cast("bigint").alias("df"))
    return out.withColumns({"bp_p": chi2_p("box_pierce", F.col("df").cast("double")),
                            "lb_p": chi2_p("ljung_box", F.col("df").cast("double"))})


def boxcox_lambda(df: DataFrame, keys: list[str], index: str, y: str, order: int = 0, grid: list[float] | None = None) -> DataFrame:
    """(keys, lambda, loglik) of the best transformation; the series is filtered by an AR(order) first."""
    grid = grid or [round(-2 + 0.1 * i, 10) for i in range(41)]
    v = F.col(y)
    forms = F.explode(F.array(*[F.struct(F.lit(float(l)).alias("lambda"), box_cox(v, l).alias("z")) for l in grid]))
    rows = df.filter(v > 0).select(*keys, index, F.log(v).alias("__lg"), forms.alias("__f")).select(*keys, index, "__lg", "__f.*")
    groups = [*keys, "lambda"]
    if order == 0:
        fits = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum("__lg").alias("lg"), F.var_pop("z").alias("s2"))
    else:
        lag = lagged(rows, groups, index, "z", order)
        g = gram(lag, [F.lit(1.0), *[F.col(f"lag{k}") for k in range(1, order + 1)], F.col("z")], groups)
        jac = rows.groupBy(*groups).agg(F.sum("__lg").alias("lg"))
        fits = join_null_safe(g.withColumn("f", _fit("n", "w", "g")).select(*groups, "n", (F.col("f.rss") / F.col("n")).alias("s2")), jac, groups)
    ll = fits.withColumn("loglik", -F.col("n") / 2 * F.log("s2") + (F.col("lambda") - 1) * F.col("lg"))
    return ll.groupBy(*keys).agg(F.max_by("lambda", "loglik").alias("lambda"), F.max("loglik").alias("loglik"))


def kpss(df: DataFrame, keys: list[str], index: str, y: str) -> DataFrame:
    """(keys, n, lags, kpss): level-stationarity statistic with the short lag rule trunc(4 (n/100)^(1/4))."""
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).collect()[0]["n"]
    top = int(4 * (longest / 100) ** 0.25)  # lags that the longest series needs
    c = autocov(df, keys, index, y, top)
    rows = join_null_safe(df.select(*keys, index, F.col(y).alias("__y")), c.select(*keys, "mean"), keys)
    run = F.sum(F.col("__y") - F.col("mean")).over(along(keys, index).rowsBetween(Window.unboundedPreceding, 0))
    eta = rows.withColumn("__s", run).groupBy(*keys).agg(F.sum(F.col("__s") * F.col("__s")).alias("ss"))
    n = F.col("n")
    short = F.floor(4 * F.pow(n / 100, F.lit(0.25)))
    both = join_null_safe(c, eta, keys).withColumn("lags", short)
    s2 = F.col("c")[0] + 2 * sum(
        (F.when(F.col("lags") >= k, (1 - k / (F.col("lags") + 1)) * F.col("c")[k]).otherwise(0.0) for k in range(1, top + 1)), F.lit(0.0))
    return both.select(*keys, "n", "lags", F.when(s2 > 0, F.col("ss") / (n * n) / s2).alias("kpss"))


KPSS_5PCT = 0.463  # fixed value: 5 % critical value of the level statistic


def ndiffs(df: DataFrame, keys: list[str], index: str, y: str, most: int = 2, critical: float = KPSS_5PCT) -> DataFrame:
    """(keys, ndiffs): differences until the level statistic is below its critical value."""
    stats, cur = None, df.select(*keys, index, F.col(y).alias("__v"))
    for d in range(most):
        one = kpss(cur.filter(F.col("__v").isNotNull()), keys, index, "__v").select(*keys, F.col("kpss").alias(f"k{d}"))
        stats = one if stats is None else join_null_safe(stats, one, keys, "left")
        cur = cur.withColumn("__v", F.col("__v") - F.lag("__v").over(along(keys, index)))
    pick = F.lit(most)
    for d in reversed(range(most)):
        pick = F.when(F.coalesce(F.col(f"k{d}"), F.lit(0.0)) < critical, F.lit(d)).otherwise(pick)
    return stats.select(*keys, pick.alias("ndiffs"))


def subseries_means(df: DataFrame, keys: list[str], season: Column, y: str) -> DataFrame:
    return df.groupBy(*keys, season.alias("season")).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))


def series_display(df: DataFrame, keys: list[str], index: str, y: str, lags: int) -> DataFrame:
    """Values, autocorrelations and partial autocorrelations as one long table."""
    pos = F.row_number().over(along(keys, index))
    values = df.select(*keys, F.lit("value").alias("kind"), pos.alias("position"), F.col(y).alias("value"))
    a = acf(df, keys, index, y, lags).select(*keys, F.lit("acf").alias("kind"), F.col("lag").alias("position"), F.col("acf").alias("value"))
    p = pacf(df, keys, index, y, lags).select(*keys, F.lit("pacf").alias("kind"), F.col("lag").alias("position"), F.col("pacf").alias("value"))
    return values.unionByName(a).unionByName(p)


def decompose(df: DataFrame, keys: list[str], index: str, y: str, season: Column, period: int) -> DataFrame:
    """Additive parts: centred moving average, season means adjusted to sum to zero, remainder."""
    w, half = along(keys, index), period // 2
    v = F.col(y)
    if period % 2:
        frame = w.rowsBetween(-half, half)
        trend = F.when(F.count(v).over(frame) == period, F.avg(v).over(frame))
    else:
        left, right = w.rowsBetween(-half, half - 1), w.rowsBetween(-half + 1, half)
        trend = F.when(F.count(v).over(w.rowsBetween(-half, half)) == period + 1, (F.avg(v).over(left) + F.avg(v).over(right)) / 2)
    rows = df.withColumns({"trend": trend, "season": season})
    figure = rows.groupBy(*keys, "season").agg(F.avg(v - F.col("trend")).alias("__f"))
    every = Window.partitionBy(*keys)
    figure = figure.select(*keys, "season", (F.col("__f") - F.avg("__f").over(every)).alias("seasonal"))
    out = join_null_safe(rows, figure, [*keys, "season"])
    return out.withColumn("remainder", v - F.col("trend") - F.col("seasonal"))


def nsdiffs(df: DataFrame, keys: list[str], index: str, y: str, season: Column, period: int, critical: float = 0.64) -> DataFrame:
    """(keys, strength, nsdiffs): one seasonal difference when the season explains enough of the detrended variance."""
    parts = decompose(df, keys, index, y, season, period)
    s = parts.groupBy(*keys).agg(F.greatest(
        F.lit(0.0), 1 - F.var_samp("remainder") / F.var_samp(F.col("remainder") + F.when(F.col("remainder").isNotNull(), F.col("seasonal")))).alias("strength"))
    return s.withColumn("nsdiffs", (F.col("strength") > critical).cast("int"))
