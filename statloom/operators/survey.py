"""Estimates from stratified, clustered, weighted samples by Taylor linearisation.

Rows are read once and reduced to weighted sums per (group, stratum, cluster).  A
domain is an indicator, never a filter, so clusters without domain rows still count.
Every variance is then ``sum_h n_h/(n_h-1) * (sum t^2 - (sum t)^2/n_h)`` over the
cluster totals ``t`` of a linearised score.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product as pairs_of
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.nulls import join_null_safe
from statloom.functions.ordered import long_values, weighted_quantiles
from statloom.functions.scalars import INV_SQRT_2PI, expit, logit
from statloom.functions.tails import f_p, t_p, z_p
from statloom.functions.vectors import vector_udf
from statloom.operators import logits
from statloom.operators.linear import gram, pack, unpack
from statloom.operators.recode import levels_of
from statloom.operators.tabulate import add_share, histogram

Z95 = 1.959963984540054


@dataclass(frozen=True)
class SurveyDesign:
    """Column roles.  Cluster ids are nested in their stratum."""

    strata: str
    psu: str
    weight: str
    single: str = "fail"  # a stratum with one cluster: "fail", or "skip" its contribution


def _domain(domain: Column | None) -> Column:
    return F.lit(True) if domain is None else F.coalesce(domain, F.lit(False))


def cluster_sums(df: DataFrame, design: SurveyDesign, sums: dict[str, Column], by: list[str] = (),
                 domain: Column | None = None) -> DataFrame:
    """Weighted sums per (by, stratum, cluster); ``sums`` are unweighted row values, null rows count as outside."""
    inside = _domain(domain)
    for c in sums.values():
        inside = inside & c.isNotNull()
    w = F.when(inside, F.col(design.weight).cast("double")).otherwise(0.0)
    return df.groupBy(*by, F.col(design.strata).alias("__h"), F.col(design.psu).alias("__c")).agg(
        F.sum(w).alias("a0"), F.sum(F.when(inside, 1).otherwise(0)).alias("n0"),
        *[F.sum(F.when(inside, F.col(design.weight) * c).otherwise(0.0)).alias(f"a_{n}") for n, c in sums.items()])


def cluster_counts(clusters: DataFrame) -> DataFrame:
    return clusters.select("__h", "__c").distinct().groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))


def _stratum_factor(design: SurveyDesign) -> Column:
    n = F.col("__n")
    alone = (F.raise_error(F.lit("a stratum has a single cluster")).cast("double")
             if design.single == "fail" else F.lit(0.0))
    return F.when(n > 1, n / (n - 1)).otherwise(alone)


def linearised(clusters: DataFrame, design: SurveyDesign, by: list[str], estimates: Callable, scores: Callable) -> DataFrame:
    """Totals per group, ``estimates`` on them, and ``var_*`` of the cluster ``scores``.

    ``estimates`` and ``scores`` are functions without arguments that return
    name -> Column over the group totals (``t_*``) and cluster sums (``a*``).
    """
    by = list(by)
    parts = [c for c in clusters.columns if c == "a0" or c == "n0" or c.startswith("a_")]
    totals = clusters.groupBy(*by).agg(*[F.sum(c).alias(f"t_{c}") for c in parts])
    totals = totals.filter(F.col("t_a0") > 0)
    est = estimates()
    for name, expr in est.items():
        totals = totals.withColumn(name, expr)
    rows = join_null_safe(clusters, totals, by)
    sc = scores()
    names = list(sc)
    strata = rows.withColumns({f"z_{n}": sc[n] for n in names}).groupBy(*by, "__h").agg(
        *[F.sum(f"z_{n}").alias(f"s_{n}") for n in names],
        *[F.sum(F.col(f"z_{n}") * F.col(f"z_{n}")).alias(f"q_{n}") for n in names])
    factor = _stratum_factor(design)
    strata = join_null_safe(strata, cluster_counts(clusters), ["__h"])
    var = strata.groupBy(*by).agg(*[
        F.sum(factor * (F.col(f"q_{n}") - F.col(f"s_{n}") * F.col(f"s_{n}") / F.col("__n"))).alias(f"var_{n}")
        for n in names])
    return join_null_safe(totals, var, by)


def svy_design(df: DataFrame, design: SurveyDesign) -> DataFrame:
    """Rows, weight total, strata, clusters, degrees of freedom, smallest stratum."""
    clusters = df.groupBy(F.col(design.strata).alias("__h"), F.col(design.psu).alias("__c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(design.weight).cast("double").alias("w"))
    strata = clusters.groupBy("__h").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    return strata.agg(F.sum("n").alias("n_rows"), F.sum("w").alias("sum_weights"), F.count(F.lit(1)).alias("n_strata"),
                      F.sum("c").alias("n_psu"), (F.sum("c") - F.count(F.lit(1))).alias("design_df"),
                      F.min("c").alias("min_psu"))


def svy_mean(df: DataFrame, design: SurveyDesign, y: Column, by: list[str] = (), domain: Column | None = None) -> DataFrame:
    """(by, n, mean, se, cv, variance, var_se, deff) from one pass over the rows."""
    y = y.cast("double")
    clusters = cluster_sums(df, design, {"y": y, "yy": y * y}, by, domain)
    n, w = F.col("t_n0"), F.col("t_a0")

    def estimates():
        mean = F.try_divide(F.col("t_a_y"), w)
        return {"mean": mean,
                "variance": F.try_divide(n, n - 1) * (F.try_divide(F.col("t_a_yy"), w) - F.col("mean") * F.col("mean"))}

    def scores():
        m = F.col("mean")
        centred = F.col("a_yy") - 2 * m * F.col("a_y") + m * m * F.col("a0")
        return {"mean": F.try_divide(F.col("a_y") - m * F.col("a0"), w),
                "variance": F.try_divide(F.try_divide(centred * n, n - 1) - F.col("variance") * F.col("a0"), w)}

    out = linearised(clusters, design, by, estimates, scores)
    srs = F.try_divide(F.col("variance") * (1 - F.try_divide(n, w)), n)
    return out.select(*by, n.alias("n"), "mean", F.sqrt("var_mean").alias("se"),
                      F.try_divide(F.sqrt("var_mean"), F.col("mean")).alias("cv"), "variance",
                      F.sqrt("var_variance").alias("var_se"), F.try_divide(F.col("var_mean"), srs).alias("deff"))


def svy_table(df: DataFrame, design: SurveyDesign, cols: list[str], domain: Column | None = None) -> DataFrame:
    """Weighted counts and shares by 1-3 factors."""
    w = F.when(_domain(domain), F.col(design.weight).cast("double")).otherwise(0.0)
    return add_share(df.dropna(subset=cols).groupBy(*cols).agg(F.sum(w).alias("n")))


def svy_ciprop(df: DataFrame, design: SurveyDesign, flag: Column, by: list[str] = (), domain: Column | None = None,
               z: float = Z95) -> DataFrame:
    """Proportion with an interval built on the logit scale."""
    m = svy_mean(df, design, flag.cast("double"), by, domain)
    p = F.col("mean")
    half = F.try_divide(z * F.col("se"), p * (1 - p))
    return m.select(*by, p.alias("proportion"), "se", expit(logit(p) - half).alias("ci_low"),
                    expit(logit(p) + half).alias("ci_high"))


def svy_ttest(df: DataFrame, design: SurveyDesign, y: Column, group: Column, domain: Column | None = None) -> DataFrame:
    """Difference of two domain means (group true minus false) with t and degrees of freedom."""
    y = y.cast("double")
    g = group.cast("double")
    clusters = cluster_sums(df, design, {"y": y, "g": g, "gy": g * y}, (), domain)

    def estimates():
        return {"mean1": F.col("t_a_gy") / F.col("t_a_g"),
                "mean0": (F.col("t_a_y") - F.col("t_a_gy")) / (F.col("t_a0") - F.col("t_a_g"))}

    def scores():
        one = (F.col("a_gy") - F.col("mean1") * F.col("a_g")) / F.col("t_a_g")
        zero = (F.col("a_y") - F.col("a_gy") - F.col("mean0") * (F.col("a0") - F.col("a_g"))) / (F.col("t_a0") - F.col("t_a_g"))
        return {"diff": one - zero}

    counts = cluster_counts(clusters).agg((F.sum("__n") - F.count(F.lit(1)) - 1).alias("df"))
    out = linearised(clusters, design, [], estimates, scores).crossJoin(F.broadcast(counts))
    diff = F.col("mean1") - F.col("mean0")
    out = out.select("mean1", "mean0", diff.alias("difference"), F.sqrt("var_diff").alias("se"),
                     (diff / F.sqrt("var_diff")).alias("t"), "df")
    return out.withColumn("p_value", t_p("t", F.col("df").cast("double")))


def svy_ttest_one(df: DataFrame, design: SurveyDesign, y: Column, mu: float = 0.0, domain: Column | None = None) -> DataFrame:
    """Test of one domain mean against ``mu``: mean, se, t, degrees of freedom (clusters less strata) and p."""
    mean = svy_mean(df, design, y, (), domain).select("mean", "se")
    counts = svy_design(df, design).select((F.col("n_psu") - F.col("n_strata")).alias("df"))
    out = mean.crossJoin(F.broadcast(counts))  # one row each
    out = out.select("mean", "se", F.try_divide(F.col("mean") - mu, F.col("se")).alias("t"), "df")
    return out.withColumn("p_value", t_p("t", F.col("df").cast("double")))


@vector_udf("wald double, k bigint")
def _wald(y: pd.Series, v: pd.Series) -> pd.DataFrame:
    stats = []
    for a, b in zip(y, v):
        vec = np.asarray(a, dtype=float)
        stats.append((float(vec @ np.linalg.solve(unpack(b), vec)), len(vec)))
    return pd.DataFrame(stats, columns=["wald", "k"])


def stratified_cov(clusters: DataFrame, design: SurveyDesign, scores: list[Column]) -> DataFrame:
    """Packed covariance matrix (one row, column ``v``) of a vector of cluster scores."""
    k = len(scores)
    flat = [f"__z{i}" for i in range(k)]
    z = clusters.select("__h", "__c", *[s.alias(f) for s, f in zip(scores, flat)])
    per = gram(z, [F.lit(1.0), *[F.col(f) for f in flat]], ["__h"])
    per = join_null_safe(per, cluster_counts(clusters), ["__h"])
    factor, size = _stratum_factor(design), k + 1

    def at(i, j):
        return F.col("g")[i * size - i * (i - 1) // 2 + (j - i)]

    cells = [F.sum(factor * (at(i + 1, j + 1) - at(0, i + 1) * at(0, j + 1) / F.col("__n")))
             for i in range(k) for j in range(i, k)]
    return per.agg(F.array(*cells).alias("v"))


def svy_chisq(df: DataFrame, design: SurveyDesign, a: str, b: str, domain: Column | None = None) -> DataFrame:
    """Adjusted Wald test that p_ij = p_i. p_.j, from the covariance of the departures."""
    ra, cb = levels_of(df, a), levels_of(df, b)
    rows = df.dropna(subset=[a, b])
    cells = {(i, j): ((F.col(a) == x) & (F.col(b) == y)).cast("double")
             for (i, x), (j, y) in pairs_of(enumerate(ra), enumerate(cb))}
    clusters = cluster_sums(rows, design, {f"{i}_{j}": c for (i, j), c in cells.items()}, (), domain)
    whole = clusters.agg(F.sum("a0").alias("__w"), *[F.sum(f"a_{i}_{j}").alias(f"t_{i}_{j}") for i, j in cells])
    rows = clusters.crossJoin(F.broadcast(whole))
    w, r, c = F.col("__w"), range(len(ra)), range(len(cb))

    def total(p, i=None, j=None):
        return sum((F.col(f"{p}_{x}_{y}") for x in (r if i is None else [i]) for y in (c if j is None else [j])), F.lit(0.0))

    def share(*ij):
        return total("t", *ij) / w

    def dev(i=None, j=None):
        return (total("a", i, j) - share(i, j) * F.col("a0")) / w

    inner = [(i, j) for i in r[:-1] for j in c[:-1]]
    scores = [dev(i, j) - share(None, j) * dev(i, None) - share(i, None) * dev(None, j) for i, j in inner]
    y = whole.select(F.array(*[share(i, j) - share(i, None) * share(None, j) for i, j in inner]).alias("y"))
    d = cluster_counts(clusters).agg((F.sum("__n") - F.count(F.lit(1))).alias("design_df"))
    out = (y.crossJoin(stratified_cov(rows, design, scores)).crossJoin(d)
           .withColumn("s", _wald("y", "v")).select("s.*", "design_df"))
    adj = F.col("wald") * (F.col("design_df") - F.col("k") + 1) / (F.col("k") * F.col("design_df"))
    out = out.withColumns({"f": adj, "df2": F.col("design_df") - F.col("k") + 1})
    return out.withColumn("p_value", f_p("f", F.col("k").cast("double"), F.col("df2").cast("double")))


@vector_udf("beta array<double>, inv array<double>")
def _wls(g: pd.Series) -> pd.DataFrame:
    out = []
    for flat in g:
        m = unpack(flat)
        inv = np.linalg.inv(m[:-1, :-1])
        out.append(((inv @ m[:-1, -1]).tolist(), pack(inv)))
    return pd.DataFrame(out, columns=["beta", "inv"])


@vector_udf("array<double>")
def _sandwich_se(inv: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([np.sqrt(np.diag(unpack(i) @ unpack(m) @ unpack(i))).tolist() for i, m in zip(inv, v)])


def _coef_table(one: DataFrame, names: list[str]) -> DataFrame:
    rows = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("term"),
                                  F.col("beta").alias("estimate"), F.col("se").alias("std_error")))
    out = one.select(rows.alias("r")).select("r.*")
    out = out.withColumn("statistic", F.col("estimate") / F.col("std_error"))
    return out.withColumn("p_value", z_p("statistic"))


def svy_lm(df: DataFrame, design: SurveyDesign, y: Column, cols: dict[str, Column], domain: Column | None = None) -> DataFrame:
    """Weighted least squares with design-based standard errors, in one pass.

    Cross products are kept per cluster, so the cluster scores X'W(y - Xb) follow without a second read.
    """
    xs = [c.cast("double") for c in cols.values()]
    p = len(xs)
    w = F.when(_domain(domain), F.col(design.weight).cast("double")).otherwise(0.0)
    rows = df.withColumns({"__h": F.col(design.strata), "__c": F.col(design.psu)})
    clusters = gram(rows, [*xs, y], ["__h", "__c"], w)
    size = p + 1
    pos = lambda i, j: min(i, j) * size - min(i, j) * (min(i, j) - 1) // 2 + abs(i - j)
    fit = clusters.agg(F.array(*[F.sum(F.col("g")[q]) for q in range(size * (size + 1) // 2)]).alias("g_all"))
    fit = fit.withColumn("f", _wls("g_all")).select("f.*")
    scored = clusters.crossJoin(F.broadcast(fit))
    scores = [F.col("g")[pos(i, p)] - sum((F.col("g")[pos(i, j)] * F.col("beta")[j] for j in range(p)), F.lit(0.0))
              for i in range(p)]
    meat = stratified_cov(scored, design, scores)
    return _coef_table(fit.crossJoin(meat).withColumn("se", _sandwich_se("inv", "v")), list(cols))


def svy_logit(df: DataFrame, design: SurveyDesign, flag: Column, cols: dict[str, Column],
              domain: Column | None = None) -> DataFrame:
    """Weighted logistic regression on distinct patterns; sandwich errors from one more pass at the fitted coefficients.

    ``cols`` holds the predictors without the intercept.
    """
    names = [f"__x{i}" for i in range(len(cols))]
    w = F.when(_domain(domain), F.col(design.weight).cast("double")).otherwise(0.0)
    rows = df.select(F.col(design.strata).alias("__h"), F.col(design.psu).alias("__c"), w.alias("__w"),
                     flag.cast("double").alias("__y"),
                     *[c.cast("double").alias(n) for n, c in zip(names, cols.values())]).dropna()
    lines = logits.patterns(rows, F.col("__y"), [F.col(n) for n in names], F.col("__w")).persist()
    beta = [float(b) for b in logits.fit_all(lines, len(names), [list(range(len(names)))])[0].beta]
    lines.unpersist()
    xs = [F.lit(1.0), *[F.col(n) for n in names]]
    eta = sum((F.lit(b) * x for b, x in zip(beta, xs)), F.lit(0.0))
    mu = expit(eta)
    clusters = rows.groupBy("__h", "__c").agg(
        *[F.sum(F.col("__w") * x * (F.col("__y") - mu)).alias(f"u{i}") for i, x in enumerate(xs)],
        *[F.sum(F.col("__w") * mu * (1 - mu) * xs[i] * xs[j]).alias(f"i{i}_{j}")
          for i in range(len(xs)) for j in range(i, len(xs))])
    info = clusters.agg(F.array(*[F.sum(f"i{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]).alias("info"))
    meat = stratified_cov(clusters, design, [F.col(f"u{i}") for i in range(len(xs))])
    one = info.crossJoin(meat).select(_invert("info").alias("inv"), "v",
                                      F.array(*[F.lit(b) for b in beta]).alias("beta"))
    return _coef_table(one.withColumn("se", _sandwich_se("inv", "v")), ["(Intercept)", *cols])


@vector_udf("array<double>")
def _invert(m: pd.Series) -> pd.Series:
    return pd.Series([pack(np.linalg.inv(unpack(x))) for x in m])


def _weighted_values(df, design, y, by, domain):
    w = F.when(_domain(domain), F.col(design.weight).cast("double")).otherwise(0.0)
    rows = df.select(*by, y.cast("double").alias("y"), w.alias("__wt")).filter("__wt > 0")
    return long_values(rows, ["y"], by, F.col("__wt"))


def svy_quantile(df: DataFrame, design: SurveyDesign, y: Column, probs: list[float], by: list[str] = (),
                 domain: Column | None = None, ci: bool = False, z: float = Z95) -> DataFrame:
    """Weighted quantiles (smallest value reaching the share).

    With ``ci`` the interval inverts the distribution function at ``p -/+ z * se(F(q))``.
    """
    by = list(by)
    values = _weighted_values(df, design, y, by, domain)
    points = weighted_quantiles(values, by, probs)
    if not ci:
        return points
    if by:
        raise ValueError("intervals are per domain: pass the group as a domain")
    found = {r["prob"]: r["q"] for r in points.collect()}  # one row per requested probability
    flags = {f"q{i}": (y <= F.lit(found[p])).cast("double") for i, p in enumerate(probs)}
    clusters = cluster_sums(df, design, flags, (), domain)
    one = linearised(
        clusters, design, [],
        lambda: {f"f_{n}": F.col(f"t_a_{n}") / F.col("t_a0") for n in flags},
        lambda: {n: (F.col(f"a_{n}") - F.col(f"f_{n}") * F.col("a0")) / F.col("t_a0") for n in flags})
    wanted = one.select(F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("target"), F.lit(found[p]).alias("estimate"),
                 F.lit(side).alias("side"),
                 F.least(F.greatest(F.lit(float(p)) + s * z * F.sqrt(f"var_q{i}"), F.lit(0.0)), F.lit(1.0)).alias("prob"))
        for i, p in enumerate(probs) for side, s in (("low", -1), ("high", 1))])).alias("r")).select("r.*")
    ends = weighted_quantiles(values, [], wanted)
    return ends.groupBy(F.col("target").alias("prob"), F.col("estimate").alias("q")).agg(
        F.max(F.when(F.col("side") == "low", F.col("q"))).alias("ci_low"),
        F.max(F.when(F.col("side") == "high", F.col("q"))).alias("ci_high"))


def svy_boxstats(df: DataFrame, design: SurveyDesign, y: Column, by: list[str] = (), domain: Column | None = None) -> DataFrame:
    """Weighted five numbers and the number of rows beyond 1.5 IQR of the box."""
    by = list(by)
    q = svy_quantile(df, design, y, [0.0, 0.25, 0.5, 0.75, 1.0], by, domain)
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    box = q.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n) for p, n in names.items()])
    inside = _domain(domain) & (F.col(design.weight) > 0) & y.isNotNull()
    rows = df.filter(inside).select(*by, y.cast("double").alias("__y"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col("__y") < F.col("q1") - fence) | (F.col("__y") > F.col("q3") + fence)
    return join_null_safe(rows, box, by).groupBy(*by, *names.values()).agg(F.count_if(out).alias("n_outliers"))


def svy_density(df: DataFrame, design: SurveyDesign, y: Column, bandwidth: float, grid: int = 101,
                domain: Column | None = None, bins: int = 401) -> DataFrame:
    """Weighted Gaussian kernel density on an even grid; rows are binned first, so the
    grid meets at most ``bins`` points."""
    w = F.when(_domain(domain), F.col(design.weight).cast("double")).otherwise(0.0)
    rows = df.select(y.cast("double").alias("y"), w.alias("w")).filter("w > 0")
    binned = histogram(rows, "y", bins, (), F.col("w"))
    ends = rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    span = F.col("hi") - F.col("lo")
    points = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    points = points.select("i", (F.col("lo") + span * F.col("i") / (grid - 1)).alias("x"), (span / bins).alias("bw"))
    u = (F.col("x") - (F.col("bin_start") + F.col("bw") / 2)) / bandwidth
    return binned.crossJoin(F.broadcast(points)).groupBy("i", "x").agg(
        (F.sum(F.col("n") * INV_SQRT_2PI * F.exp(-u * u / 2)) / (F.sum("n") * bandwidth)).alias("density"))
