"""Least squares, penalised paths and their diagnostics from one Gramian pass.

A fold column as grouping key turns the same pass into cross-validation: the training
Gramian of a fold is the total minus the fold's own, and its test error is a quadratic
form in the fold's own Gramian.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.ordered import long_values, quantiles_wide, weighted_quantiles
from statloom.functions.nulls import join_null_safe
from statloom.functions.scalars import regression_metrics, sse_metrics
from statloom.functions.tails import chi2_p, f_p, f_sf, t_p
from statloom.functions.vectors import vector_udf
from statloom.operators.linear import gram, least_squares, linear_predictor, pack, quadratic_form, unpack
from statloom.operators.windows import t_scores


# ---------------------------------------------------------------- splits

def fold_column(keys: list[str], folds: int = 10, seed: int = 1) -> Column:
    """Reproducible fold number of a row, from a hash of its key."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).cast("int")


def split_stratified(df: DataFrame, y: str, keys: list[str], share: float = 0.75, seed: int = 1) -> DataFrame:
    """Add ``part`` (quarter of the target) and ``train``: the ceil(share * n) smallest hashes of each part."""
    cuts = quantiles_wide(df, [y], {"c1": 0.25, "c2": 0.5, "c3": 0.75}).drop("variable")
    v = F.col(y)
    bin_no = sum(((v > F.col(c)).cast("int") for c in ("c1", "c2", "c3")), F.lit(1))
    rows = (df.crossJoin(F.broadcast(cuts)).withColumns({"part": bin_no, "__u": F.xxhash64(*keys, F.lit(seed)).cast("double")})
            .drop("c1", "c2", "c3"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select("part", ((F.ceil(F.col("n") * share) - 0.5) / F.col("n")).alias("prob"))
    edge = weighted_quantiles(long_values(rows, ["__u"], ["part"]), ["part"], wanted).select("part", F.col("q").alias("__edge"))
    return join_null_safe(rows, F.broadcast(edge), ["part"]).withColumn("train", F.col("__u") <= F.col("__edge")).drop("__u", "__edge")


# ---------------------------------------------------------------- least squares

def ols_fit(df: DataFrame, y: Column, cols: dict[str, Column], keys: list[str] = (), intercept: bool = True) -> DataFrame:
    xs = ([F.lit(1.0)] if intercept else []) + list(cols.values())
    return least_squares(df, y, xs, keys)


def terms_of(cols: dict[str, Column], intercept: bool = True) -> list[str]:
    return (["(Intercept)"] if intercept else []) + list(cols)


def ols(df: DataFrame, y: Column, cols: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """term, estimate, std_error, t, p_value (per group)."""
    fit = ols_fit(df, y, cols, keys)
    names = F.array(*[F.lit(n) for n in terms_of(cols)])
    rows = F.explode(F.arrays_zip(names.alias("term"), F.col("beta").alias("estimate"), F.col("se").alias("std_error")))
    out = fit.select(*keys, "df", rows.alias("r")).select(*keys, "r.*", "df")
    out = out.withColumn("t", F.col("estimate") / F.nullif(F.col("std_error"), F.lit(0.0)))
    return out.withColumn("p_value", t_p("t", F.col("df").cast("double"))).drop("df")


def _corner(i: int, j: int, size: int) -> Column:
    return F.col("g")[i * size - i * (i - 1) // 2 + j - i]


def ols_glance(df: DataFrame, y: Column, cols: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """n, r2, adj_r2, sigma, f, aic, bic (per group)."""
    fit = ols_fit(df, y, cols, keys)
    k, size = len(cols), len(cols) + 2
    n = F.col("n")
    sst = _corner(size - 1, size - 1, size) - F.pow(_corner(0, size - 1, size), F.lit(2.0)) / n
    r2 = 1 - F.try_divide(F.col("rss"), sst)
    minus2ll = n * (F.log(2 * F.lit(np.pi)) + 1 + F.log(F.col("rss") / n))
    return fit.select(*keys, "n", r2.alias("r2"), (1 - F.try_divide((1 - r2) * (n - 1), F.col("df"))).alias("adj_r2"),
                      F.sqrt("sigma2").alias("sigma"), F.try_divide((sst - F.col("rss")) / k, F.col("sigma2")).alias("f"),
                      (minus2ll + 2 * (k + 2)).alias("aic"), (minus2ll + F.log(n) * (k + 2)).alias("bic"))


def _rss(m: np.ndarray, idx: list[int]) -> float:
    a, b = m[np.ix_(idx, idx)], m[idx, -1]
    s = np.sqrt(np.maximum(np.diag(a), 1e-300))
    beta = np.linalg.lstsq(a / np.outer(s, s), b / s, rcond=None)[0] / s
    return float(max(m[-1, -1] - 2 * beta @ b + beta @ a @ beta, 0.0))


def anova_lm(df: DataFrame, y: Column, terms: dict[str, dict[str, Column]]) -> DataFrame:
    """Sequential sums of squares in the order of ``terms``, each a group of design columns."""
    cols = {n: c for group in terms.values() for n, c in group.items()}
    sizes = [len(g) for g in terms.values()]
    labels = list(terms)

    @vector_udf("array<struct<term:string,df:bigint,sum_sq:double,mean_sq:double,f:double,p_value:double>>")
    def table(n: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for count, flat in zip(n, g):
            m, idx, steps = unpack(flat), [0], []
            last = _rss(m, idx)
            for label, size in zip(labels, sizes):
                idx = idx + list(range(len(idx), len(idx) + size))
                rss = _rss(m, idx)
                steps.append((label, size, last - rss))
                last = rss
            rdf = int(count) - len(idx)
            ms = last / rdf
            out.append([{"term": t, "df": k, "sum_sq": ss, "mean_sq": ss / k, "f": ss / k / ms,
                         "p_value": f_sf(ss / k / ms, k, rdf)} for t, k, ss in steps]
                       + [{"term": "Residuals", "df": rdf, "sum_sq": last, "mean_sq": ms, "f": None, "p_value": None}])
        return pd.Series(out)

    packed = gram(df, [F.lit(1.0), *cols.values(), y])
    return packed.select(F.explode(table("n", "g")).alias("r")).select("r.*")


def nested_f(df: DataFrame, y: Column, small: dict[str, Column], big: dict[str, Column]) -> DataFrame:
    """F test of a model against a larger one that contains it."""
    extra = {n: c for n, c in big.items() if n not in small}
    table = anova_lm(df, y, {"small": small, "extra": extra})
    one = table.agg(F.max(F.when(F.col("term") == "extra", F.col("f"))).alias("f"),
                    F.max(F.when(F.col("term") == "extra", F.col("df"))).alias("df1"),
                    F.max(F.when(F.col("term") == "Residuals", F.col("df"))).alias("df2"))
    return one.withColumn("p_value", f_p("f", F.col("df1").cast("double"), F.col("df2").cast("double")))


def step_ols(df: DataFrame, y: Column, cols: dict[str, Column]) -> DataFrame:
    """Stepwise selection by AIC in both directions from the full model; no pass after the first."""
    names = list(cols)

    @vector_udf("array<struct<step:int,action:string,term:string,aic:double>>")
    def walk(n: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for count, flat in zip(n, g):
            m = unpack(flat)

            def aic(kept):
                return count * np.log(_rss(m, [0, *[i + 1 for i in kept]]) / count) + 2 * (len(kept) + 1)

            kept = list(range(len(names)))
            now, trace = aic(kept), [(0, "start", "", aic(kept))]
            while True:
                moves = [(aic([k for k in kept if k != j]), "drop", j) for j in kept]
                moves += [(aic(sorted([*kept, j])), "add", j) for j in range(len(names)) if j not in kept]
                best = min(moves, default=(np.inf, "", 0))
                if best[0] >= now - 1e-9:
                    break
                now = best[0]
                kept = [k for k in kept if k != best[2]] if best[1] == "drop" else sorted([*kept, best[2]])
                trace.append((len(trace), best[1], names[best[2]], now))
            trace += [(len(trace), "keep", names[k], now) for k in kept]
            out.append([{"step": s, "action": a, "term": t, "aic": float(v)} for s, a, t, v in trace])
        return pd.Series(out)

    return gram(df, [F.lit(1.0), *cols.values(), y]).select(F.explode(walk("n", "g")).alias("r")).select("r.*")


SINGULAR = 1e-12  # added to the diagonal of a correlation matrix so that repeated columns can be solved


def best_sets(g: np.ndarray, most: int) -> dict[int, tuple[int, ...]]:
    """The columns of smallest residual sum of squares for each size up to ``most``, by branch and bound.

    ``g`` holds correlations, the response last.  A node keeps some columns for good and may drop the others.  Dropping
    a set D costs at least its largest single cost, and at least the sum of the single costs divided by the
    largest eigenvalue of the scaled inverse of what may go; a branch ends when that cannot beat a known set of any
    size in its reach.  Exact at any width; the number of nodes depends on how alike the columns are.
    """
    width = len(g) - 1
    a, b, every = g[:-1, :-1] + SINGULAR * np.eye(width), g[:-1, -1], g[-1, -1]
    rss = np.full(width + 1, np.inf)
    known: dict[int, tuple[int, ...]] = {}

    def offer(kept, value):
        if 0 < len(kept) <= most and value < rss[len(kept)]:
            rss[len(kept)], known[len(kept)] = value, tuple(sorted(kept))

    todo = [(list(range(width)), 0, np.full(width + 1, -np.inf))]
    while todo:
        kept, fixed, low = todo.pop()
        reach = slice(max(fixed, 1), min(len(kept), most) + 1)
        if not np.any(low[reach] < rss[reach]):
            continue
        inverse = np.linalg.inv(a[np.ix_(kept, kept)])
        beta = inverse @ b[kept]
        here = every - b[kept] @ beta
        offer(kept, here)
        spread = np.sqrt(np.diag(inverse))
        free = np.arange(fixed, len(kept))
        cost = (beta[free] / spread[free]) ** 2
        order = np.argsort(-cost, kind="stable")
        free, cost = free[order], cost[order]
        if not len(free):
            continue
        scaled = inverse[np.ix_(free, free)] / np.outer(spread[free], spread[free])
        top = max(np.linalg.eigvalsh(scaled)[-1], 1.0)
        cheap = np.concatenate([[0.0], np.cumsum(cost[::-1])])  # cheap[k]: the k smallest costs
        for i, j in enumerate(free):
            rest = [kept[k] for k in range(fixed)] + [kept[k] for k in free[:i]] + [kept[k] for k in free[i + 1:]]
            offer(rest, here + cost[i])
            sizes = np.arange(len(kept) - 1, max(fixed + i, 1) - 1, -1)  # one, two, ... columns fewer
            if not len(sizes):
                continue
            low = np.full(width + 1, np.inf)
            low[sizes] = here + np.maximum(cost[i], (cost[i] + cheap[:len(sizes)]) / top)
            low[len(kept) - 1] = np.inf  # that set is known now
            if np.any(low[:most + 1] < rss[:most + 1]):
                todo.append((rest, fixed + i, low))
    return known


def best_subset(df: DataFrame, y: Column, cols: dict[str, Column], max_size: int = 16) -> DataFrame:
    """Best model of every size by residual sum of squares, searched on the Gramian by :func:`best_sets`."""
    names = list(cols)

    @vector_udf("array<struct<size:int,variables:string,rss:double,r2:double,adj_r2:double,bic:double>>")
    def search(n: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for count, flat in zip(n, g):
            m = unpack(flat)
            centred = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / count
            flatline = np.diag(centred) <= 1e-12 * np.maximum(np.diag(m)[1:], 1e-300)
            s = np.sqrt(np.where(flatline, 1.0, np.diag(centred)))
            z = np.where(flatline[:, None] | flatline[None, :], 0.0, centred / np.outer(s, s)) + np.diag(flatline * 1.0)
            sst, found = centred[-1, -1], []
            for size, kept in sorted(best_sets(z, min(max_size, len(names))).items()):
                rss = _rss(m, [0, *[i + 1 for i in kept]])
                r2 = 1 - rss / sst if sst > 0 else 0.0
                free = count - size - 1
                found.append({"size": size, "variables": ", ".join(names[i] for i in kept), "rss": rss, "r2": r2,
                              "adj_r2": 1 - (1 - r2) * (count - 1) / free if free > 0 else math.nan,
                              "bic": float(count * np.log(rss / sst) + (size + 1) * np.log(count)) if rss > 0 and sst > 0 else -math.inf})
            out.append(found)
        return pd.Series(out)

    return gram(df, [F.lit(1.0), *cols.values(), y]).select(F.explode(search("n", "g")).alias("r")).select("r.*")


# ---------------------------------------------------------------- cross-validation on fold Gramians

def fold_grams(df: DataFrame, y: Column, cols: dict[str, Column], fold: Column) -> DataFrame:
    """(fold, n_test, g_test, n_train, g_train); fold -1 holds all rows as training part."""
    own = gram(df.withColumn("__fold", fold), [F.lit(1.0), *cols.values(), y], ["__fold"])
    size = (len(cols) + 2) * (len(cols) + 3) // 2
    whole = own.agg(F.sum("n").alias("n_all"), F.array(*[F.sum(F.col("g")[i]) for i in range(size)]).alias("g_all"))
    left = F.zip_with("g_all", "g", lambda a, b: a - b)
    split = own.crossJoin(F.broadcast(whole)).select(
        F.col("__fold").alias("fold"), F.col("n").alias("n_test"), F.col("g").alias("g_test"),
        (F.col("n_all") - F.col("n")).alias("n_train"), left.alias("g_train"))
    every = whole.select(F.lit(-1).alias("fold"), F.lit(0).cast("bigint").alias("n_test"),
                         F.transform("g_all", lambda a: a * 0).alias("g_test"), F.col("n_all").alias("n_train"),
                         F.col("g_all").alias("g_train"))
    return split.unionByName(every)


def sub_grams(grams: DataFrame, count: int, keep: list[int]) -> DataFrame:
    """Fold Gramians of a subset of the ``count`` predictors: a selection of cells, no pass over rows."""
    size = count + 2
    idx = [0, *[i + 1 for i in keep], size - 1]
    cells = [i * size - i * (i - 1) // 2 + j - i for a, i in enumerate(idx) for j in idx[a:]]
    return grams.withColumns({c: F.array(*[F.col(c)[q] for q in cells]) for c in ("g_test", "g_train")})


def _centred(m: np.ndarray, n: float):
    mean = m[0, 1:] / n
    return mean[:-1], mean[-1], m[1:, 1:] / n - np.outer(mean, mean)


def _penalised_path(m: np.ndarray, n: float, lambdas, alpha: float) -> list[np.ndarray]:
    """Coefficients (intercept first) along decreasing penalties.

    Predictors are scaled to unit population variance.  The absolute penalty is on the
    response's own scale; the squared one is divided by the response's deviation, the
    convention of the usual path solvers and of Spark's own linear regression.
    """
    mx, my, c = _centred(m, n)
    sx = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
    live = sx > 1e-12 * np.maximum(np.abs(mx), 1.0)
    safe = np.where(live, sx, 1.0)
    a = c[:-1, :-1] / np.outer(safe, safe)
    r = np.where(live, c[:-1, -1] / safe, 0.0)
    sy = np.sqrt(max(c[-1, -1], 1e-300))
    order = np.argsort(-np.asarray(lambdas))
    beta, out = np.zeros(len(r)), [None] * len(lambdas)
    for pos in order:
        lam = lambdas[pos]
        l1, l2 = lam * alpha, lam * (1 - alpha) / sy
        if alpha == 0:
            beta = np.where(live, np.linalg.lstsq(a + l2 * np.eye(len(r)), r, rcond=None)[0], 0.0)
        else:
            for _ in range(10_000):
                change = 0.0
                for j in np.flatnonzero(live):
                    z = r[j] - a[j] @ beta + a[j, j] * beta[j]
                    new = np.sign(z) * max(abs(z) - l1, 0.0) / (a[j, j] + l2)
                    change = max(change, abs(new - beta[j]))
                    beta[j] = new
                if change <= 1e-11 * sy:
                    break
        b = beta / safe
        out[pos] = np.concatenate([[my - b @ mx], b])
    return out


def _test_sse(m: np.ndarray, coef: np.ndarray) -> float:
    v = np.append(-coef, 1.0)
    return float(max(v @ m @ v, 0.0))


def penalised(grams: DataFrame, lambdas: list[float], alpha: float) -> DataFrame:
    """(fold, lambda, coef, n_test, sse) for every fold and penalty; folds are solved in parallel."""
    lams = [float(v) for v in lambdas]

    @vector_udf("array<struct<lambda:double,coef:array<double>,sse:double>>")
    def path(n: pd.Series, g: pd.Series, test: pd.Series) -> pd.Series:
        out = []
        for count, flat, own in zip(n, g, test):
            own = unpack(own)
            out.append([{"lambda": l, "coef": b.tolist(), "sse": _test_sse(own, b)}
                        for l, b in zip(lams, _penalised_path(unpack(flat), count, lams, alpha))])
        return pd.Series(out)

    spread = grams.repartition("fold")
    return spread.select("fold", "n_test", F.explode(path("n_train", "g_train", "g_test")).alias("r")).select("fold", "n_test", "r.*")


def coefficient_path(df: DataFrame, y: Column, cols: dict[str, Column], lambdas: list[float], alpha: float) -> DataFrame:
    """(lambda, term, estimate) on all rows."""
    grams = fold_grams(df, y, cols, F.lit(0)).filter("fold = -1")
    names = F.array(*[F.lit(n) for n in terms_of(cols)])
    rows = F.explode(F.arrays_zip(names.alias("term"), F.col("coef").alias("estimate")))
    return penalised(grams, lambdas, alpha).select("lambda", rows.alias("r")).select("lambda", "r.*")


def cv_curve(solved: DataFrame, grams: DataFrame) -> DataFrame:
    """Per penalty: mean squared error over folds, its standard error, R2 against the response variance."""
    whole = grams.filter("fold = -1").select("n_train", F.col("g_train").alias("g"))
    last = F.element_at("g", -1)
    k = (F.sqrt(8 * F.size("g") + 1) - 1) / 2
    var_y = whole.select(((last - F.pow(F.get("g", k.cast("int") - 1), F.lit(2.0)) / F.col("n_train"))
                          / (F.col("n_train") - 1)).alias("var_y"))
    mse = F.col("sse") / F.col("n_test")
    cvm = F.sum("sse") / F.sum("n_test")
    second = F.sum(mse * mse * F.col("n_test")) / F.sum("n_test")
    out = solved.filter("fold >= 0").groupBy("lambda").agg(
        cvm.alias("cvm"), F.sqrt(F.greatest(second - cvm * cvm, F.lit(0.0)) / (F.count(F.lit(1)) - 1)).alias("cvsd"))
    return out.crossJoin(F.broadcast(var_y)).select("lambda", "cvm", "cvsd", (1 - F.col("cvm") / F.col("var_y")).alias("r2"))


def best_lambda(curve: DataFrame) -> DataFrame:
    return curve.agg(F.min_by("lambda", "cvm").alias("lambda"), F.min("cvm").alias("cvm"), F.max("r2").alias("r2"))


def best_refit(grams: DataFrame, cols: list[str], lambdas: list[float], alpha: float) -> DataFrame:
    """Coefficients on all rows at the penalty with the smallest CV error, largest first."""
    solved = penalised(grams, lambdas, alpha)
    best = best_lambda(cv_curve(solved, grams))
    names = F.array(*[F.lit(n) for n in ["(Intercept)", *cols]])
    rows = F.explode(F.arrays_zip(names.alias("term"), F.col("coef").alias("estimate")))
    chosen = solved.filter("fold = -1").join(F.broadcast(best.select("lambda")), "lambda")
    return chosen.select("lambda", rows.alias("r")).select("lambda", "r.*").orderBy(F.col("estimate").desc())


def relaxed(grams: DataFrame, cols: list[str], lambdas: list[float], alpha: float = 1.0, first: float = 1.0):
    """Select by a lasso fit, then cross-validate again on the selected columns only.

    Returns the kept names and the second coefficient table; both fits use the same Gramians.
    """
    table = best_refit(grams, cols, lambdas, first).filter((F.col("estimate") != 0) & (F.col("term") != "(Intercept)"))
    chosen = {r["term"] for r in table.collect()}  # at most as many names as design columns
    keep = [i for i, c in enumerate(cols) if c in chosen]
    kept = [cols[i] for i in keep]
    return kept, best_refit(sub_grams(grams, len(cols), keep), kept, lambdas, alpha)


def ols_cv(df: DataFrame, y: Column, cols: dict[str, Column], fold: Column) -> DataFrame:
    """Per fold: n, RMSE, squared-correlation R2 and MAE of the fit on the other folds."""
    rows = df.withColumn("fold", fold)
    solved = penalised(fold_grams(df, y, cols, fold), [0.0], 0.0).filter("fold >= 0").select("fold", "coef")
    xs = [F.lit(1.0), *cols.values()]
    pred = rows.join(F.broadcast(solved), "fold").select("fold", y.alias("y"), linear_predictor("coef", xs).alias("p"))
    return pred.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *regression_metrics(F.col("y"), F.col("p")))


def pcr_cv(grams: DataFrame, max_components: int) -> DataFrame:
    """Cross-validated RMSE by number of principal components of the unscaled predictors."""
    @vector_udf("array<struct<components:int,sse:double>>")
    def by_size(n: pd.Series, g: pd.Series, test: pd.Series) -> pd.Series:
        out = []
        for count, flat, own in zip(n, g, test):
            mx, my, c = _centred(unpack(flat), count)
            val, vec = np.linalg.eigh(c[:-1, :-1])
            val, vec = val[::-1], vec[:, ::-1]
            weight = np.where(val > 1e-12 * max(val[0], 1e-300), (vec.T @ c[:-1, -1]) / np.where(val > 0, val, 1.0), 0.0)
            own, errs = unpack(own), []
            for k in range(0, min(max_components, len(val)) + 1):
                b = vec[:, :k] @ weight[:k]
                errs.append({"components": k, "sse": _test_sse(own, np.concatenate([[my - b @ mx], b]))})
            out.append(errs)
        return pd.Series(out)

    rows = grams.filter("fold >= 0").repartition("fold")
    cells = rows.select("n_test", F.explode(by_size("n_train", "g_train", "g_test")).alias("r")).select("n_test", "r.*")
    return cells.groupBy("components").agg(F.sqrt(F.sum("sse") / F.sum("n_test")).alias("rmsep"))


# ---------------------------------------------------------------- diagnostics

def metrics(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    return df.agg(*regression_metrics(actual, predicted))


def metrics_sse(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    return df.agg(*sse_metrics(actual, predicted))


def error_profile(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Bias mean and median, largest, mean and median absolute deviation, MSE."""
    rows = df.select((predicted - actual).alias("bias"), F.abs(predicted - actual).alias("size"))
    one = rows.agg(F.avg("bias").alias("bias_mean"), F.max("size").alias("max_abs"), F.avg("size").alias("mean_abs"),
                   F.avg(F.col("bias") * F.col("bias")).alias("mse"))
    mid = quantiles_wide(rows, ["bias", "size"], {"m": 0.5}).agg(
        F.max(F.when(F.col("variable") == "bias", F.col("m"))).alias("bias_median"),
        F.max(F.when(F.col("variable") == "size", F.col("m"))).alias("median_abs"))
    return one.crossJoin(F.broadcast(mid))


def baseline_mse(train: DataFrame, test: DataFrame, y: Column, predicted: Column) -> DataFrame:
    """Test MSE of the training mean beside that of a prediction."""
    mean = train.agg(F.avg(y).alias("__m"))
    rows = test.select(y.alias("__y"), predicted.alias("__p")).crossJoin(F.broadcast(mean))
    return rows.agg(F.avg((F.col("__m") - F.col("__y")) ** 2).alias("baseline_mse"),
                    F.avg((F.col("__p") - F.col("__y")) ** 2).alias("model_mse"))


def _inflation(c: np.ndarray, s: np.ndarray) -> list:
    """Diagonal of the inverse correlation matrix; null for a constant predictor and for one that the others determine."""
    live = np.flatnonzero(s > 0)
    out: list = [None] * len(s)
    if len(live):
        r = (c / np.outer(np.where(s > 0, s, 1.0), np.where(s > 0, s, 1.0)))[np.ix_(live, live)]
        value, vector = np.linalg.eigh(r)
        small = value < 1e-10
        tied = (vector[:, small] ** 2).sum(1) > 1e-8
        factor = (vector[:, ~small] ** 2 / value[~small]).sum(1)
        for j, v, t in zip(live, factor, tied):
            out[j] = None if t else float(v)
    return out


def vif(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Diagonal of the inverse correlation matrix."""
    @vector_udf("array<double>")
    def inflate(n: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for count, flat in zip(n, g):
            m = unpack(flat)
            mean = m[0, 1:] / count
            c = m[1:, 1:] / count - np.outer(mean, mean)
            s = np.sqrt(np.diag(c))
            out.append(_inflation(c, s))
        return pd.Series(out)

    names = F.array(*[F.lit(n) for n in cols])
    packed = gram(df, [F.lit(1.0), *cols.values()]).withColumn("v", inflate("n", "g"))
    return packed.select(F.explode(F.arrays_zip(names.alias("term"), F.col("v").alias("vif"))).alias("r")).select("r.*")


def with_fit(df: DataFrame, y: Column, cols: dict[str, Column]) -> DataFrame:
    """Rows with fitted value, residual, hat value, standardised residual and Cook's distance."""
    fit = ols_fit(df, y, cols).select(F.col("beta").alias("__beta"), F.col("inv").alias("__inv"), F.col("sigma2").alias("__s2"),
                                      F.col("n").alias("__n"))
    xs = [F.lit(1.0), *[c.cast("double") for c in cols.values()]]
    p = len(xs)
    rows = df.crossJoin(F.broadcast(fit)).withColumn("fitted", linear_predictor("__beta", xs))
    rows = rows.withColumns({"resid": y - F.col("fitted"), "hat": quadratic_form("__inv", xs)})
    h = F.col("hat")
    return rows.withColumns({
        "std_resid": F.try_divide(F.col("resid"), F.sqrt(F.col("__s2") * (1 - h))),
        "cook": F.try_divide(F.col("resid") * F.col("resid") * h, p * F.col("__s2") * (1 - h) * (1 - h)),
        "n_rows": F.col("__n")}).drop("__beta", "__inv", "__s2", "__n")


def influence(df: DataFrame, y: Column, cols: dict[str, Column]) -> DataFrame:
    """Rows above 4/n in Cook's distance or 2p/n in hat value, with both flags."""
    p = len(cols) + 1
    rows = with_fit(df, y, cols)
    flags = rows.withColumns({"high_cook": F.col("cook") > 4 / F.col("n_rows"), "high_hat": F.col("hat") > 2 * p / F.col("n_rows")})
    return flags.filter(F.col("high_cook") | F.col("high_hat"))


def resid_diag(df: DataFrame, y: Column, cols: dict[str, Column]) -> DataFrame:
    return with_fit(df, y, cols).withColumn("root_abs", F.sqrt(F.abs("std_resid")))


def breusch_pagan(df: DataFrame, y: Column, cols: dict[str, Column], studentize: bool = True) -> DataFrame:
    """n R2 of the squared residuals on the predictors, with df and p."""
    rows = with_fit(df, y, cols)
    e2 = F.col("resid") * F.col("resid")
    if studentize:
        out = ols_glance(rows, e2, cols).select((F.col("n") * F.col("r2")).alias("statistic"))
    else:
        scaled = rows.crossJoin(F.broadcast(rows.agg(F.avg(e2).alias("__v"))))
        size = len(cols) + 2
        fit = ols_fit(scaled, e2 / F.col("__v"), cols)
        sst = _corner(size - 1, size - 1, size) - F.pow(_corner(0, size - 1, size), F.lit(2.0)) / F.col("n")
        out = fit.select(((sst - F.col("rss")) / 2).alias("statistic"))
    out = out.withColumn("df", F.lit(len(cols)).cast("bigint"))
    return out.withColumn("p_value", chi2_p("statistic", F.col("df").cast("double")))


@vector_udf("mean array<double>, inv array<double>")
def _mean_and_precision(n: pd.Series, g: pd.Series) -> pd.DataFrame:
    out = []
    for count, flat in zip(n, g):
        m = unpack(flat)
        mean = m[0, 1:] / count
        cov = (m[1:, 1:] - count * np.outer(mean, mean)) / (count - 1)
        out.append((mean.tolist(), pack(np.linalg.pinv(cov, hermitian=True))))
    return pd.DataFrame(out, columns=["mean", "inv"])


def mahalanobis(df: DataFrame, cols: list[str]) -> DataFrame:
    """Squared distance ``d2`` to the mean under the covariance, and its t-score."""
    packed = gram(df, [F.lit(1.0), *[F.col(c) for c in cols]])
    one = packed.withColumn("s", _mean_and_precision("n", "g")).select(
        F.col("s.mean").alias("__mean"), F.col("s.inv").alias("__inv"))
    diffs = [F.col(c) - F.col("__mean")[i] for i, c in enumerate(cols)]
    rows = df.crossJoin(F.broadcast(one)).withColumn("d2", quadratic_form("__inv", diffs)).drop("__mean", "__inv")
    return t_scores(rows, "d2", "d2_t")
