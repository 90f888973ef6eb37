"""Logistic models and their searches; trees fitted by pyspark.ml; forests; mixtures by number of classes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators import forests, logits, mixtures
from statloom.operators.regress import fold_column
from statloom.operators.tabulate import confusion


def assemble(df: DataFrame, cols: dict[str, Column], keep: dict[str, Column]) -> DataFrame:
    """``keep`` columns beside a ``features`` vector of the design columns."""
    names = [f"__f{i}" for i in range(len(cols))]
    rows = df.select(*[c.alias(n) for n, c in keep.items()],
                     *[c.cast("double").alias(n) for n, c in zip(names, cols.values())]).dropna(subset=names)
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names)


def _local(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Coefficient-sized table."""
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- logistic

def logistic(df: DataFrame, flag: Column, cols: dict[str, Column]) -> DataFrame:
    """term, estimate, std_error, z, p_value, and the model's AIC on every line."""
    lines = logits.patterns(df, flag, list(cols.values())).persist()
    fit = logits.fit_all(lines, len(cols), [list(range(len(cols)))])[0]
    lines.unpersist()
    table = []
    for i, name in [*enumerate(cols, 1), (0, "(Intercept)")]:
        se = math.sqrt(max(fit.cov[i, i], 0.0))
        z = float(fit.beta[i]) / se if se > 0 else math.nan
        table.append((name, float(fit.beta[i]), se, z, math.erfc(abs(z) / math.sqrt(2)), fit.aic))
    return _local(df.sparkSession, table, "term string, estimate double, std_error double, z double, p_value double, aic double")


def step_logistic(df: DataFrame, flag: Column, terms: dict[str, dict[str, Column]]) -> DataFrame:
    """Stepwise selection by AIC from the full model, dropping or restoring whole terms.

    The source is read once; all moves of a step are fitted by the same passes over its distinct patterns, each from
    the coefficients of the model it leaves.
    """
    every = [(t, c) for t, g in terms.items() for c in g.values()]
    lines = logits.patterns(df, flag, [c for _, c in every]).persist()
    fits: dict[tuple, logits.Fit] = {}
    columns = lambda kept: [i for i, (t, _) in enumerate(every) if t in kept]

    def need(sets: list[tuple], near: tuple | None = None):
        new = [k for k in dict.fromkeys(sets) if k not in fits]
        starts = None
        if near is not None:
            known = dict(zip(columns(near), fits[near].beta[1:]))
            starts = [np.array([fits[near].beta[0], *[known.get(i, 0.0) for i in columns(k)]]) for k in new]
        for k, fit in zip(new, logits.fit_all(lines, len(every), [columns(k) for k in new], starts) if new else []):
            fits[k] = fit

    kept = tuple(terms)
    need([kept])
    trace = [(0, "start", "", fits[kept].aic)]
    while True:
        moves = [("drop", t, tuple(o for o in kept if o != t)) for t in kept]
        moves += [("add", t, tuple(o for o in terms if o in kept or o == t)) for t in terms if t not in kept]
        need([m[2] for m in moves], kept)
        best = min(((fits[k].aic, action, t, k) for action, t, k in moves), default=None)
        if best is None or best[0] >= trace[-1][3] - 1e-7:
            break
        kept = best[3]
        trace.append((len(trace), best[1], best[2], best[0]))
    lines.unpersist()
    now = trace[-1][3]
    trace += [(len(trace), "keep", t, now) for t in kept]
    return _local(df.sparkSession, trace, "step int, action string, term string, aic double")


def predict_class(train: DataFrame, test: DataFrame, flag: Column, cols: dict[str, Column], cut: float = 0.5) -> DataFrame:
    """Confusion counts of a logistic model on test rows; rows without a predictor are left out."""
    lines = logits.patterns(train, flag, list(cols.values())).persist()
    beta = logits.fit_all(lines, len(cols), [list(range(len(cols)))])[0].beta
    lines.unpersist()
    names = [f"__f{i}" for i in range(len(cols))]
    rows = test.select(flag.cast("int").alias("actual"), *[c.cast("double").alias(n) for n, c in zip(names, cols.values())]).dropna(subset=names)
    eta = sum((F.lit(float(b)) * F.col(n) for b, n in zip(beta[1:], names)), F.lit(float(beta[0])))
    return confusion(rows.select((1 / (1 + F.exp(-eta)) > cut).cast("int").alias("predicted"), "actual"), "predicted", "actual")


# ---------------------------------------------------------------- trees

def forest(train: DataFrame, test: DataFrame, y: Column, cols: dict[str, Column], trees: int = 500, depth: int = 8,
           seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(test rows with ``label`` and ``prediction``, importance table sorted from the top)."""
    names = [f"__f{i}" for i in range(len(cols))]
    plain = lambda df: df.select(y.cast("double").alias("label"), *[
        c.cast("double").alias(n) for n, c in zip(names, cols.values())]).dropna(subset=names)
    model = forests.fit(plain(train), trees, depth, seed)
    table = _local(train.sparkSession, [(n, float(w)) for n, w in zip(cols, model.importances())], "term string, importance double")
    return model.predict(plain(test)), table.orderBy(F.col("importance").desc())


def _tree_nodes(model, cols: list[str]) -> list[dict]:
    """Node list of a fitted tree in preorder: statistics, split and children; at most 2^depth entries."""
    nodes: list[dict] = []

    def visit(node, depth, rule):
        stats = node.impurityStats()
        me = {"id": len(nodes), "depth": depth, "rule": rule, "prediction": float(node.prediction()),
              "n": int(stats.count()), "sse": float(node.impurity()) * float(stats.count()), "children": None}
        nodes.append(me)
        if node.subtreeDepth() > 0:
            split = node.split()
            name, at = cols[split.featureIndex()], float(split.threshold())
            me["children"] = (visit(node.leftChild(), depth + 1, f"{name} <= {at:.6g}"),
                              visit(node.rightChild(), depth + 1, f"{name} > {at:.6g}"))
        return me["id"]

    visit(model._java_obj.rootNode(), 0, "root")
    return nodes


def _prune(nodes: list[dict], alpha: float) -> set[int]:
    """Leaves of the cheapest subtree when every leaf costs ``alpha``."""
    def cheapest(i):
        own = nodes[i]["sse"] + alpha
        if nodes[i]["children"] is None:
            return own, {i}
        parts = [cheapest(c) for c in nodes[i]["children"]]
        split = sum(p[0] for p in parts)
        return (own, {i}) if own <= split else (split, set().union(*(p[1] for p in parts)))

    return cheapest(0)[1]


def _grow(ready: DataFrame, cp: float, depth: int):
    var = ready.agg(F.var_pop("label")).first()[0] or 0.0
    return DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=7, minInfoGain=cp * var, leafCol="leaf",
                                 maxBins=64).fit(ready)


def decision_tree(df: DataFrame, y: Column, cols: dict[str, Column], cp: float = 0.01, depth: int = 8) -> DataFrame:
    """Pruned regression tree as a table; ``cp`` is relative to the root sum of squares."""
    model = _grow(assemble(df, cols, {"label": y.cast("double")}), cp / 10, depth)
    nodes = _tree_nodes(model, list(cols))
    leaves = _prune(nodes, cp * nodes[0]["sse"])
    lines = []

    def visit(i):
        n = nodes[i]
        lines.append((n["id"], n["depth"], n["rule"], n["n"], n["prediction"], n["sse"], i in leaves))
        if i not in leaves:
            for c in n["children"]:
                visit(c)

    visit(0)
    return _local(df.sparkSession, lines, "node int, depth int, rule string, n bigint, prediction double, sse double, leaf boolean")


def tree_tune(df: DataFrame, y: Column, cols: dict[str, Column], keys: list[str], grid: list[float], folds: int = 10,
              depth: int = 8, seed: int = 1) -> DataFrame:
    """Cross-validated RMSE per ``cp``.

    Each fold grows one tree at the smallest value; the larger ones are its prunings,
    and their test errors follow from per-leaf sums.
    """
    ready = assemble(df, cols, {"label": y.cast("double"), "fold": fold_column(keys, folds, seed)})
    ready = ready.persist()
    found: dict[float, list[float]] = {c: [0.0, 0.0] for c in grid}
    for k in range(folds):
        model = _grow(ready.filter(F.col("fold") != k), min(grid) / 10, depth)
        nodes = _tree_nodes(model, list(cols))
        order = [n["id"] for n in nodes if n["children"] is None]
        up = {c: n["id"] for n in nodes for c in (n["children"] or ())}
        sums = {int(r["leaf"]): r for r in model.transform(ready.filter(F.col("fold") == k)).groupBy("leaf").agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("s"), F.sum(F.col("label") * F.col("label")).alias("q")).collect()}
        for cp in grid:
            leaves = _prune(nodes, cp * nodes[0]["sse"])
            for index, r in sums.items():
                at = order[index]
                while at not in leaves:
                    at = up[at]
                p = nodes[at]["prediction"]
                found[cp][0] += r["q"] - 2 * p * r["s"] + r["n"] * p * p
                found[cp][1] += r["n"]
    ready.unpersist()
    return _local(df.sparkSession, [(float(c), math.sqrt(max(e, 0.0) / n)) for c, (e, n) in found.items()], "cp double, rmse double")


# ---------------------------------------------------------------- mixtures

def gmm_models(df: DataFrame, cols: dict[str, Column], ks: list[int], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(k, loglik, df, bic, icl per line; rows with the class of the best model by BIC)."""
    names = list(cols)
    units = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols.values())],
                    *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols.values())]).first()
    scaled = {n: (c - units[f"m{i}"]) / (units[f"s{i}"] or 1.0) for i, (n, c) in enumerate(cols.items())}
    d = len(names)
    points = [f"__p{i}" for i in range(d)]
    rows = df.select(*[c.cast("double").alias(n) for n, c in cols.items()],
                     *[c.cast("double").alias(p) for p, c in zip(points, scaled.values())]).dropna(subset=points)
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.corr(a, b) for a in names for b in names]).alias("r")).first()
    n = one["n"]
    shift = n * sum(math.log(units[f"s{i}"] or 1.0) for i in range(d))  # back to the original units
    several = [k for k in ks if k > 1]
    stored = mixtures.pieces(rows.select(*points), n).persist()
    if n > mixtures.LIBRARY:
        begun = mixtures.drawn_starts(stored, d, several, seed)
    else:
        # the library wants arrays whose type has no nulls
        ready = rows.select(F.array(*[F.coalesce(p, F.lit(0.0)) for p in points]).alias("features")).persist()
        begun = mixtures.starts(ready, several, seed)
        ready.unpersist()
    fits = mixtures.fit_all(stored, d, begun) if several else []
    found = iter(zip(fits, mixtures.certainties(stored, d, fits)))
    stored.unpersist()
    lines, best = [], None
    for k in ks:
        free = k - 1 + k * d + k * d * (d + 1) // 2
        if k == 1:  # one normal: the likelihood follows from the correlation matrix, and no class is uncertain
            det = np.linalg.slogdet(np.array(one["r"]).reshape(d, d))[1] + d * math.log((n - 1) / n)
            model, ll, entropy = None, float(-n / 2 * (d * math.log(2 * math.pi) + det + d)) - shift, 0.0
        else:
            model, entropy = next(found)
            ll = model.loglik - shift
        bic = 2 * ll - free * math.log(n)
        lines.append((k, ll, free, bic, bic + 2 * float(entropy)))
        if best is None or bic > best[0]:
            best = (bic, model)
    if best[1] is None:
        labelled = rows.select(*names, F.lit(0).alias("mclust"))
    else:
        tasks = df.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows
        labelled = mixtures.labelled(rows, points, names, best[1], "mclust")
    return _local(df.sparkSession, lines, "k int, loglik double, df int, bic double, icl double"), labelled
