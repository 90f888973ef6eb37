"""Regression, trees and clusters against numpy on small data."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import clusters, mlmodels, regress, survey
from statloom.operators.survey import SurveyDesign


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 4)) * [1, 2, 0.5, 3] + [0, 5, 1, -2]
    y = 3 + 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=240)
    return pd.DataFrame(np.column_stack([range(240), x, y]), columns=["id", "a", "b", "c", "d", "y"])


COLS = {c: F.col(c) for c in "abcd"}
Y = F.col("y")


def full(pdf, names="abcd"):
    return np.column_stack([np.ones(len(pdf)), pdf[list(names)]])


def rss(pdf, names):
    x = full(pdf, names)
    r = pdf.y - x @ np.linalg.lstsq(x, pdf.y, rcond=None)[0]
    return float(r @ r)


def test_ols_and_diagnostics(spark, data):
    df = spark.createDataFrame(data)
    x = full(data)
    beta = np.linalg.lstsq(x, data.y, rcond=None)[0]
    got = regress.ols(df, Y, COLS).toPandas()
    s2 = rss(data, "abcd") / (len(data) - 5)
    assert np.allclose(got.estimate, beta) and np.allclose(got.std_error, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2))
    hat = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    rows = regress.with_fit(df, Y, COLS).toPandas().sort_values("id")
    assert np.allclose(rows.hat, hat) and rows.hat.sum() == pytest.approx(5)
    assert (regress.vif(df, COLS).toPandas().vif >= 1).all()
    table = regress.anova_lm(df, Y, {"a": {"a": F.col("a")}, "rest": {c: F.col(c) for c in "bcd"}}).toPandas()
    assert table.sum_sq[0] == pytest.approx(rss(data, "") - rss(data, "a")) and table.df.tolist() == [1, 3, 235]


def test_grouped_fit_equals_filtered_fit(spark, data):
    df = spark.createDataFrame(data).withColumn("part", (F.col("id") % 3).cast("int"))
    got = regress.ols(df, Y, {"a": F.col("a")}, ["part"]).toPandas()
    part = data[data.id % 3 == 1]
    want = np.polyfit(part.a, part.y, 1)
    assert np.allclose(got[got.part == 1].sort_values("term").estimate, [want[1], want[0]])
    with pytest.raises(ValueError, match="rename"):
        regress.ols(df.withColumn("g", F.lit(1)), Y, {"a": F.col("a")}, ["g"])


def test_ridge_at_zero_and_lasso_conditions(spark, data):
    df = spark.createDataFrame(data)
    zero = regress.coefficient_path(df, Y, COLS, [0.0], 0.0).toPandas().estimate
    assert np.allclose(zero, np.linalg.lstsq(full(data), data.y, rcond=None)[0])
    lam = 0.3
    b = regress.coefficient_path(df, Y, COLS, [lam], 1.0).toPandas().estimate.to_numpy()
    x = data[list("abcd")].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    grad = z.T @ (data.y - b[0] - x @ b[1:]) / len(data)
    for g, v in zip(grad, b[1:]):
        assert g == pytest.approx(np.sign(v) * lam, abs=1e-6) if v else abs(g) <= lam + 1e-6


def test_cross_validation_equals_refits(spark, data):
    df = spark.createDataFrame(data)
    fold = (F.col("id") % 5).cast("int")
    grams = regress.fold_grams(df, Y, COLS, fold).persist()
    sse = 0.0
    for k in range(5):
        tr, te = data[data.id % 5 != k], data[data.id % 5 == k]
        sse += ((te.y - full(te) @ np.linalg.lstsq(full(tr), tr.y, rcond=None)[0]) ** 2).sum()
    curve = regress.cv_curve(regress.penalised(grams, [0.0], 1.0), grams).first()
    assert curve["cvm"] == pytest.approx(sse / 240)
    assert curve["r2"] == pytest.approx(1 - sse / 240 / data.y.var())
    pcr = regress.pcr_cv(grams, 4).toPandas().set_index("components").rmsep
    assert pcr[4] == pytest.approx(math.sqrt(sse / 240)) and pcr[0] > pcr[4]
    by_fold = regress.ols_cv(df, Y, COLS, fold).toPandas()
    assert (by_fold.n * by_fold.rmse ** 2).sum() == pytest.approx(sse)
    kept, table = regress.relaxed(grams, list("abcd"), [0.2, 0.1, 0.0], 1.0)
    assert {"a", "b"} <= set(kept) and set(table.toPandas().term) == {"(Intercept)", *kept}
    sub = regress.sub_grams(grams, 4, [0, 3]).filter("fold = -1").first()["g_train"]
    direct = regress.fold_grams(df, Y, {c: F.col(c) for c in "ad"}, fold).filter("fold = -1").first()["g_train"]
    assert np.allclose(sub, direct)


def test_subset_and_stepwise(spark, data):
    df = spark.createDataFrame(data)
    got = regress.best_subset(df, Y, COLS, 3).toPandas()
    for r in got.itertuples():
        assert r.rss == pytest.approx(min(rss(data, c) for c in combinations("abcd", r.size)))
    kept = set(regress.step_ols(df, Y, COLS).filter("action = 'keep'").toPandas().term)
    best = min((240 * math.log(rss(data, c) / 240) + 2 * (len(c) + 1), c) for k in range(5) for c in combinations("abcd", k))
    assert kept == set(best[1])


def test_subset_by_branch_and_bound():
    rng = np.random.default_rng(5)

    def least(g, size):
        return min(g[-1, -1] - g[list(c), -1] @ np.linalg.solve(g[np.ix_(c, c)], g[list(c), -1]) for c in combinations(range(len(g) - 1), size))

    for mixed in (0.0, 0.4):
        x = rng.normal(size=(150, 15)) @ (np.eye(15) + mixed * rng.normal(size=(15, 15)))
        g = np.corrcoef(np.c_[x, x[:, :3].sum(1) + 2 * rng.normal(size=150)], rowvar=False)
        found = regress.best_sets(g, 15)
        assert sorted(found) == list(range(1, 16))
        for size in (1, 2, 4, 7, 11, 14):
            c = list(found[size])
            assert g[-1, -1] - g[c, -1] @ np.linalg.solve(g[np.ix_(c, c)], g[c, -1]) == pytest.approx(least(g, size), rel=1e-9)
    x = rng.normal(size=(500, 40))
    y = x[:, :6] @ np.arange(1, 7) + rng.normal(size=500)
    wide = regress.best_sets(np.corrcoef(np.c_[x, y], rowvar=False), 16)
    assert wide[6] == (0, 1, 2, 3, 4, 5) and len(wide) == 16


def test_subset_with_repeated_and_constant_columns(spark, data):
    df = spark.createDataFrame(data).withColumn("a2", F.col("a")).withColumn("flat", F.lit(3.0))
    got = regress.best_subset(df, Y, {**COLS, "a2": F.col("a2"), "flat": F.col("flat")}, 3).toPandas()
    for r in got.itertuples():
        assert r.rss == pytest.approx(min(rss(data, c) for c in combinations("abcd", r.size)))
        assert not {"a", "a2"} <= set(r.variables.split(", ")) and "flat" not in r.variables


def test_stratified_split_counts(spark, data):
    out = regress.split_stratified(spark.createDataFrame(data), "y", ["id"], 0.75).toPandas()
    for _, part in out.groupby("part"):
        assert part.train.sum() == math.ceil(0.75 * len(part))


def test_tree_pruning_and_tuning(spark, data):
    df = spark.createDataFrame(data).withColumn("s", F.when(F.col("a") > 0, 10.0).otherwise(0.0) + F.col("y") / 10)
    tree = mlmodels.decision_tree(df, F.col("s"), COLS, cp=0.05).toPandas()
    leaves = tree[tree.leaf]
    assert leaves.n.sum() == 240 and tree.rule[1].startswith("a <=") and len(leaves) == 2
    tuned = mlmodels.tree_tune(df, F.col("s"), COLS, ["id"], [0.05, 1.5], folds=3).toPandas().set_index("cp").rmse
    assert tuned[0.05] < 1.5 < tuned[1.5]


def test_clusters(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame(np.vstack([rng.normal(0, 1, (80, 2)), rng.normal(9, 1, (80, 2))]), columns=["a", "b"])
    df, cols = spark.createDataFrame(pdf), {"a": F.col("a"), "b": F.col("b")}
    sizes = clusters.kmeans(df, cols, [2], starts=2).toPandas()
    assert sorted(sizes["size"]) == [80, 80]
    wss = clusters.kmeans_wss(df, cols, 3).toPandas().set_index("k").wss
    assert wss[1] == pytest.approx(((pdf - pdf.mean()) ** 2).to_numpy().sum()) and wss[2] < wss[1] / 5
    sil = clusters.kmeans_silhouette(df, cols, 4).toPandas().set_index("k").silhouette
    assert sil.idxmax() == 2
    gap = clusters.kmeans_gap(df, cols, 3, references=2).toPandas().set_index("k").gap
    assert gap[2] > gap[1]
    table, labelled = mlmodels.gmm_models(df, cols, [1, 2, 3])
    bic = table.toPandas().set_index("k").bic
    assert bic.idxmax() == 2 and labelled.groupBy("mclust").count().count() == 2
    cov = np.cov(pdf.T, bias=True)
    ll = -80 * (2 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + 2)
    assert table.toPandas().set_index("k").loglik[1] == pytest.approx(ll)


def test_mixtures_are_the_library_with_one_pass_a_round_for_all(spark, monkeypatch):
    from pyspark.ml.clustering import GaussianMixture
    from statloom.operators import mixtures
    rng = np.random.default_rng(19)
    points = rng.normal(0, 1, (900, 2)) + rng.integers(0, 3, (900, 1)) * [4, -3]
    pdf = pd.DataFrame(points, columns=["a", "b"])
    df = spark.createDataFrame(pdf).repartition(3).persist()
    cols = {"a": F.col("a"), "b": F.col("b")}
    passes = []
    inner = mixtures._moments
    monkeypatch.setattr(mixtures, "_moments", lambda *x: passes.append(1) or inner(*x))
    table, labelled = mlmodels.gmm_models(df, cols, [1, 2, 3, 4])
    got = table.toPandas().set_index("k")
    m, s = pdf.mean(), pdf.std()
    ready = mlmodels.assemble(df, {c: (F.col(c) - float(m[c])) / float(s[c]) for c in "ab"}, {c: F.col(c) for c in "ab"})
    rounds = []
    for k in (2, 3, 4):
        want = GaussianMixture(k=k, seed=1, maxIter=100, tol=1e-4).fit(ready.persist())
        rounds.append(want.summary.numIter)
        assert got.loglik[k] == pytest.approx(want.summary.logLikelihood - 900 * np.log(s).sum(), rel=1e-9)
        probability = np.array([r[0].toArray() for r in want.transform(ready).select("probability").collect()])
        assert got.icl[k] - got.bic[k] == pytest.approx(2 * np.log(probability.max(1)).sum(), rel=1e-5)
        if k == got.bic.idxmax():
            pairs = [(r["a"], r["prediction"]) for r in want.transform(ready).select("a", "prediction").collect()]
            assert sorted(pairs) == sorted((r["a"], r["mclust"]) for r in labelled.collect())
    assert len(passes) == max(rounds) < sum(rounds)


def test_densities_by_features_are_those_by_directions(monkeypatch):
    from statloom.operators import mixtures
    rng = np.random.default_rng(29)
    points = rng.normal(size=(3, 700)) * 3
    spreads = [np.cov(rng.normal(size=(3, 9))) for _ in range(5)]
    some = [mixtures.Mixture(np.full(2, 0.5), rng.normal(size=(2, 3)), np.array(spreads[:2])),
            mixtures.Mixture(np.array([0.2, 0.3, 0.5]), rng.normal(size=(3, 3)), np.array(spreads[2:]))]
    classes, features = mixtures._Classes(some), mixtures._features(points)
    got, total = (x.copy() for x in classes.posteriors(features))
    monkeypatch.setattr(mixtures, "CLOSE", 0.0)
    want, sums = classes.posteriors(features)
    assert np.allclose(got, want, rtol=1e-9, atol=0) and np.allclose(total, sums, rtol=1e-9, atol=0)
    assert got.max() > 0.99 and want.min() < 1e-9
    monkeypatch.undo()
    # a class too narrow for the sums over features, and one without spread in a direction
    narrow = mixtures._Classes([mixtures.Mixture(np.full(2, 0.5), points[:, :2].T.copy(), np.array([np.eye(3) * 1e-20, np.diag([1.0, 1.0, 0.0])]))])
    found, _ = narrow.posteriors(features)
    assert found[0, 0] == pytest.approx(1) and np.isfinite(found).all()
    u = np.linspace(-89.9, 60, 20001)
    out = np.empty_like(u)
    mixtures._exp(u * mixtures.STEPS, np.empty_like(u), out)
    assert np.abs(out / np.exp(u) - 1).max() < 1e-12


def test_starts_of_a_large_table_take_two_passes_for_all(spark, monkeypatch):
    from statloom.operators import mixtures
    monkeypatch.setattr(mixtures, "LIBRARY", 1000)
    rng = np.random.default_rng(31)
    pdf = pd.DataFrame(rng.integers(0, 4, (6000, 1)) * [7.0, -5.0] + rng.normal(size=(6000, 2)), columns=["a", "b"])
    df, cols = spark.createDataFrame(pdf).repartition(3).persist(), {"a": F.col("a"), "b": F.col("b")}
    stored = mixtures.pieces(df, 6000).persist()
    assert stored.count() >= 3
    taken = []
    for ks in ([2], [2, 3, 4, 5]):
        spark.sparkContext.setJobGroup(tag := f"starts-{len(ks)}", tag)
        begun = mixtures.drawn_starts(stored, 2, ks, 1)
        taken.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)))
        assert [len(m.weights) for m in begun] == ks and all((np.diagonal(m.covs, axis1=1, axis2=2) > 0).all() for m in begun)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert taken[0] == taken[1] > 0
    some = np.concatenate([m.means for m in begun])
    assert (np.abs(some - pdf.to_numpy().mean(0)) < pdf.to_numpy().std(0) * 2).all() and len(np.unique(some, axis=0)) == 14
    table, labelled = mlmodels.gmm_models(df, cols, [1, 2, 3, 4])
    bic = table.toPandas().set_index("k").bic
    assert bic.idxmax() > 1 and labelled.count() == 6000


def test_lloyd_is_the_library_from_the_same_start(spark):
    from pyspark.mllib.clustering import KMeans, KMeansModel
    rng = np.random.default_rng(3)
    points = rng.normal(0, 1, (400, 3)) * [1, 5, 20] + rng.integers(0, 3, (400, 1)) * 30
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b", "c"])).repartition(3)
    rows, box = clusters.numeric_rows(df, {n: F.col(n) for n in "abc"})
    starts = [points[rng.permutation(400)[:k]] for k in (1, 2, 5, 9)]
    for rounds in (2, 30):
        models = clusters.lloyd(rows, box, [clusters.Model(0, len(c), c - box.middle) for c in starts], rounds)
        rdd = df.rdd.map(list)
        for start, model in zip(starts, models):
            want = KMeans.train(rdd, len(start), rounds, initialModel=KMeansModel(start.tolist()))
            assert np.allclose(model.centres + box.middle, np.array(want.clusterCenters))
            if rounds == 30:
                assert model.wss == pytest.approx(want.computeCost(rdd)) and model.sizes.sum() == 400
    told = clusters.silhouettes(rows, box, models[1:])
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    ready = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    for model, mine in list(zip(models[1:], told))[:2]:
        label = lambda pdf: pd.Series(((pdf.to_numpy()[:, None] - (model.centres + box.middle)) ** 2).sum(2).argmin(1))  # noqa: E731, B023
        plain = ready.toPandas()
        named = spark.createDataFrame(plain.assign(prediction=label(plain[["a", "b", "c"]]).astype(float)))
        assert mine == pytest.approx(ClusteringEvaluator().evaluate(named))


def test_cells_leave_no_centre_out(monkeypatch):
    monkeypatch.setattr(clusters, "SPREAD", 5000)
    monkeypatch.setattr(clusters, "CELL", 40)
    rng = np.random.default_rng(23)
    even = rng.random((9000, 3)) * [10, 40, 1]
    for points in (even, np.exp(2 * rng.normal(size=(9000, 3))), np.round(even), np.ones((6000, 2)), np.vstack([even] * 2)):
        models = [(i, points[rng.permutation(len(points))[:k]]) for i, k in enumerate([1, 2, 2, 3, 5, 9, 9])]
        for exact in (True, False):
            plain, cells = clusters._Sums(models, exact), clusters._Sums(models, exact)
            plain.add(points)
            cells.add_many(points)
            for a, b in zip(plain.groups, cells.groups):
                if exact:
                    assert (a[3][:, 0] == b[3][:, 0]).all()
                    assert np.allclose(a[3], b[3], rtol=1e-9)
                else:
                    assert np.abs(a[3][:, 0] - b[3][:, 0]).max() <= 2 and np.allclose(a[3], b[3], rtol=1e-3)


def test_uniform_sets_take_part_like_tables(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(0, 1, (9000, 2)), columns=["a", "b"]))
    rows, box = clusters.numeric_rows(df, {"a": F.col("a"), "b": F.col("b")})
    starts = clusters.box_starts(box, 2, [1, 2, 4], 2, 7)
    models = clusters.lloyd(rows, box, starts, 5, seed=7)
    assert len(models) == 12 and {m.points for m in models} == {1, 2}
    for m, start in zip(models, clusters.box_starts(box, 2, [1, 2, 4], 2, 7)):
        points = np.vstack([clusters.uniform_points(box, m.points, i, 7) for i in range(2)])
        assert len(points) == 9000
        centres = start.centres
        for _ in range(m.rounds):
            label = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
            centres = np.array([points[label == j].mean(0) for j in range(len(centres))])
        cost = sum(((points[label == j] - centres[j]) ** 2).sum() for j in range(len(centres)))
        assert m.wss == pytest.approx(cost, rel=1e-4) and np.allclose(m.centres, centres, atol=1e-3)


def test_pieces_of_large_uniform_sets_are_parts_of_the_box(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MADE", 500)
    monkeypatch.setattr(clusters, "SPREAD", 3000)
    clusters._piece_sizes.cache_clear()
    box = clusters.Box(["a", "b"], np.array([0.0, -4.0]), np.array([2.0, 4.0]), np.array([1.0, 0.5]), 20300)
    for number in (1, 2):
        parts = [clusters.uniform_points(box, number, i, 3) for i in range(41)]
        every = (np.vstack(parts) + box.middle - box.low) / (box.high - box.low)
        assert len(every) == 20300 and len({len(p) for p in parts}) > 5
        assert all((a == clusters.uniform_points(box, number, i, 3)).all() for i, a in enumerate(parts))
        # each piece in a part of its own, and all of them together uniform
        assert max(np.prod(np.ptp(p, axis=0)) for p in parts) < 16 / 30
        counts = np.histogram2d(*every.T, bins=10, range=[[0, 1], [0, 1]])[0]
        assert every.min() >= 0 and every.max() <= 1 and abs(((counts - 203) ** 2 / 203).sum() - 99) < 60
    monkeypatch.undo()
    clusters._piece_sizes.cache_clear()
    rows, box = clusters.numeric_rows(spark.range(140000), {"a": F.col("id") % 1000, "b": F.col("id") / 100})
    points = np.vstack([clusters.uniform_points(box, 1, i, 7) for i in range(18)])
    for m, start in zip(clusters.lloyd(rows, box, clusters.box_starts(box, 1, [3], 2, 7), 4, seed=7), clusters.box_starts(box, 1, [3], 2, 7)):
        centres = start.centres
        for _ in range(m.rounds):
            label = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
            centres = np.array([points[label == j].mean(0) for j in range(3)])
        assert m.sizes.sum() == len(points) == 140000 and np.allclose(m.centres, centres, rtol=1e-4, atol=0.1)


def test_clusters_of_repeated_rows_and_nulls(spark):
    rows = [(1.0, 1.0)] * 500 + [(2.0, 5.0)] * 3 + [(None, 1.0)] * 4
    df, cols = spark.createDataFrame(rows, "a double, b double"), {"a": F.col("a"), "b": F.col("b")}
    found = clusters.kmeans(df, cols, [2, 5], starts=3).toPandas()
    assert found.groupby("k")["size"].apply(list).to_dict() == {2: [500, 3], 5: [500, 3]} and (found.wss < 1e-9).all()
    assert clusters.kmeans(df.limit(0), cols, [2]).count() == 0
    # a point between two equal centres belongs to the first
    ready, box = clusters.numeric_rows(df, cols)
    twice = clusters.lloyd(ready, box, [clusters.Model(0, 2, np.zeros((2, 2)))], 1)[0]
    assert twice.sizes.tolist() == [503, 0]


def test_cluster_queries_cover_the_whole_range(spark):
    from statloom.plans import models_ml
    folder = "/root/testdata/sf0.001"
    assert [r.k for r in models_ml.kmeans_silhouette_query(spark, folder).orderBy("k").collect()] == list(range(2, 11))
    assert [r.k for r in models_ml.gmm_bic_query(spark, folder).orderBy("k").collect()] == list(range(1, 10))


def test_logistic_models_of_one_pass(spark, data):
    from pyspark.ml.regression import GeneralizedLinearRegression
    from statloom.operators import logits
    df = spark.createDataFrame(data).withColumns({"w": F.col("id") % 3 + 1.0, "two": F.round("a"), "half": F.round("b")})
    xs = {"two": F.col("two"), "half": F.col("half"), "c": F.col("c")}
    lines = logits.patterns(df, Y > 1, list(xs.values()), F.col("w"))
    sets = [[], [0], [1, 2], [0, 1, 2]]
    for columns, fit in zip(sets, logits.fit_all(lines, 3, sets)):
        names = [list(xs)[i] for i in columns]
        ready = mlmodels.assemble(df, {n: xs[n] for n in names}, {"label": (Y > 1).cast("double"), "w": F.col("w")})
        if names:
            model = GeneralizedLinearRegression(family="binomial", weightCol="w", maxIter=50, tol=1e-12).fit(ready)
            assert fit.beta == pytest.approx([model.intercept, *model.coefficients], abs=1e-6)
            s = model.summary
            errors = s.coefficientStandardErrors
            assert np.sqrt(np.diag(fit.cov)) == pytest.approx([errors[-1], *errors[:-1]], rel=1e-5)
            assert fit.aic == pytest.approx(s.aic, rel=1e-9)
        else:
            share = ready.agg(F.sum(F.col("w") * F.col("label")) / F.sum("w")).first()[0]
            assert fit.beta[0] == pytest.approx(math.log(share / (1 - share)))
    twin = mlmodels.logistic(df, Y > 1, {"two": xs["two"], "again": xs["two"]}).toPandas().set_index("term")
    alone = mlmodels.logistic(df, Y > 1, {"two": xs["two"]}).toPandas().set_index("term")
    assert twin.estimate["two"] + twin.estimate["again"] == pytest.approx(alone.estimate["two"], rel=1e-6)
    apart = mlmodels.predict_class(df, df, F.col("a") > 0, {"a": F.when(F.col("a") > 0, 1.0).otherwise(0.0)}).toPandas()
    assert (apart.predicted == apart.actual).all()


def test_forest_and_stepwise_logistic(spark, data):
    df = spark.createDataFrame(data).withColumn("late", F.col("id") >= 180)
    pred, weights = mlmodels.forest(df.filter("NOT late"), df.filter("late"), Y, COLS, trees=20)
    assert pred.count() == 60 and weights.first()["term"] in ("a", "b")
    trace = mlmodels.step_logistic(df, Y > 1, {"a": {"a": F.col("a")}, "b": {"b": F.col("b")}, "c": {"c": F.col("c")}}).toPandas()
    assert "a" in set(trace[trace.action == "keep"].term)


def test_survey_single_cluster_and_large_table(spark):
    rng = np.random.default_rng(17)
    pdf = pd.DataFrame({"h": rng.integers(0, 3, 300), "c": rng.integers(0, 8, 300), "w": rng.integers(1, 5, 300).astype(float),
                        "a": rng.integers(0, 3, 300), "b": rng.integers(0, 2, 300), "y": rng.normal(size=300)})
    design = SurveyDesign("h", "c", "w")
    got = survey.svy_chisq(spark.createDataFrame(pdf), design, "a", "b").first()
    w = pdf.w / pdf.w.sum()
    share = lambda m: (w * m).sum()
    ys, zs = [], []
    for i in (0, 1):
        p, q = share(pdf.a == i), share(pdf.b == 0)
        ys.append(share((pdf.a == i) & (pdf.b == 0)) - p * q)
        zs.append(w * (((pdf.a == i) & (pdf.b == 0)) - share((pdf.a == i) & (pdf.b == 0)) - q * ((pdf.a == i) - p) - p * ((pdf.b == 0) - q)))
    z = pd.DataFrame({"h": pdf.h, "c": pdf.c, 0: zs[0], 1: zs[1]}).groupby(["h", "c"]).sum()
    cov = sum(len(g) * np.cov(g[[0, 1]].T) for _, g in z.groupby("h"))
    assert got["wald"] == pytest.approx(np.array(ys) @ np.linalg.solve(cov, ys)) and got["k"] == 2
    lone = spark.createDataFrame(pd.concat([pdf, pd.DataFrame([{"h": 9, "c": 0, "w": 1.0, "a": 0, "b": 0, "y": 0.0}])]))
    with pytest.raises(Exception, match="single cluster"):
        survey.svy_mean(lone, design, F.col("y")).collect()
    assert survey.svy_mean(lone, SurveyDesign("h", "c", "w", "skip"), F.col("y")).first()["se"] > 0
