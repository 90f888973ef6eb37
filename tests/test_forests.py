"""Forests against a tree grown in plain Python and against pyspark.ml."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from statloom.operators import forests, mlmodels


def grown(x, y, w, depth):
    """Predicted labels of the rows of one tree over one column of few values."""
    out = np.full(len(x), np.average(y, weights=w))
    best = None
    for c in np.unique(x)[:-1]:
        low = x <= c
        if depth and 0 < w[low].sum() < w.sum():
            left = sum((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() for m in (low, ~low))
            if best is None or left < best[0] - 1e-9:
                best = left, low
    if best and best[0] < (w * (y - out) ** 2).sum() - 1e-9:
        for m in (best[1], ~best[1]):
            out[m] = grown(x[m], y[m], w[m], depth - 1)
    return out


def test_trees_are_those_of_plain_python(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 12, 700) / 4, "y": rng.normal(size=700)})
    pdf["y"] += np.sin(pdf.x * 3) * 2
    df = spark.createDataFrame(pdf).coalesce(1)
    pred, weights = mlmodels.forest(df, df, F.col("y"), {"x": F.col("x")}, trees=7, depth=3, seed=5)
    stored = pred.toPandas()  # one piece, in the order of the rows
    want = np.mean([grown(pdf.x.to_numpy(), pdf.y.to_numpy(), forests.draws(5, t, 0, 700).astype(float), 3) for t in range(7)], axis=0)
    assert np.allclose(stored.label, pdf.y) and np.allclose(stored.prediction, want)
    assert weights.collect() == [("x", 1.0)]


def test_draws_are_poisson_and_repeat():
    got = forests.draws(1, 2, 3 << 32, 1_000_000)
    assert (got == forests.draws(1, 2, 3 << 32, 1_000_000)).all() and (got != forests.draws(1, 3, 3 << 32, 1_000_000)).any()
    share = np.bincount(got, minlength=8)[:8] / len(got)
    want = np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040])
    assert np.abs(share - want).max() < 0.002 and got.max() < 19 and got.var() == pytest.approx(1, abs=0.01)


def test_many_tasks_and_values_give_the_forest_of_the_library(spark, monkeypatch):
    monkeypatch.setattr(forests, "BLOCK", 2500)  # rows for a task
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12000, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(e=rng.integers(0, 3, 12000), y=3 * x[:, 0] + x[:, 1] ** 2 + rng.normal(size=12000) / 4)
    df = spark.createDataFrame(pdf).repartition(5)
    cols = {c: F.col(c) for c in "abcde"}
    learn, rest = df.filter("e < 2"), df.filter("e = 2")
    pred, weights = mlmodels.forest(learn, rest, F.col("y"), cols, trees=60)
    one = RandomForestRegressor(numTrees=60, maxDepth=8, seed=1, featureSubsetStrategy="onethird").fit(mlmodels.assemble(learn, cols, {"label": F.col("y")}))
    rmse = lambda p: np.sqrt(((p.label - p.prediction) ** 2).mean())
    library = one.transform(mlmodels.assemble(rest, cols, {"label": F.col("y")})).toPandas()
    got = pred.toPandas()
    assert len(got) == len(library) and rmse(got) == pytest.approx(rmse(library), rel=0.15)
    share = {r["term"]: r["importance"] for r in weights.collect()}
    assert [share[c] for c in "abcde"] == pytest.approx(one.featureImportances.toArray(), abs=0.06)


def test_a_pass_serves_all_trees(spark):
    """The forest of 500 trees takes no more jobs than that of five."""
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(400) % 40, "z": np.arange(400) % 7, "y": np.arange(400.0) ** 1.5 % 97}))
    taken = []
    for trees in (5, 500):
        tag = f"forest-{trees}"
        spark.sparkContext.setJobGroup(tag, tag)
        mlmodels.forest(df, df, F.col("y"), {"x": F.col("x"), "z": F.col("z")}, trees=trees)
        taken.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert taken[0] == taken[1] > 0


def test_rows_that_take_no_part_and_rows_that_must(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (float("nan"), 3.0), (2.0, 4.0), (3.0, 8.0)], "x double, y double")
    cols, y = {"x": F.col("x")}, F.col("y")
    pred, _ = mlmodels.forest(df, df.withColumn("y", F.lit(None).cast("double")), y, cols, trees=3)
    assert [r["label"] for r in pred.collect()] == [None] * 3 and pred.filter("isnan(prediction)").count() == 0
    flat, weights = mlmodels.forest(df, df, F.lit(2), cols, trees=3)
    assert {r["prediction"] for r in flat.collect()} == {2.0} and weights.first()["importance"] == 0
    with pytest.raises(Exception, match="labels must not be null"):
        mlmodels.forest(df.withColumn("y", F.lit(None).cast("double")), df, y, cols, trees=3)
    with pytest.raises(Exception, match="infinite"):
        mlmodels.forest(df.withColumn("x", F.lit(float("inf"))), df, y, cols, trees=3)
    with pytest.raises(ValueError, match="at least one row"):
        mlmodels.forest(df.filter("y > 100"), df, y, cols, trees=3)


def test_rows_go_down_together_as_each_goes_alone(monkeypatch):
    rng = np.random.default_rng(7)
    sizes, n = np.array([32, 2, 5, 32, 3, 2, 1]), 5000
    codes = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint8)
    flat, rows = codes.ravel(), np.flatnonzero(rng.random(n) < 0.6)
    labels, tree = rng.normal(size=n), forests.Tree(gains=np.zeros(7))
    for height in range(forests.TOP + 3):
        node = tree.find(flat, n, rows)
        for at, row in list(zip(node, rows))[::50]:
            alone = 0
            while tree.child[alone] != alone:
                alone = tree.child[alone] + (codes[tree.feature[alone], row] > tree.cut[alone])
            assert at == alone
        monkeypatch.setattr(forests, "TOP", 0)
        assert (tree.find(flat, n, rows) == node).all()
        monkeypatch.undo()
        level = forests._Level(sizes, rng.random((len(tree.live), 7)).argsort(axis=1)[:, :3].astype(np.int32))
        counts, totals = np.zeros(level.cells), np.zeros(level.cells)
        for line, own in enumerate(tree.live):
            for slot, c in enumerate(level.slots[line]):
                inside = rows[node == own]
                np.add.at(counts, level.starts[line, slot] + codes[c, inside], 1.0)
                np.add.at(totals, level.starts[line, slot] + codes[c, inside], labels[inside])
        forests._split(tree, forests.best(level, counts, totals), 0.0)
    assert tree.depth > forests.TOP
    assert 2 ** forests.TOP <= 256


def test_draws_are_the_bytes_of_the_generator():
    for n in (1, 2, 5, 701, 32768):
        bits = np.frombuffer(np.random.Generator(np.random.SFC64([1, 2, 3])).bytes(2 * n), np.uint16)
        plain = forests._DRAWS.take(bits)
        assert (forests.draws(1, 2, 3, n)[plain != forests._MARK] == plain[plain != forests._MARK]).all()
