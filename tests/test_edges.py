"""Constant columns, zero series, one-point groups, NaN rows, many levels, long series, outliers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.ordered import with_chunks
from statloom.operators import association, forecast, linear, recode, regress, series, survey, tabulate, windows
from statloom.operators.survey import SurveyDesign


def test_a_lone_respondent_or_constant_group_leaves_the_others_right(spark):
    rows = [("a", h, c, 1.0 + c, float(v)) for h in (1, 2) for c, v in enumerate((3, 5, 9, 4))] + [("lone", 1, 9, 2.0, 7.0)]
    rows += [("flat", h, c, 1.0, 4.0) for h in (1, 2) for c in (11, 12)]
    df = spark.createDataFrame(rows, "g string, h int, c int, w double, y double")
    got = {r.g: r for r in survey.svy_mean(df, SurveyDesign("h", "c", "w"), F.col("y"), by=["g"]).collect()}
    assert got["lone"].mean == 7.0 and got["lone"].variance is None and got["lone"].deff is None
    assert got["flat"].mean == 4.0 and got["flat"].deff is None
    w = np.array([r[3] for r in rows if r[0] == "a"])
    y = np.array([r[4] for r in rows if r[0] == "a"])
    assert got["a"].mean == pytest.approx((w * y).sum() / w.sum()) and got["a"].deff is not None


def test_shares_of_zero_and_one_have_no_logit_interval(spark):
    df = spark.createDataFrame([(g, 1, i, 1.0, v) for g, v in (("none", 0), ("all", 1)) for i in range(4)] + [("half", 1, i, 1.0, i % 2) for i in range(4)],
                               "g string, h int, c int, w double, y int")
    got = {r.g: r for r in survey.svy_ciprop(df, SurveyDesign("h", "c", "w"), F.col("y") == 1, by=["g"]).collect()}
    assert got["none"].proportion == 0.0 and got["none"].ci_low is None and got["all"].ci_high is None
    assert 0 < got["half"].ci_low < 0.5 < got["half"].ci_high < 1


def test_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0, "only", "xy"[i % 2]) for i in range(6)], "a double, k double, one string, two string")
    rows = windows.z_scores(df, ["a", "k"]).collect()
    assert all(r.k_z is None and r.a_z is not None for r in rows)
    v = {r.variable: r for r in association.cramers_v(df, {"one": F.col("one"), "a": F.col("a").cast("string")}, F.col("two")).collect()}
    assert v["a"].v is not None and ("one" not in v or v["one"].v is None)
    vif = {r.term: r.vif for r in regress.vif(df.withColumn("b", F.col("a") * 2).withColumn("c", F.col("a") * F.col("a")),
                                              {n: F.col(n) for n in ("a", "b", "k", "c")}).collect()}
    assert vif["k"] is None and vif["a"] is None and vif["b"] is None and vif["c"] is not None
    empty = tabulate.add_share(spark.createDataFrame([("x", 0), ("y", 0)], "v string, n int")).collect()
    assert all(r.share is None for r in empty)


def test_constant_and_one_point_series(spark):
    rows = [("up", i, float(i * i % 7)) for i in range(20)] + [("flat", i, 5.0) for i in range(20)] + [("zero", i, 0.0) for i in range(20)] + [("one", 0, 3.0)]
    df = spark.createDataFrame(rows, "k string, t int, y double").withColumn("t", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")))
    train, test = df.filter("t < '2024-01-17'"), df.filter("t >= '2024-01-17'")
    fc = forecast.fc_ses(train, ["k"], "t", "y", 4)
    got = {r.k: r for r in fc.filter("h = 1").collect()}
    assert got["one"].mean == 3.0 and got["one"].sd is None and got["up"].sd > 0
    acc = forecast.accuracy(fc, test, train, ["k"], "t", "y")
    score = {r.k: r for r in acc.collect()}
    assert score["flat"].mase is None and score["zero"].mase is None and score["up"].mase > 0 and score["flat"].rmse == 0.0
    assert {r.k: r.skill for r in forecast.skill(acc, ["k"], "ses").collect()} == {"up": 0.0, "flat": None, "zero": None}


@pytest.mark.parametrize("width", [2, 13])
def test_nan_and_null_rows_are_left_out_at_any_width(spark, width):
    rows = [tuple(float((i * (j + 3)) % 17) for j in range(width)) for i in range(40)]
    rows[3] = (math.nan, *rows[3][1:])
    rows[5] = (None, *rows[5][1:])
    df = spark.createDataFrame(rows, ", ".join(f"x{j} double" for j in range(width)))
    got = linear.gram(df, [F.col(f"x{j}") for j in range(width)]).collect()[0]
    x = np.array([r for i, r in enumerate(rows) if i not in (3, 5)], float)
    assert got.n == 38 and np.allclose(linear.unpack(got.g), x.T @ x)


def test_long_autoregressions_are_used_whole(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("k", i, rng.random()) for i in range(60)], "k string, t int, y double")
    phi = [0.0] * 24 + [0.5]
    fit = spark.createDataFrame([("k", 0.4, phi)], "k string, mean double, phi array<double>")
    rows = {r.t: r for r in forecast.augment(df, ["k"], "t", "y", fit).collect()}
    assert rows[40].fitted == pytest.approx(0.4 + 0.5 * (rows[15].y - 0.4))


def test_many_levels_and_names(spark):
    df = spark.range(1500).select(F.concat(F.lit("l"), F.col("id")).alias("f"))
    assert len(recode.levels_of(df, "f")) == len(recode.all_levels(df, ["f"])["f"]) == 1500
    names = spark.createDataFrame([("f",)] * 12_000 + [(None,)], "c string")
    assert recode.select_listed(df.withColumn("g", F.lit(1)), names, "c").columns == ["f"]
    with pytest.raises(ValueError):
        recode.select_listed(df, spark.createDataFrame([("nope",)], "c string"), "c")


def test_kpss_of_a_long_series(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") * 37 % 101).cast("double").alias("y"))
    got = series.kpss(df, ["k"], "t", "y").collect()[0]
    assert got.n == n and got.lags == int(4 * (n / 100) ** 0.25) and got.kpss is not None


def test_an_outlier_does_not_fill_one_chunk(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("t")).unionByName(spark.createDataFrame([(1e12,)], "t double"))
    sizes = [r["count"] for r in with_chunks(df, "t", "c").groupBy("c").count().collect()]
    assert max(sizes) <= 2 * 20_001 / len(sizes) + 2 and len(sizes) > 200
