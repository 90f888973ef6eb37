"""Null rules, ordered sums, quantiles, tails, and the Gramian against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions import ordered, scalars, tails
from statloom.functions.nulls import guarded, join_null_safe, not_member
from statloom.operators import association, joins, linear, profile, recode, tabulate, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_not_in_keeps_null(spark):
    df = frame(spark, [(1,), (None,), (3,)], "x int")
    assert sorted(r.x or 0 for r in df.filter(not_member(F.col("x"), [1])).collect()) == [0, 3]


def test_null_key_joins_null_key(spark):
    a = frame(spark, [(1, "a"), (None, "b")], "k int, v string")
    b = frame(spark, [(None, 7), (2, 8)], "k int, w int")
    got = {r.v: r.w for r in join_null_safe(a, b, ["k"], "left").collect()}
    assert got == {"a": None, "b": 7}
    assert {r.v: r.w for r in joins.salted_lookup(a, b, "k", 4).collect()} == got
    chained = joins.left_chain(a, [(b, ["w"], ["k"])])
    assert {r.v: r.w for r in chained.collect()} == got


def test_poisoned_aggregate(spark):
    df = frame(spark, [("a", 1.0), ("a", None), ("b", 2.0)], "g string, x double")
    got = {r.g: (r.p, r.s) for r in df.groupBy("g").agg(guarded(F.sum("x"), F.col("x")).alias("p"),
                                                       guarded(F.sum("x"), F.col("x"), "skip").alias("s")).collect()}
    assert got == {"a": (None, 1.0), "b": (2.0, 2.0)}
    stats = {r.g: (r.n, r.median) for r in tabulate.group_stats(df, ["g"], "x").collect()}
    assert stats == {"a": (2, None), "b": (1, 2.0)}


def test_ranges_leave_gaps_and_first_match_wins(spark):
    df = frame(spark, [(1500.5,), (1500.0,), (1501.0,)], "x double")
    label = recode.bin_ranges(F.col("x"), [(0, True, 1500, True, "low"), (1501, True, 2000, True, "high")])
    assert [r[0] for r in df.select(label).collect()] == [None, "low", "high"]
    n = frame(spark, [(3,), (10,), (11,), (12,)], "n int")
    assert [r[0] for r in n.select(recode.cap_counts(F.col("n"), 10, 11)).collect()] == [3, 10, 10, None]


def test_nulls_sort_last_both_ways(spark):
    df = frame(spark, [(1,), (None,), (2,)], "x int")
    assert [r.x for r in windows.sort_rows(df, ["x"]).collect()] == [1, 2, None]
    assert [r.x for r in windows.sort_rows(df, ["-x"]).collect()] == [2, 1, None]


def test_crosstab_keeps_empty_cells(spark):
    df = frame(spark, [("a", "x"), ("b", "y"), ("b", None)], "r string, c string")
    got = {(r.r, r.c): r.n for r in tabulate.crosstab(df, ["r", "c"]).collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1}


def test_running_matches_cumsum_with_hot_cluster(spark):
    rng = np.random.default_rng(1)
    order = np.concatenate([rng.uniform(0, 1e-6, 300), rng.uniform(0, 1000, 50)])
    pdf = pd.DataFrame({"k": "a", "o": order, "v": rng.normal(size=350), "p": rng.uniform(0.9, 1, 350)})
    out = ordered.running(spark.createDataFrame(pdf), ["k"], "o", ["v"], ["p"]).toPandas().sort_values("o")
    want = pdf.sort_values("o")
    assert np.allclose(out.cum_v, want.v.cumsum()) and np.allclose(out.cumprod_p, want.p.cumprod())
    back = ordered.running(spark.createDataFrame(pdf), ["k"], "o", ["v"], reverse=True).toPandas().sort_values("o")
    assert np.allclose(back.cum_v, want.v[::-1].cumsum()[::-1])


@pytest.mark.parametrize("parts", [2, 1 << 21])
def test_quantiles_with_one_hot_key(spark, parts, monkeypatch):
    monkeypatch.setattr(ordered, "FINE", parts)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": ["hot"] * 900 + ["a"] * 37 + ["b"], "x": np.round(rng.lognormal(size=938), 2)})
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = ordered.quantiles(spark.createDataFrame(pdf), ["x"], probs, ["k"]).toPandas()
    for k, part in pdf.groupby("k"):
        for p in probs:
            value = got[(got.k == k) & (got.prob == p)].q.iloc[0]
            assert value == pytest.approx(np.quantile(part.x, p))


def test_row_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("id"))
    rows = profile.row_index(df, "id").toPandas().sort_values("id")
    assert list(rows.row_id) == list(range(1, 1001))


def test_tails_known_values():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert tails.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385)


def test_normal_cdf(spark):
    got = spark.range(1).select(scalars.norm_cdf(F.lit(1.96)), scalars.norm_cdf(F.lit(-0.5))).first()
    assert got[0] == pytest.approx(0.5 * (1 + math.erf(1.96 / math.sqrt(2))), abs=1e-7)
    assert got[1] == pytest.approx(0.5 * (1 + math.erf(-0.5 / math.sqrt(2))), abs=1e-7)


def test_fisher_against_enumeration():
    for a, b, c, d in [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 7, 2)]:
        r1, c1, n = a + b, a + c, a + b + c + d
        prob = {k: math.comb(r1, k) * math.comb(n - r1, c1 - k) / math.comb(n, c1)
                for k in range(max(0, r1 + c1 - n), min(r1, c1) + 1)}
        want = sum(p for p in prob.values() if p <= prob[a] * (1 + 1e-7))
        assert association._fisher(a, b, c, d) == pytest.approx(want)


def test_gram_both_ways_with_null_key_and_null_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(200, 4)), columns=list("abcd"))
    pdf["k"] = [None if i % 5 == 0 else i % 3 for i in range(200)]
    df = spark.createDataFrame(pdf.astype({"k": "Int64"}).assign(k=[None if i % 5 == 0 else i % 3 for i in range(200)]),
                               "a double, b double, c double, d double, k int")
    df = df.withColumn("b", F.when(F.col("a") > 1.5, None).otherwise(F.col("b")))
    cols = [F.lit(1.0), *[F.col(c) for c in "abcd"]]
    plain = {r["k"]: r for r in linear.gram(df, cols, ["k"], F.abs("d")).collect()}
    monkeypatch.setattr(linear, "EXPRESSION_LIMIT", 0)
    batch = {r["k"]: r for r in linear.gram(df, cols, ["k"], F.abs("d")).collect()}
    assert set(plain) == set(batch) == {None, 0, 1, 2}
    for k, r in plain.items():
        assert r["n"] == batch[k]["n"] and np.allclose(r["g"], batch[k]["g"]) and r["w"] == pytest.approx(batch[k]["w"])


def test_pvalue_of_constant_table_is_null(spark):
    df = frame(spark, [("a", "x"), ("a", "y")], "r string, c string")
    row = association.chi_square(df, {"r": F.col("r")}, F.col("c")).first()
    assert row["df"] == 0 and row["p_value"] is None


def test_design_uses_own_order_and_reference(spark):
    df = frame(spark, [(2, "b"), (10, "a"), (None, "b"), (2, None)], "k int, f string")
    assert list(recode.design_columns(df, [], ["k", "f"])) == ["(Intercept)", "k10", "fb"]
    cols = recode.design_columns(df, [], {"k": 10, "f": "b"}, intercept=False)
    assert list(cols) == ["k2", "fa"]
    assert [r[0] for r in df.select(cols["k2"]).collect()] == [1.0, 0.0, None, 1.0]
    with pytest.raises(ValueError, match="not a level"):
        recode.design_columns(df, [], {"k": 7})
