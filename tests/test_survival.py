"""Survival operators against direct computation on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import survival


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 160
    pdf = pd.DataFrame({"id": range(n), "x": rng.normal(size=n), "f": rng.integers(0, 3, n)})
    t = rng.exponential(np.exp(-0.7 * pdf.x - 0.4 * (pdf.f == 1))) * 10
    pdf["t"] = np.ceil(np.minimum(t, 12)).astype(int)
    pdf["e"] = ((t < 12) & (rng.uniform(size=n) < 0.85)).astype(int)
    return pdf


def design(pdf):
    return np.column_stack([pdf.x, pdf.f == 1, pdf.f == 2]).astype(float)


COLS = {"x": F.col("x"), "f1": F.col("f") == 1, "f2": F.col("f") == 2}


def direct(pdf, beta, strata=None):
    """Efron likelihood, score and information by loops over times and ties."""
    x = design(pdf)
    x = x - x.mean(axis=0)
    ll, u, info = 0.0, np.zeros(3), np.zeros((3, 3))
    for s in [None] if strata is None else pdf[strata].unique():
        pick = np.ones(len(pdf), bool) if s is None else (pdf[strata] == s).to_numpy()
        for t in np.unique(pdf.t[pick]):
            risk = pick & (pdf.t >= t).to_numpy()
            dead = pick & ((pdf.t == t) & (pdf.e == 1)).to_numpy()
            d, r = dead.sum(), np.exp(x @ beta)
            ll += (x[dead] @ beta).sum()
            u += x[dead].sum(axis=0)
            for l in range(d):
                w = r * risk - l / d * r * dead
                m = w @ x / w.sum()
                ll -= np.log(w.sum())
                u -= m
                info += (x * w[:, None]).T @ x / w.sum() - np.outer(m, m)
    return ll, u, info


@pytest.mark.parametrize("strata", [None, "f"])
def test_cox_optimum(spark, data, strata):
    cols = COLS if strata is None else {"x": F.col("x")}
    fit = survival.cox_fit(spark.createDataFrame(data), "t", "e", cols, strata=strata)
    beta = np.zeros(3)
    beta[:len(fit.beta)] = fit.beta
    ll, u, info = direct(data, beta, strata)
    p = len(fit.beta)
    assert np.allclose(u[:p], 0, atol=1e-5)
    assert np.allclose(fit.cov, np.linalg.inv(info[:p, :p]), rtol=1e-5)
    assert fit.loglik == pytest.approx(ll, abs=1e-6)


def test_many_strata_and_cut_points_give_the_same_fit(spark, data):
    from statloom.functions import ordered
    wide = pd.concat([data.assign(s=i // 2, t=data.t * (1 if i % 2 else 1000003)) for i in range(8)])
    fit = survival.cox_fit(spark.createDataFrame(wide).repartition(5), "t", "e", {"x": F.col("x")}, strata="s")
    assert fit.rows.select("chunk").distinct().count() > 10
    one = survival.cox_fit(spark.createDataFrame(wide[wide.s == 0]), "t", "e", {"x": F.col("x")})
    assert fit.loglik == pytest.approx(4 * one.loglik) and np.allclose(fit.beta, one.beta, atol=1e-7)
    few = ordered.with_chunks(spark.createDataFrame(wide), "t", "c", 3).groupBy("c").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("c").collect()
    assert all(x.b < y.a for x, y in zip(few, few[1:]))


def test_tie_sums_closed_form():
    rng = np.random.default_rng(2)
    k = np.array([1, 2, 15, 16, 17, 18, 40, 500, 5500, 6000, 6500] * 3, dtype=float)
    d0 = k * rng.uniform(0.001, 3, len(k))
    s0 = d0 * np.repeat([1.0, 1.3, 4e5], 11)
    near = survival._tie_sums(s0, d0, k)
    for i in range(len(k)):
        u = np.arange(int(k[i])) / k[i]
        phi = s0[i] - u * d0[i]
        want = [(1 / phi).sum(), (u / phi).sum(), (1 / phi ** 2).sum(), (u / phi ** 2).sum(), (u * u / phi ** 2).sum(), np.log(phi).sum()]
        # each sum is used times powers of d0 and s0, against which its error counts
        unit = np.array([k[i] / s0[i], k[i] / d0[i], k[i] / s0[i] ** 2, k[i] / d0[i] / s0[i], k[i] / d0[i] ** 2, 1.0])
        assert np.allclose(near[i][[0, 2, 5]], np.array(want)[[0, 2, 5]], rtol=1e-9)
        assert (abs(near[i] - want) <= 1e-9 * (np.abs(want) + unit)).all()


def test_residual_identities(spark, data):
    fit = survival.cox_fit(spark.createDataFrame(data), "t", "e", COLS, keep=["id"])
    r = survival.cox_residuals(fit).toPandas()
    assert r.martingale.sum() == pytest.approx(0, abs=1e-6)
    assert abs(r.schoenfeld_x.sum()) < 1e-4 and (r.event - r.martingale >= -1e-9).all()
    assert abs(r.dfbeta_x.sum()) < 1e-4
    x, want = design(data), np.zeros((len(data), 3))
    risk = np.exp((x - x.mean(axis=0)) @ fit.beta)
    for t in np.unique(data.t):
        at, dead = (data.t >= t).to_numpy(), ((data.t == t) & (data.e == 1)).to_numpy()
        for l in range(dead.sum()):
            u = l / dead.sum()
            w = risk * (at - u * dead)
            m = w @ x / w.sum()
            want += (dead / dead.sum() - w / w.sum())[:, None] * (x - m)
    got = r.sort_values("id")[[f"dfbeta_{c}" for c in COLS]].to_numpy()
    assert np.allclose(got, want @ fit.cov, atol=1e-7)
    bands = survival.cox_gof(fit).toPandas()
    assert bands.n.sum() == len(data) and bands.expected.sum() == pytest.approx(data.e.sum(), abs=1e-5)


def test_concordance(spark, data):
    fit = survival.cox_fit(spark.createDataFrame(data), "t", "e", COLS)
    eta = design(data) @ fit.beta
    good = ties = pairs = 0
    for i in range(len(data)):
        if data.e[i]:
            later = (data.t > data.t[i]) | ((data.t == data.t[i]) & (data.e == 0))
            good += (eta[later] < eta[i] - 1e-12).sum()
            ties += (abs(eta[later] - eta[i]) <= 1e-12).sum()
            pairs += later.sum()
    got = survival.cox_concordance(fit).first()
    assert (got["concordant"], got["tied"], got["pairs"]) == (good, ties, pairs)
    assert got["concordance"] == pytest.approx((good + ties / 2) / pairs)


def test_concordance_of_continuous_scores_has_no_ties(spark):
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame({"x": rng.normal(size=n), "t": rng.integers(1, 200, n), "e": rng.integers(0, 2, n), "s": rng.integers(0, 2, n)})
    fit = survival.cox_fit(spark.createDataFrame(pdf).repartition(4), "t", "e", {"x": F.col("x")}, strata="s")
    x, t, e, s = (pdf[c].to_numpy() for c in "xtes")
    valid = (e == 1)[:, None] & (s[:, None] == s) & ((t > t[:, None]) | ((t == t[:, None]) & (e == 0)))
    below = (x < x[:, None]) if fit.beta[0] > 0 else (x > x[:, None])
    got = survival.cox_concordance(fit).first()
    assert (got["concordant"], got["tied"], got["pairs"]) == ((valid & below).sum(), 0, valid.sum())


def test_selection_drops_noise(spark, data):
    pdf = data.assign(z=np.random.default_rng(6).normal(size=len(data)))
    fit = survival.cox_fit(spark.createDataFrame(pdf), "t", "e", {"x": F.col("x"), "z": F.col("z")})
    kept, trace = survival.cox_select(fit, {"x": ["x"], "z": ["z"]})
    assert kept == ["x"] and trace[0][1] == "z"


def test_curve_edges(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "t int, e int")
    km = survival.kaplan_meier(df, "t", "e").orderBy("t").collect()
    assert km[-1]["surv"] == 0 and km[-1]["std_err"] is None and km[-1]["cloglog"] is None
    kept = spark.createDataFrame([(1, 1)] + [(5, 0)] * 9, "t int, e int")
    assert survival.km_median(kept, "t", "e").first()["median"] is None


def test_logrank_is_the_score_test_without_ties(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"t": rng.permutation(60) + 1.0, "e": rng.integers(0, 2, 60), "g": rng.integers(0, 2, 60)})
    df = spark.createDataFrame(pdf)
    chi = survival.logrank(df, "t", "e", "g").first()["chi2"]
    fit = survival.cox_fit(df, "t", "e", {"g": F.col("g")})
    assert chi == pytest.approx(fit.score0[0] ** 2 / fit.info0[0, 0])


def test_spline_and_aft(spark, data):
    curve = survival.cox_spline(spark.createDataFrame(data), "t", "e", "x", pieces=5).toPandas().sort_values("x")
    assert np.corrcoef(curve.x, curve.log_hazard)[0, 1] > 0.9
    r = survival.aft_residuals(spark.createDataFrame(data), "t", "e", ["x"], ["id"]).toPandas()
    row = r.iloc[0]
    assert row.residual == pytest.approx((np.log(row.t) - row.lp) / row.scale) and len(r) == len(data)
