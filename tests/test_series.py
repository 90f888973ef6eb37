"""Series operators on built fixtures and simulated models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import forecast as fc
from statloom.operators import hierarchy, series

K, T, Y = ["k"], "day", "y"


def daily(spark, values, start=dt.date(2020, 1, 1)):
    rows = [(k, start + dt.timedelta(days=i), float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, day date, y double")


def test_duplicate_key_is_refused(spark):
    df = daily(spark, {"a": [1, 2]})
    assert series.checked(df, K, T).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        series.checked(df.union(df.limit(1)), K, T)


def test_gaps_cover_the_global_range(spark):
    df = daily(spark, {"a": [1, 2, 3]}).unionByName(daily(spark, {"b": [5]}, dt.date(2020, 1, 5)))
    out = series.fill_gaps(df, K, T, {"y": 0.0})
    assert out.count() == 10 and out.filter("k = 'b'").agg(F.sum("y")).first()[0] == 5


def test_constant_and_single_point_series(spark):
    df = daily(spark, {"flat": [4] * 20, "one": [3]})
    assert series.acf(df, K, T, Y, 3).count() == 0
    assert all(r["kpss"] is None for r in series.kpss(df, K, T, Y).collect())
    assert fc.fc_rw(df, K, T, Y, 2).count() == 4


def test_boxcox_lambda_with_zero_in_the_series(spark):
    rng = np.random.default_rng(1)
    df = daily(spark, {"a": [0.0, *np.exp(rng.normal(0, 1, 400))]})
    assert abs(series.boxcox_lambda(df, K, T, Y).first()["lambda"]) <= 0.2
    assert abs(series.boxcox_lambda(df, K, T, Y, order=1).first()["lambda"]) <= 0.2


def ar_series(n=3000, phi=0.7, theta=0.0, seed=2):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 1)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + e[t] + theta * e[t - 1]
    return y


def test_autoregression_is_recovered(spark):
    df = daily(spark, {"a": ar_series(), "w": np.cumsum(ar_series(seed=3))}, dt.date(2010, 1, 1))
    fit = fc.ar_fit(df.filter("k = 'a'"), K, T, Y).first()
    assert fit["phi"][0] == pytest.approx(0.7, abs=0.08) and fit["sigma2"] == pytest.approx(1, abs=0.1)
    grid = series.eacf(df.filter("k = 'a'"), K, T, Y, 3, 3).toPandas().set_index(["ar", "ma"])
    assert grid.significant[(0, 0)] and not grid.significant[(1, 0)]
    need = {r["k"]: r["ndiffs"] for r in series.ndiffs(df, K, T, Y).collect()}
    assert need == {"a": 0, "w": 1}


def test_arma_grid(spark):
    df = daily(spark, {"a": ar_series(phi=0.6, theta=0.4, seed=4)}, dt.date(2010, 1, 1))
    fits = fc.arima_fits(df, K, T, Y, [(p, 0, q) for p in (0, 1, 2) for q in (0, 1)]).toPandas()
    best = fits.loc[fits.aic.idxmin()]
    one = fits[(fits.p == 1) & (fits.q == 1)].iloc[0]
    assert one.phi[0] == pytest.approx(0.6, abs=0.1) and one.theta[0] == pytest.approx(0.4, abs=0.1)
    assert best.p >= 1 and best.sigma2 == pytest.approx(1, abs=0.1)
    far = fc.fc_arima(df, K, T, Y, 200, [(1, 0, 1)]).filter("h = 200").first()
    assert abs(far["mean"]) < 0.05 and far["sd"] == pytest.approx(np.sqrt(one.sigma2 * (1 + (one.phi[0] + one.theta[0]) ** 2 / (1 - one.phi[0] ** 2))), rel=1e-3)


def weekly(n=900, phi=0.5, season=0.6, theta=0.0, seed=8):
    """(1 - phi B)(1 - season B^7) y = e + theta e_(t-1)."""
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(8, n + 200):
        y[t] = phi * y[t - 1] + season * y[t - 7] - phi * season * y[t - 8] + e[t] + theta * e[t - 1]
    return y[200:]


def test_seasonal_order_is_the_least_squares_product():
    y = weekly()
    x = np.column_stack([y[8 - k:len(y) - k] for k in (1, 7, 8, 0)])
    m = np.column_stack([np.ones(len(x)), x])
    c, phi, theta, rss = fc._seasonal_model(m.T @ m, [1, 7, 8], [], (1, 0, 1, 0), 7, False)
    assert c == 0 and len(theta) == 0 and phi[2] == pytest.approx(-phi[0] * phi[1])
    sse = lambda a, b: ((x[:, 3] - a * x[:, 0] - b * x[:, 1] + a * b * x[:, 2]) ** 2).sum()
    assert rss == pytest.approx(sse(phi[0], phi[1]), rel=1e-9)
    near = [sse(phi[0] + i / 500, phi[1] + j / 500) for i in range(-25, 26) for j in range(-25, 26)]
    assert min(near) >= rss * (1 - 1e-9)
    assert phi[0] == pytest.approx(0.5, abs=0.07) and phi[1] == pytest.approx(0.6, abs=0.07)


def test_automatic_seasonal_orders(spark):
    noise = np.random.default_rng(9).normal(size=900)
    steps = np.tile([0, 9, 14, 3, -6, -12, -8.0], 129)[:900]
    df = daily(spark, {"week": weekly(900, 0.3, 0.5, seed=11), "plain": ar_series(900), "fixed": steps + np.cumsum(noise) / 9}, dt.date(2010, 1, 1))
    got = {r["k"]: r for r in fc.auto_sarima(df, K, T, Y, 14).filter("h = 1").collect()}
    order = lambda k: [int(v) for v in got[k]["model"].replace("arima(", "").replace(")[7]", "").replace(")(", ",").split(",")]
    assert order("week")[0] >= 1 and order("week")[1] == 0 and order("week")[3] == 1 and order("week")[4] == 0
    assert order("plain")[4] == 0 and order("fixed")[4] == 1
    y, one = weekly(900, 0.3, 0.5, seed=11), got["week"]
    assert one["mean"] == pytest.approx(0.3 * y[-1] + 0.5 * y[-7] - 0.15 * y[-8], abs=0.4) and one["sd"] == pytest.approx(1, abs=0.1)


def test_seasonal_shocks_are_found(spark):
    rng = np.random.default_rng(10)
    e = rng.normal(size=2007)
    y = e[7:] + 0.5 * e[:-7]
    df = daily(spark, {"m": y}, dt.date(2008, 1, 1))
    fit = fc.sarima_fits(df, K, T, Y, [(0, 0, 0, 1), (0, 0, 1, 0)]).toPandas().set_index(["sp", "sq"])
    assert fit.theta[(0, 1)][6] == pytest.approx(0.5, abs=0.08) and fit.aic[(0, 1)] < fit.aic[(1, 0)]
    twice = fc.sarima_fits(df, K, T, Y, [(0, 0, 0, 0)], (1, 1)).first()
    assert twice["const"] == 0 and [k + 1 for k, v in enumerate(twice["phi"]) if v] == [1, 7, 8]


def test_normal_scores_are_quantiles(spark):
    from statistics import NormalDist
    from statloom.functions.scalars import normal_score
    ps = [1e-300, 1e-12, 1e-5, 0.01, 0.0749, 0.076, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", normal_score(F.col("p")).alias("z")).collect()
    for r in rows:
        assert r.z is None if r.p in (0.0, 1.0, None) else r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-9, abs=1e-12)


def test_lag_forest_plan_grows_with_the_steps(spark):
    df = daily(spark, {"a": ar_series(60), "b": ar_series(60, seed=3)})
    size = {h: len(fc.fc_lag_ml(df, K, T, Y, h, lags=3, trees=2, depth=2)._jdf.queryExecution().optimizedPlan().toString()) for h in (4, 8, 12)}
    assert size[12] - size[8] <= 1.5 * (size[8] - size[4])
    got = fc.fc_lag_ml(df, K, T, Y, 5, lags=3, trees=2, depth=2).collect()
    assert sorted((r.k, r.h) for r in got) == [(k, h) for k in "ab" for h in range(1, 6)]
    assert all(r.day == dt.date(2020, 2, 29) + dt.timedelta(days=r.h) for r in got)


def test_norm_by_blocks_of_columns(spark):
    x = np.random.default_rng(12).normal(size=(90, 37))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(4)
    want = ((x.T @ x) ** 2).sum()
    for block in (5, 8, 37, 512):
        assert hierarchy._cross_norm(rows, 37, block).first()["norm2"] == pytest.approx(want)


def test_ets_finds_a_season(spark):
    rng = np.random.default_rng(5)
    season = np.array([0, 5, 9, 3, -4, -8, -5.0])
    y = 50 + np.tile(season, 40) + rng.normal(0, 0.5, 280)
    df = daily(spark, {"s": y, "n": 20 + rng.normal(0, 1, 280)})
    out = fc.fc_ets(df, K, T, Y, 7).toPandas()
    got = out[out.k == "s"].sort_values("h")["mean"].to_numpy()
    assert np.abs(got - 50 - season).max() < 1.5
    assert (out.sd > 0).all()


def test_croston_fixture(spark):
    out = fc.fc_croston(daily(spark, {"a": [0, 0, 5, 0, 3], "z": [0, 0, 0, 0, 0]}), K, T, Y, 1)
    got = {r["k"]: r["mean"] for r in out.collect()}
    assert got["a"] == pytest.approx((5 + 0.1 * (3 - 5)) / (3 + 0.1 * (2 - 3))) and got["z"] == 0


def test_regression_with_ar_errors(spark):
    e = ar_series(phi=0.5, seed=6)
    x = np.random.default_rng(7).normal(size=3000)
    pdf = pd.DataFrame({"k": "a", "day": pd.date_range("2010-01-01", periods=3000).date, "x": x, "y": 2 + 3 * x + e})
    got = fc.xreg_ar1(spark.createDataFrame(pdf), K, T, Y, ["x"]).first()
    assert got["beta"][1] == pytest.approx(3, abs=0.05) and got["rho"] == pytest.approx(0.5, abs=0.06)


def test_pooled_learner_follows_a_pattern(spark):
    df = daily(spark, {"a": np.tile([1, 2, 3, 4, 5, 6, 7.0], 30)})
    out = fc.fc_lag_ml(df, K, T, Y, 7).toPandas().sort_values("h")
    assert np.abs(out["mean"].to_numpy() - np.arange(1, 8)).max() < 1


def test_residual_check_kinds(spark):
    df = daily(spark, {"a": ar_series(200)})
    rows = fc.augment(df, K, T, Y, fc.ar_fit(df, K, T, Y, order=1))
    kinds = {r["kind"]: r["count"] for r in fc.resid_check(rows, K, T, "resid").groupBy("kind").count().collect()}
    assert kinds["acf"] == 10 and kinds["ljung_box"] == 1 and kinds["qq"] == 199


def test_crps_of_a_perfect_wide_forecast(spark):
    actual = daily(spark, {"a": [1.0]})
    f = actual.select("k", F.lit("m").alias("model"), F.lit(1).alias("h"), "day", F.lit(1.0).alias("mean"), F.lit(2.0).alias("sd"))
    assert fc.scored(f, actual, K, T, Y).first()["crps"] == pytest.approx(2 * (np.sqrt(2) - 1) / np.sqrt(np.pi), abs=1e-6)


@pytest.mark.parametrize("n_dates", [40, 4])
def test_reconciliation_equals_matrix_projection(spark, n_dates):
    """Also with fewer dates than series, where the other side of the cross product is used."""
    rng = np.random.default_rng(8)
    m, names = 5, [f"b{i}" for i in range(5)]
    res = rng.normal(size=(n_dates, m + 1)) @ rng.normal(size=(m + 1, m + 1))
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n_dates)]
    resid = spark.createDataFrame([(k, d, float(res[i, j])) for i, d in enumerate(days) for j, k in enumerate(["total", *names])],
                                  "key string, day date, e double")
    xs = res / np.sqrt((res ** 2).mean(axis=0))
    r = xs.T @ xs / n_dates
    v = ((xs ** 2).T @ xs ** 2 - (xs.T @ xs) ** 2 / n_dates) / (n_dates * (n_dates - 1))
    off = ~np.eye(m + 1, dtype=bool)
    lam = min(1.0, max(0.0, v[off].sum() / (r[off] ** 2).sum()))
    cov = res.T @ res / n_dates
    w = (1 - lam) * cov + lam * np.diag(np.diag(cov))
    base = rng.normal(size=m + 1) * 10
    s = np.vstack([np.ones(m), np.eye(m)])
    wi = np.linalg.inv(w)
    want = s @ np.linalg.solve(s.T @ wi @ s, s.T @ wi @ base)
    weights = hierarchy.shrunk_weights(resid, "key", "day", "e", "total")
    assert weights.first()["lam"] == pytest.approx(lam)
    leaf = spark.createDataFrame([(k, 1, float(b)) for k, b in zip(names, base[1:])], "key string, h int, mean double")
    total = spark.createDataFrame([(1, float(base[0]))], "h int, mean double")
    got = {r["key"]: r["reconciled"] for r in hierarchy.recon_mint(leaf, total, ["h"], "key", weights, "total").collect()}
    assert np.allclose([got[k] for k in ["total", *names]], want)
    assert got["total"] == pytest.approx(sum(got[k] for k in names))
