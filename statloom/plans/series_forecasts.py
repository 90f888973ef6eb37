"""Forecasts of the daily totals: fitted up to 2000, seven days or seven months ahead."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom.functions.scalars import INV_SQRT_2PI, NORMAL_TAIL_B, NORMAL_TAIL_P
from statloom.operators import forecast as fc
from statloom.operators import hierarchy
from statloom.operators.series import fill_gaps
from statloom.plans.registry import query
from statloom.plans.series_basics import K, PANEL, T, TRAIN, Y, panel, test, train
from statloom.plans.tables_grouped import rounded
from statloom.sources import Tables

H = "(SELECT unnest(range(1, 8))::INTEGER AS h)"
LONG = 213  # days of the seven test months


def short(df, digits=5):
    return rounded(df.select("key", "model", "h", "day", "mean", "sd"), digits, "mean", "sd")


MEAN_SQL = f"""mn AS (SELECT key, 'mean' AS model, h, DATE '2000-12-31' + h AS day, m AS mean, s AS sd FROM
  (SELECT key, avg(y) AS m, stddev_samp(y) * sqrt(1 + 1.0::DOUBLE / count(*)) AS s FROM tr GROUP BY key), hh)"""
RW_SQL = """rw AS (SELECT key, 'rw' AS model, h, DATE '2000-12-31' + h AS day, l AS mean, sqrt(h * s2) AS sd FROM
  (SELECT key, arg_max(y, day) AS l, avg(dd * dd) AS s2 FROM (SELECT *, y - lag(y) OVER (PARTITION BY key ORDER BY day) AS dd FROM tr) GROUP BY key), hh)"""
SN_SQL = """sn AS (SELECT s.key, 'snaive' AS model, h, DATE '2000-12-31' + h AS day, t.y AS mean, sqrt(s2 * ((h - 1) // 7 + 1)) AS sd FROM
  (SELECT key, avg(dd * dd) AS s2 FROM (SELECT *, y - lag(y, 7) OVER (PARTITION BY key ORDER BY day) AS dd FROM tr) GROUP BY key) s, hh
  JOIN tr t ON t.day = DATE '2000-12-31' - 6 + (h - 1) % 7 WHERE t.key = s.key)"""


def hh(n):
    return f"hh AS (SELECT unnest(range(1, {n + 1}))::INTEGER AS h)"


@query("fc_mean", f"WITH {TRAIN}, {hh(7)}, {MEAN_SQL} SELECT key, model, h, day, round(mean, 5) AS mean, round(sd, 5) AS sd FROM mn")
def fc_mean_query(spark, d):
    return short(fc.fc_mean(train(spark, d), K, T, Y, 7))


@query("fc_mean_log", f"""WITH {TRAIN}, {hh(7)}, q AS (SELECT key, avg(ln(y)) AS m, stddev_samp(ln(y)) * sqrt(1 + 1.0::DOUBLE / count(*)) AS s, max(day) AS l FROM tr WHERE y > 0 GROUP BY key)
SELECT key, 'mean' AS model, h, l + h AS day, round(m, 6) AS mean, round(s, 6) AS sd FROM q, hh""")
def fc_mean_log_query(spark, d):
    return short(fc.fc_mean(train(spark, d), K, T, Y, 7, lam=0), 6)


@query("fc_rw", f"WITH {TRAIN}, {hh(7)}, {RW_SQL} SELECT key, model, h, day, round(mean, 5) AS mean, round(sd, 5) AS sd FROM rw")
def fc_rw_query(spark, d):
    return short(fc.fc_rw(train(spark, d), K, T, Y, 7))


@query("fc_snaive", f"WITH {TRAIN}, {hh(10)}, {SN_SQL} SELECT key, model, h, day, round(mean, 5) AS mean, round(sd, 5) AS sd FROM sn")
def fc_snaive_query(spark, d):
    return short(fc.fc_snaive(train(spark, d), K, T, Y, 10, 7))


@query("fc_tslm", f"""WITH {TRAIN}, {hh(7)}, x AS (SELECT *, date_diff('day', DATE '1970-01-01', day) / 1000 AS x FROM tr),
r AS (SELECT key, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, var_pop(x) * count(*) AS sxx, count(*) AS n, var_pop(y) * count(*) - power(covar_pop(x, y) * count(*), 2) / (var_pop(x) * count(*)) AS rss FROM x GROUP BY key),
f AS (SELECT *, date_diff('day', DATE '1970-01-01', DATE '2000-12-31' + h) / 1000 AS xf FROM r, hh)
SELECT key, 'tslm' AS model, h, DATE '2000-12-31' + h AS day, round(b0 + b1 * xf, 4) AS mean, round(sqrt(rss / (n - 2) * (1 + 1.0::DOUBLE / n + (xf - mx) * (xf - mx) / sxx)), 4) AS sd FROM f""")
def fc_tslm_query(spark, d):
    return short(fc.fc_tslm(train(spark, d), K, T, Y, 7), 4)


@query("fc_tslm_season")
def fc_tslm_season_query(spark, d):
    season = [F.dayofweek("day") == k for k in range(2, 8)]
    return fc.fc_tslm(train(spark, d), K, T, Y, LONG, season=season)


@query("fc_ar", f"""WITH {TRAIN}, m AS (SELECT key, avg(y) AS m, count(*) AS n, arg_max(y, day) AS l FROM tr GROUP BY key),
e AS (SELECT tr.key, y - m AS e, lag(y - m) OVER (PARTITION BY tr.key ORDER BY day) AS e1 FROM tr JOIN m USING (key)),
g AS (SELECT key, sum(e * e1) / sum(e * e) AS r, sum(e * e) / count(*) AS c0 FROM e GROUP BY key), {hh(7)},
f AS (SELECT *, c0 * (1 - r * r) * n / (n - 2) AS s2 FROM g JOIN m USING (key))
SELECT key, 'ar' AS model, h, DATE '2000-12-31' + h AS day, round(m + power(r, h) * (l - m), 5) AS mean, round(sqrt(s2 * (1 - power(r * r, h)) / (1 - r * r)), 5) AS sd FROM f, hh""")
def fc_ar_query(spark, d):
    return short(fc.fc_ar(train(spark, d), K, T, Y, 7, order=1))


@query("fc_ar_auto")
def fc_ar_auto_query(spark, d):
    return fc.fc_ar(train(spark, d), K, T, Y, LONG)


@query("fc_arima", f"""WITH {TRAIN}, w AS (SELECT *, y - lag(y) OVER (PARTITION BY key ORDER BY day) AS w FROM tr),
l AS (SELECT *, lag(w) OVER (PARTITION BY key ORDER BY day) AS w1, row_number() OVER (PARTITION BY key ORDER BY day) AS i FROM w),
b AS (SELECT key, sum(w * w1) / sum(w1 * w1) AS phi, sum(w * w) - power(sum(w * w1), 2) / sum(w1 * w1) AS rss, count(*) AS n FROM l WHERE i > 12 GROUP BY key),
z AS (SELECT key, arg_max(y, day) AS y, arg_max(w, day) AS w FROM w GROUP BY key), {hh(7)}
SELECT key, 'arima(1,1,0)' AS model, h, DATE '2000-12-31' + h AS day, round(y + w * list_sum(list_transform(range(1, h + 1), lambda k: power(phi, k))), 4) AS mean FROM b JOIN z USING (key), hh""")
def fc_arima_query(spark, d):
    out = fc.fc_arima(train(spark, d), K, T, Y, 7, orders=[(1, 1, 0), (1, 1, 1)]).filter("model = 'arima(1,1,0)'")
    return rounded(out.select("key", "model", "h", "day", "mean"), 4, "mean")


@query("fc_arima_grid")
def fc_arima_grid_query(spark, d):
    return fc.fc_arima(train(spark, d), K, T, Y, 7)


@query("fc_auto_arima")
def fc_auto_arima_query(spark, d):
    return fc.auto_arima(train(spark, d), K, T, Y, 7)


@query("fc_sarima", f"""WITH {TRAIN}, w AS (SELECT *, y - lag(y, 7) OVER (PARTITION BY key ORDER BY day) AS w FROM tr),
l AS (SELECT *, lag(w, 7) OVER (PARTITION BY key ORDER BY day) AS w7 FROM w),
b AS (SELECT key, sum(w * w7) / sum(w7 * w7) AS phi, (sum(w * w) - power(sum(w * w7), 2) / sum(w7 * w7)) / count(*) AS s2 FROM l WHERE w7 IS NOT NULL GROUP BY key), {hh(7)}
SELECT b.key, 'arima(0,0,0)(1,1,0)[7]' AS model, h, DATE '2000-12-31' + h AS day, round(y + phi * w, 4) AS mean, round(sqrt(s2), 4) AS sd
FROM b CROSS JOIN hh JOIN w ON w.key = b.key AND w.day = DATE '2000-12-31' + h - 7""")
def fc_sarima_query(spark, d):
    """A seasonal autoregression of seasonal differences, the order that SQL can solve."""
    return short(fc.fc_sarima(train(spark, d), K, T, Y, 7, [(0, 0, 1, 0)], (0, 1), constant=False), 4)


@query("fc_auto_sarima")
def fc_auto_sarima_query(spark, d):
    return fc.auto_sarima(train(spark, d), K, T, Y, 7)


def _ses_sql():
    return f"""WITH {TRAIN}, a AS (SELECT key, list(y ORDER BY day) AS a FROM tr GROUP BY key),
g AS (SELECT key, i, i / 10.0::DOUBLE AS al, list_reduce(list_transform(a, lambda y: {{'l': y, 's': 0.0::DOUBLE}}), lambda s, x: {{'l': s.l + i / 10.0::DOUBLE * (x.l - s.l), 's': s.s + (x.l - s.l) * (x.l - s.l)}}) AS r, len(a) AS n FROM a, range(1, 10) t(i)),
b AS (SELECT key, arg_min({{'al': al, 'l': r.l, 's': r.s, 'n': n}}, r.s) AS b FROM g GROUP BY key), {hh(7)}
SELECT key, 'ses' AS model, h, DATE '2000-12-31' + h AS day, round(b.l, 5) AS mean, round(sqrt(b.s / (b.n - 1) * (1 + b.al * b.al * (h - 1))), 5) AS sd FROM b, hh"""


@query("fc_ets", _ses_sql())
def fc_ets_query(spark, d):
    """Simple smoothing, the form the SQL can fold."""
    return short(fc.fc_ses(train(spark, d), K, T, Y, 7))


@query("fc_ets_auto")
def fc_ets_auto_query(spark, d):
    return fc.fc_ets(train(spark, d), K, T, Y, LONG)


COUNTS = """c AS (SELECT c_mktsegment || '/' || o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day, count(*)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2), days AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM c),
p AS (SELECT k.key, days.day, coalesce(c.y, 0) AS y FROM (SELECT DISTINCT key FROM c) k CROSS JOIN days LEFT JOIN c ON c.key = k.key AND c.day = days.day)"""


@query("fc_croston", f"""WITH {COUNTS}, t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS i FROM p),
z AS (SELECT key, i, y, (i - coalesce(lag(i) OVER (PARTITION BY key ORDER BY i), 0))::DOUBLE AS g FROM t WHERE y <> 0),
s AS (SELECT key, list_reduce(list(y ORDER BY i), lambda l, x: l + 0.1::DOUBLE * (x - l)) AS size, list_reduce(list(g ORDER BY i), lambda l, x: l + 0.1::DOUBLE * (x - l)) AS gap FROM z GROUP BY key),
e AS (SELECT max(day) AS l FROM p), {hh(7)}
SELECT key, 'croston' AS model, h, l + h AS day, round(size / gap, 7) AS mean FROM s, e, hh""")
def fc_croston_query(spark, d):
    """Orders per day, market segment and priority, zero on most days."""
    t = Tables(spark, d)
    sold = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    counts = sold.groupBy(F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    out = fc.fc_croston(fill_gaps(counts, K, T, {"y": 0.0}), K, T, Y, 7)
    return rounded(out.select("key", "model", "h", "day", "mean"), 7, "mean")


@query("fc_lag_ml")
def fc_lag_ml_query(spark, d):
    return fc.fc_lag_ml(train(spark, d), K, T, Y, 7)


@query("fc_xreg")
def fc_xreg_query(spark, d):
    """Daily totals on the number of orders of the same day, with AR(1) errors."""
    o = Tables(spark, d).orders.groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).agg(
        (F.sum("o_totalprice") / 1000).alias("y"), F.count(F.lit(1)).cast("double").alias("x"))
    return fc.xreg_ar1(fill_gaps(o, K, T, {"y": 0.0, "x": 0.0}), K, T, Y, ["x"])


AR1 = f"""{PANEL}, m AS (SELECT key, avg(y) AS m FROM p GROUP BY key),
e AS (SELECT p.key, day, y, m, y - m AS e, lag(y - m) OVER (PARTITION BY p.key ORDER BY day) AS e1 FROM p JOIN m USING (key)),
g AS (SELECT key, sum(e * e1) / sum(e * e) AS r FROM e GROUP BY key)"""


@query("model_outputs", f"WITH {AR1} SELECT key, day, round(y, 6) AS y, round(m + r * e1, 6) AS fitted, round(y - m - r * e1, 6) AS resid FROM e JOIN g USING (key)")
def model_outputs_query(spark, d):
    rows = panel(spark, d)
    return rounded(fc.augment(rows, K, T, Y, fc.ar_fit(rows, K, T, Y, order=1)), 6, "y", "fitted", "resid")


@query("model_tidy", f"WITH {AR1} SELECT key, 'ar1' AS term, round(r, 8) AS estimate FROM g UNION ALL SELECT key, 'mean', round(m, 5) FROM m")
def model_tidy_query(spark, d):
    t = fc.tidy(fc.ar_fit(panel(spark, d), K, T, Y, order=1), K)
    return t.select("key", "term", F.when(F.col("term") == "mean", F.round("estimate", 5)).otherwise(F.round("estimate", 8)).alias("estimate"))


@query("model_glance")
def model_glance_query(spark, d):
    return fc.ar_fit(panel(spark, d), K, T, Y).select("key", "n", "p", "sigma2", "aic")


@query("resid_check")
def resid_check_query(spark, d):
    rows = panel(spark, d)
    return fc.resid_check(fc.augment(rows, K, T, Y, fc.ar_fit(rows, K, T, Y)), K, T, "resid")


ALL = f"{hh(LONG)}, {MEAN_SQL}, {RW_SQL}, {SN_SQL}, allf AS (SELECT * FROM mn UNION ALL SELECT * FROM rw UNION ALL SELECT * FROM sn)"


def three(rows):
    parts = [fc.fc_mean(rows, K, T, Y, LONG), fc.fc_rw(rows, K, T, Y, LONG), fc.fc_snaive(rows, K, T, Y, LONG)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("forecast_h", f"WITH {TRAIN}, {ALL} SELECT key, model, h, day, round(mean, 6) AS mean, round(sd, 6) AS sd FROM allf")
def forecast_h_query(spark, d):
    return short(three(train(spark, d)), 6)


@query("intervals", f"""WITH {TRAIN}, {ALL} SELECT key, model, h, round(mean - 1.2815515655446004 * sd, 4) AS lower_80, round(mean + 1.2815515655446004 * sd, 4) AS upper_80,
  round(mean - 1.959963984540054 * sd, 4) AS lower_95, round(mean + 1.959963984540054 * sd, 4) AS upper_95 FROM allf""")
def intervals_query(spark, d):
    out = fc.intervals(three(train(spark, d)))
    cols = ["lower_80", "upper_80", "lower_95", "upper_95"]
    return rounded(out.select("key", "model", "h", *cols), 4, *cols)


def _cdf_tail(x):
    b = NORMAL_TAIL_B
    t = f"(1 / (1 + {NORMAL_TAIL_P} * abs({x})))"
    poly = f"{t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]}))))"
    return f"{INV_SQRT_2PI}::DOUBLE * exp(-({x}) * ({x}) / 2) * {poly}"


# z (2 Phi(z) - 1) is symmetric: |z| (1 - 2 tail(|z|))
CRPS = f"sd * (abs(z) * (1 - 2 * {_cdf_tail('z')}) + 2 * {INV_SQRT_2PI}::DOUBLE * exp(-z * z / 2) - 1 / sqrt(pi()))"
ACC = f"""{TRAIN}, {ALL}, sc AS (SELECT key, avg(abs(dd)) AS scale FROM (SELECT key, y - lag(y) OVER (PARTITION BY key ORDER BY day) AS dd FROM tr) GROUP BY key),
j AS (SELECT f.*, p.y, p.y - f.mean AS e, (p.y - f.mean) / f.sd AS z FROM allf f JOIN p ON p.key = f.key AND p.day = f.day),
acc AS (SELECT key, model, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e) / nullif(abs(y), 0)) * 100 AS mape, avg(abs(e)) / max(scale) AS mase,
  avg({CRPS}) AS crps FROM j JOIN sc USING (key) GROUP BY key, model)"""


def accuracy_table(spark, d):
    tr = train(spark, d)
    return fc.accuracy(three(tr), test(spark, d), tr, K, T, Y)


@query("accuracy_point", f"WITH {ACC} SELECT key, model, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 3) AS mape, round(mase, 6) AS mase FROM acc")
def accuracy_point_query(spark, d):
    out = accuracy_table(spark, d).drop("crps")
    return rounded(rounded(rounded(out, 4, "rmse", "mae"), 3, "mape"), 6, "mase")


@query("accuracy_dist", f"""WITH {ACC} SELECT a.key, a.model, round(a.crps, 4) AS crps, round(1 - a.crps / b.crps, 6) AS skill FROM acc a JOIN acc b ON a.key = b.key AND b.model = 'snaive'""")
def accuracy_dist_query(spark, d):
    out = fc.skill(accuracy_table(spark, d), K, "snaive").select("key", "model", "crps", "skill")
    return rounded(rounded(out, 4, "crps"), 6, "skill")


@query("model_leaderboard", f"""WITH {ACC}, s AS (SELECT a.*, 1 - a.crps / b.crps AS skill, CASE WHEN a.key IN ('1-URGENT', '2-HIGH') THEN 'top' ELSE 'rest' END AS level
  FROM acc a JOIN acc b ON a.key = b.key AND b.model = 'snaive')
SELECT level, model, round(avg(rmse), 4) AS rmse, round(avg(mae), 4) AS mae, round(avg(mase), 6) AS mase, round(avg(crps), 4) AS crps, round(avg(skill) * 100, 5) AS skill_pct FROM s GROUP BY 1, 2""")
def model_leaderboard_query(spark, d):
    acc = fc.skill(accuracy_table(spark, d), K, "snaive").withColumn("level", F.when(F.col("key").isin("1-URGENT", "2-HIGH"), "top").otherwise("rest"))
    out = fc.leaderboard(acc, "level").drop("mape")
    return rounded(rounded(rounded(out, 4, "rmse", "mae", "crps"), 6, "mase"), 5, "skill_pct")


# ---------------------------------------------------------------- hierarchy: total over priorities

HIER = f"""{TRAIN}, tot AS (SELECT day, sum(y) AS y FROM p GROUP BY day), {hh(7)},
b AS (SELECT key, avg(y) AS m, var_pop(y) AS v FROM tr GROUP BY key), tt AS (SELECT arg_max(y, day) AS m FROM tot WHERE day < DATE '2001-01-01'),
tv AS (SELECT avg(dd * dd) AS v FROM (SELECT y - lag(y) OVER (ORDER BY day) AS dd FROM tot WHERE day < DATE '2001-01-01'))"""


def pieces(spark, d):
    """Leaf forecasts by the mean, total forecast by the last value: the two never add up."""
    tr = train(spark, d)
    total = tr.groupBy("day").agg(F.sum("y").alias("y")).withColumn("key", F.lit("total"))
    return tr, total, fc.fc_mean(tr, K, T, Y, 7), fc.fc_rw(total, K, T, Y, 7)


@query("bottom_up", f"WITH {HIER} SELECT h, round((SELECT sum(m) FROM b), 5) AS mean FROM hh")
def bottom_up_query(spark, d):
    return rounded(hierarchy.bottom_up(pieces(spark, d)[2], ["h"]), 5, "mean")


@query("recon_ols", f"WITH {HIER} SELECT key, h, round(m + ((SELECT m FROM tt) - (SELECT sum(m) FROM b)) / 6, 5) AS reconciled FROM b, hh")
def recon_ols_query(spark, d):
    _, _, leaf, total = pieces(spark, d)
    return rounded(hierarchy.recon_ols(leaf, total, ["h"]).select("key", "h", "reconciled"), 5, "reconciled")


@query("recon_wls", f"""WITH {HIER} SELECT key, h, round(m + v / ((SELECT v FROM tv) + (SELECT sum(v) FROM b)) * ((SELECT m FROM tt) - (SELECT sum(m) FROM b)), 5) AS reconciled FROM b, hh""")
def recon_wls_query(spark, d):
    tr, _, leaf, total = pieces(spark, d)
    var = tr.groupBy("key").agg(F.var_pop("y").alias("v"))
    total = total.withColumn("tv", F.col("sd") * F.col("sd") / F.col("h"))
    out = hierarchy.recon_wls(leaf.join(var, "key"), total, ["h"], "v", "tv")
    return rounded(out.select("key", "h", "reconciled"), 5, "reconciled")


def residual_panel(tr, total):
    """One-step residuals: leaves around their mean, the total around the day before."""
    leaf = tr.join(tr.groupBy("key").agg(F.avg("y").alias("m")), "key").select("key", "day", (F.col("y") - F.col("m")).alias("e"))
    step = F.col("y") - F.lag("y").over(Window.partitionBy("key").orderBy("day"))
    top = total.select("key", "day", step.alias("e")).filter("e IS NOT NULL")
    return leaf.join(top.select("day"), "day", "left_semi").unionByName(top, allowMissingColumns=False)


def _mint_sql(lam):
    return f"""WITH {HIER}, rt AS (SELECT 'total' AS key, day, y - lag(y) OVER (ORDER BY day) AS e FROM tot WHERE day < DATE '2001-01-01'),
e AS (SELECT * FROM rt WHERE e IS NOT NULL UNION ALL SELECT tr.key, tr.day, y - m FROM tr JOIN b USING (key) WHERE day > (SELECT min(day) FROM tr)),
cv AS (SELECT a.key AS i, c.key AS j, avg(a.e * c.e) AS s, count(*) AS n, var_pop(a.e * c.e) AS v FROM e a JOIN e c USING (day) GROUP BY 1, 2),
dg AS (SELECT i, s FROM cv WHERE i = j), lm AS (SELECT {lam} AS lam),
w AS (SELECT cv.i, sum(CASE WHEN j = 'total' THEN 1 ELSE -1 END * CASE WHEN cv.i = j THEN cv.s ELSE (1 - lam) * cv.s END) AS w, max(lam) AS lam FROM cv, lm GROUP BY cv.i),
den AS (SELECT sum(CASE WHEN i = 'total' THEN 1 ELSE -1 END * w) AS den FROM w),
f AS (SELECT key, m FROM b UNION ALL SELECT 'total', m FROM tt),
gp AS (SELECT sum(CASE WHEN key = 'total' THEN 1 ELSE -1 END * m) AS gap FROM f)
SELECT key, h, round(m - w / den * gap, 4) AS reconciled FROM f JOIN w ON w.i = f.key, den, gp, hh"""


@query("recon_mint", _mint_sql("""(SELECT greatest(0, least(1, sum(v / (dj.s * di.s) / (n - 1)) / sum(cv.s * cv.s / (dj.s * di.s))))
  FROM cv JOIN dg di ON di.i = cv.i JOIN dg dj ON dj.i = cv.j WHERE cv.i <> cv.j)"""))
def recon_mint_query(spark, d):
    tr, total, leaf, top = pieces(spark, d)
    weights = hierarchy.shrunk_weights(residual_panel(tr, total), "key", "day", "e", "total")
    out = hierarchy.recon_mint(leaf, top, ["h"], "key", weights, "total")
    return rounded(out.select("key", "h", "reconciled"), 4, "reconciled")


@query("recon_mint_fixed", _mint_sql("0.4::DOUBLE"))
def recon_mint_fixed_query(spark, d):
    tr, total, leaf, top = pieces(spark, d)
    weights = hierarchy.shrunk_weights(residual_panel(tr, total), "key", "day", "e", "total", shrink=0.4)
    out = hierarchy.recon_mint(leaf, top, ["h"], "key", weights, "total")
    return rounded(out.select("key", "h", "reconciled"), 4, "reconciled")


@query("hier_levels", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS y,
  CASE grouping_id(o_orderpriority, o_orderstatus) WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS level
FROM orders GROUP BY GROUPING SETS ((1), (1, 2), (1, 3), (1, 2, 3))""")
def hier_levels_query(spark, d):
    o = Tables(spark, d).orders.withColumn("day", F.to_date(F.date_trunc("month", "o_orderdate")))
    sets = hierarchy.crossed_sets(["o_orderpriority", "o_orderstatus"])
    return rounded(hierarchy.hier_levels(o, ["day"], sets, F.col("o_totalprice")), 2, "y")


@query("level_consistency", f"""WITH {HIER}, g AS (SELECT (SELECT m FROM tt) AS t, (SELECT sum(m) FROM b) AS c)
SELECT h, 'before' AS stage, round(t, 4) AS total, round(c, 4) AS children, round(t - c, 4) AS gap FROM g, hh
UNION ALL SELECT h, 'after', round(c + 5 * (t - c) / 6, 4), round(c + 5 * (t - c) / 6, 4), 0.0::DOUBLE FROM g, hh""")
def level_consistency_query(spark, d):
    _, _, leaf, total = pieces(spark, d)
    after = hierarchy.recon_ols(leaf, total, ["h"]).select("key", "h", F.col("reconciled").alias("mean"))
    rows = [hierarchy.level_consistency(leaf, total, ["h"]).withColumn("stage", F.lit("before")),
            hierarchy.level_consistency(after, hierarchy.bottom_up(after, ["h"]), ["h"]).withColumn("stage", F.lit("after"))]
    return rounded(rows[0].unionByName(rows[1]), 4, "total", "children", "gap")
