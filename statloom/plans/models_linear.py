"""Regression on order lines joined with their part."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import regress
from statloom.operators.recode import design_columns
from statloom.plans.registry import query
from statloom.plans.tables_grouped import rounded
from statloom.sources import Tables

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BASE = """b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, l_quantity AS x1, p_retailprice AS x2, l_discount AS x3
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
MOM = f"""WITH {BASE}, m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22,
  covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, var_pop(y) AS syy FROM b),
f AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
g AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) AS rss FROM f),
h AS (SELECT *, rss / (n - 3) AS s2 FROM g)"""
# one predictor: quantity
ONE = f"""WITH {BASE}, m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS mx, var_pop(x1) * count(*) AS sxx, regr_slope(y, x1) AS b1,
  regr_intercept(y, x1) AS b0 FROM b),
r AS (SELECT b.*, m.*, b0 + b1 * x1 AS fitted, y - b0 - b1 * x1 AS resid, 1.0::DOUBLE / n + (x1 - mx) * (x1 - mx) / sxx AS hat FROM b, m),
v AS (SELECT sum(resid * resid) / (max(n) - 2) AS s2 FROM r),
k AS (SELECT r.*, s2, resid / sqrt(s2 * (1 - hat)) AS std_resid, resid * resid * hat / (2 * s2 * (1 - hat) * (1 - hat)) AS cook FROM r, v)"""


def lines(spark, d):
    t = Tables(spark, d)
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


Y = "l_extendedprice"


def two():
    return {"x1": F.col("l_quantity"), "x2": F.col("p_retailprice")}


def one():
    return {"x1": F.col("l_quantity")}


def wide(rows):
    """Five numeric columns and three factors: fifteen or so design columns."""
    return design_columns(rows, ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"],
                          ["p_type", "l_returnflag", "l_linestatus"], intercept=False)


@query("split_stratified", f"""WITH q AS (SELECT quantile_cont({Y}, 0.25) AS c1, quantile_cont({Y}, 0.5) AS c2, quantile_cont({Y}, 0.75) AS c3 FROM lineitem),
n AS (SELECT 1 + ({Y} > c1)::INT + ({Y} > c2)::INT + ({Y} > c3)::INT AS bin, count(*) AS n FROM lineitem, q GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, n, CAST(ceil(n * 0.75::DOUBLE) AS BIGINT) AS n_train FROM n""")
def split_stratified_query(spark, d):
    rows = regress.split_stratified(Tables(spark, d).lineitem, Y, KEYS)
    return rows.groupBy(F.col("part").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("train").alias("n_train"))


@query("kfold")
def kfold_query(spark, d):
    return Tables(spark, d).lineitem.groupBy(regress.fold_column(KEYS).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("ols", MOM + """ SELECT '(Intercept)' AS term, round(b0, 4) AS estimate, round(sqrt(s2 * (1.0::DOUBLE / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * det))), 4) AS std_error FROM h
UNION ALL SELECT 'x1', round(b1, 4), round(sqrt(s2 * s22 / (n * det)), 4) FROM h UNION ALL SELECT 'x2', round(b2, 4), round(sqrt(s2 * s11 / (n * det)), 4) FROM h""")
def ols_query(spark, d):
    return rounded(regress.ols(lines(spark, d), F.col(Y), two()).select("term", "estimate", "std_error"), 4, "estimate", "std_error")


@query("ols_summary", MOM + """ SELECT n, round(1 - rss / (n * syy), 8) AS r2, round(1 - rss / (n * syy) * (n - 1) / (n - 3), 8) AS adj_r2,
  round(sqrt(s2), 4) AS sigma, round((n * syy - rss) / 2 / s2, 4) AS f FROM h""")
def ols_summary_query(spark, d):
    g = regress.ols_glance(lines(spark, d), F.col(Y), two())
    return rounded(rounded(g.select("n", "r2", "adj_r2", "sigma", "f"), 8, "r2", "adj_r2"), 4, "sigma", "f")


@query("ols_log", f"""WITH {BASE} SELECT '(Intercept)' AS term, round(regr_intercept(ln(y), x1), 8) AS estimate FROM b
UNION ALL SELECT 'x1', round(regr_slope(ln(y), x1), 8) FROM b""")
def ols_log_query(spark, d):
    return rounded(regress.ols(lines(spark, d), F.log(Y), one()).select("term", "estimate"), 8, "estimate")


@query("ols_cv")
def ols_cv_query(spark, d):
    rows = lines(spark, d)
    return regress.ols_cv(rows, F.col(Y), wide(rows), regress.fold_column(KEYS))


@query("kfold_cv", f"""WITH b AS (SELECT (l_orderkey % 10)::INTEGER AS fold, l_quantity::DOUBLE AS x, {Y}::DOUBLE AS y FROM lineitem),
s AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM b GROUP BY 1),
t AS (SELECT s.fold, a.n - s.n AS n, a.sx - s.sx AS sx, a.sy - s.sy AS sy, a.sxx - s.sxx AS sxx, a.sxy - s.sxy AS sxy
  FROM s, (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s) a),
c AS (SELECT fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, sx / n AS mx, sy / n AS my FROM t),
r AS (SELECT b.fold, y, my + b1 * (x - mx) AS p FROM b JOIN c ON b.fold = c.fold)
SELECT fold, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(power(corr(y, p), 2), 8) AS r2, round(avg(abs(y - p)), 4) AS mae FROM r GROUP BY 1""")
def kfold_cv_query(spark, d):
    """Whole orders are dealt to ten folds by their key; each fold is scored by the fit on the other nine."""
    rows = Tables(spark, d).lineitem
    out = regress.ols_cv(rows, F.col(Y), one(), F.pmod(F.col("l_orderkey"), F.lit(10)).cast("int"))
    return rounded(rounded(out.select("fold", "n", "rmse", "r2", "mae"), 4, "rmse", "mae"), 8, "r2")


@query("anova_lm", MOM + """, o AS (SELECT *, n * (syy - s1y * s1y / s11) AS rss1 FROM h)
SELECT 'x1' AS term, 1::BIGINT AS df, round((n * syy - rss1) / s2, 4) AS f FROM o UNION ALL SELECT 'x2', 1, round((rss1 - rss) / s2, 4) FROM o
UNION ALL SELECT 'Residuals', n - 3, NULL FROM o""")
def anova_lm_query(spark, d):
    t = regress.anova_lm(lines(spark, d), F.col(Y), {"x1": one(), "x2": {"x2": F.col("p_retailprice")}})
    return rounded(t.select("term", "df", "f"), 4, "f")


@query("anova_nested", MOM + """ SELECT round((n * (syy - s1y * s1y / s11) - rss) / s2, 4) AS f, 1::BIGINT AS df1, n - 3 AS df2 FROM h""")
def anova_nested_query(spark, d):
    return rounded(regress.nested_f(lines(spark, d), F.col(Y), one(), two()).drop("p_value"), 4, "f")


@query("step_ols")
def step_ols_query(spark, d):
    rows = lines(spark, d)
    return regress.step_ols(rows, F.col(Y), wide(rows))


LAMBDAS = [10 ** (10 - 0.12 * i) for i in range(101)]  # 10^10 down to 10^-2


@query("lasso_path", f"""WITH {BASE}, m AS (SELECT avg(x1) AS mx, avg(y) AS my, sqrt(var_pop(x1)) AS sx, covar_pop(x1, y) / sqrt(var_pop(x1)) AS r FROM b),
l AS (SELECT i, power(10.0::DOUBLE, 10 - 0.12::DOUBLE * i) AS lam FROM range(0, 101) t(i)),
c AS (SELECT i, sign(r) * greatest(abs(r) - lam, 0) / sx AS b, mx, my FROM l, m)
SELECT CAST(i AS INTEGER) AS step, '(Intercept)' AS term, round(my - b * mx, 5) AS estimate FROM c UNION ALL SELECT CAST(i AS INTEGER), 'x1', round(b, 5) FROM c""")
def lasso_path_query(spark, d):
    path = regress.coefficient_path(lines(spark, d), F.col(Y), one(), LAMBDAS, 1.0)
    step = F.round((10 - F.log10("lambda")) / 0.12).cast("int")
    return path.select(step.alias("step"), "term", F.round("estimate", 5).alias("estimate"))


@query("lasso_path_wide")
def lasso_path_wide_query(spark, d):
    rows = lines(spark, d)
    return regress.coefficient_path(rows, F.col(Y), wide(rows), LAMBDAS, 1.0)


def grams_of(spark, d):
    rows = lines(spark, d)
    cols = wide(rows)
    return regress.fold_grams(rows, F.col(Y), cols, regress.fold_column(KEYS)).persist(), list(cols)


@query("lasso_cv")
def lasso_cv_query(spark, d):
    grams, _ = grams_of(spark, d)
    return regress.cv_curve(regress.penalised(grams, LAMBDAS, 1.0), grams)


@query("lasso_refit")
def lasso_refit_query(spark, d):
    grams, names = grams_of(spark, d)
    return regress.best_refit(grams, names, LAMBDAS, 1.0)


@query("relaxed_lasso")
def relaxed_lasso_query(spark, d):
    grams, names = grams_of(spark, d)
    return regress.relaxed(grams, names, LAMBDAS)[1]


@query("ridge", f"""WITH {BASE}, m AS (SELECT avg(x1) AS mx, avg(y) AS my, sqrt(var_pop(x1)) AS sx, sqrt(var_pop(y)) AS sy, covar_pop(x1, y) / sqrt(var_pop(x1)) AS r FROM b),
l AS (SELECT i, power(10.0::DOUBLE, 10 - 0.12::DOUBLE * i) AS lam FROM range(0, 101) t(i)),
c AS (SELECT i, r / (1 + lam / sy) / sx AS b, mx, my FROM l, m)
SELECT CAST(i AS INTEGER) AS step, '(Intercept)' AS term, round(my - b * mx, 5) AS estimate FROM c UNION ALL SELECT CAST(i AS INTEGER), 'x1', round(b, 5) FROM c""")
def ridge_query(spark, d):
    path = regress.coefficient_path(lines(spark, d), F.col(Y), one(), LAMBDAS, 0.0)
    step = F.round((10 - F.log10("lambda")) / 0.12).cast("int")
    return path.select(step.alias("step"), "term", F.round("estimate", 5).alias("estimate"))


@query("ridge_cv")
def ridge_cv_query(spark, d):
    grams, _ = grams_of(spark, d)
    return regress.cv_curve(regress.penalised(grams, LAMBDAS, 0.0), grams)


@query("ridge_refit")
def ridge_refit_query(spark, d):
    grams, names = grams_of(spark, d)
    return regress.best_refit(grams, names, LAMBDAS, 0.0)


@query("pcr")
def pcr_query(spark, d):
    grams, names = grams_of(spark, d)
    return regress.pcr_cv(grams, len(names))


_R = {"x1": "l_quantity", "x2": "p_retailprice", "x3": "l_discount"}


@query("best_subset", f"""WITH {BASE}, c AS (SELECT corr(x1, y) AS a1, corr(x2, y) AS a2, corr(x3, y) AS a3, corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23,
  var_pop(y) * count(*) AS sst FROM b),
s AS (SELECT 1 AS size, 'x1' AS variables, a1 * a1 AS r2, sst FROM c UNION ALL SELECT 1, 'x2', a2 * a2, sst FROM c UNION ALL SELECT 1, 'x3', a3 * a3, sst FROM c
 UNION ALL SELECT 2, 'x1, x2', (a1 * a1 + a2 * a2 - 2 * a1 * a2 * r12) / (1 - r12 * r12), sst FROM c
 UNION ALL SELECT 2, 'x1, x3', (a1 * a1 + a3 * a3 - 2 * a1 * a3 * r13) / (1 - r13 * r13), sst FROM c
 UNION ALL SELECT 2, 'x2, x3', (a2 * a2 + a3 * a3 - 2 * a2 * a3 * r23) / (1 - r23 * r23), sst FROM c)
SELECT size, arg_max(variables, r2) AS variables, round(max(r2), 8) AS r2 FROM s GROUP BY size""")
def best_subset_query(spark, d):
    out = regress.best_subset(lines(spark, d), F.col(Y), {n: F.col(c) for n, c in _R.items()}, 2)
    return out.select("size", "variables", F.round("r2", 8).alias("r2"))


@query("best_subset_wide")
def best_subset_wide_query(spark, d):
    rows = lines(spark, d)
    return regress.best_subset(rows, F.col(Y), wide(rows), 16)


PRED = "l_quantity * p_retailprice"
PJ = f"(SELECT {Y} AS a, {PRED} AS p, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey)"


def predicted():
    return F.col("l_quantity") * F.col("p_retailprice")


@query("baseline_mse", f"""SELECT round(avg(power((SELECT avg(a) FROM {PJ} WHERE l_shipdate < TIMESTAMP '2000-01-01') - a, 2)), 0) AS baseline_mse,
  round(avg(power(p - a, 2)), 0) AS model_mse FROM {PJ} WHERE l_shipdate >= TIMESTAMP '2000-01-01'""")
def baseline_mse_query(spark, d):
    rows = lines(spark, d)
    early = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    out = regress.baseline_mse(rows.filter(early), rows.filter(~early), F.col(Y), predicted())
    return rounded(out, 0, "baseline_mse", "model_mse")


@query("metrics_caret", f"SELECT round(power(corr(a, p), 2), 8) AS r2, round(sqrt(avg(power(p - a, 2))), 4) AS rmse, round(avg(abs(p - a)), 4) AS mae FROM {PJ}")
def metrics_caret_query(spark, d):
    return rounded(rounded(regress.metrics(lines(spark, d), F.col(Y), predicted()), 8, "r2"), 4, "rmse", "mae")


@query("metrics_sse", f"SELECT round(sqrt(avg(power(p - a, 2))), 4) AS rmse, round(1 - sum(power(p - a, 2)) / (var_pop(a) * count(*)), 8) AS r_square FROM {PJ}")
def metrics_sse_query(spark, d):
    return rounded(rounded(regress.metrics_sse(lines(spark, d), F.col(Y), predicted()), 4, "rmse"), 8, "r_square")


@query("error_profile", f"""SELECT round(avg(p - a), 4) AS bias_mean, round(median(p - a), 4) AS bias_median, round(max(abs(p - a)), 4) AS max_abs,
  round(avg(abs(p - a)), 4) AS mean_abs, round(median(abs(p - a)), 4) AS median_abs, round(avg(power(p - a, 2)), 0) AS mse FROM {PJ}""")
def error_profile_query(spark, d):
    out = regress.error_profile(lines(spark, d), F.col(Y), predicted())
    return rounded(rounded(out, 0, "mse"), 4, "bias_mean", "bias_median", "max_abs", "mean_abs", "median_abs")


@query("vif", MOM + " SELECT unnest(['x1', 'x2']) AS term, round(1 / (1 - s12 * s12 / (s11 * s22)), 8) AS vif FROM m")
def vif_query(spark, d):
    return rounded(regress.vif(lines(spark, d), two()), 8, "vif")


@query("breusch_pagan", ONE + " SELECT round(count(*) * power(corr(resid * resid, x1), 2), 5) AS statistic, 1::BIGINT AS df FROM r")
def breusch_pagan_query(spark, d):
    return rounded(regress.breusch_pagan(lines(spark, d), F.col(Y), one()).drop("p_value"), 5, "statistic")


@query("influence", ONE + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(cook, 9) AS cook, round(hat, 9) AS hat, cook > 4.0::DOUBLE / n AS high_cook,
  hat > 4.0::DOUBLE / n AS high_hat FROM k WHERE cook > 4.0::DOUBLE / n OR hat > 4.0::DOUBLE / n""")
def influence_query(spark, d):
    out = regress.influence(lines(spark, d), F.col(Y), one())
    return rounded(out.select(*KEYS, "cook", "hat", "high_cook", "high_hat"), 9, "cook", "hat")


@query("mahalanobis", """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS a, var_samp(l_extendedprice) AS c,
  covar_samp(l_quantity, l_extendedprice) AS b FROM lineitem),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (c * (l_quantity - mx) * (l_quantity - mx) - 2 * b * (l_quantity - mx) * (l_extendedprice - my)
  + a * (l_extendedprice - my) * (l_extendedprice - my)) / (a * c - b * b) AS d2 FROM lineitem, m),
z AS (SELECT *, (d2 - avg(d2) OVER ()) / stddev_samp(d2) OVER () AS z, count(*) OVER () AS n FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(d2, 7) AS d2, round(z * sqrt(n - 2) / sqrt(n - 1 - z * z), 7) AS d2_t FROM z
WHERE z * sqrt(n - 2) / sqrt(n - 1 - z * z) > 2""")
def mahalanobis_query(spark, d):
    out = regress.mahalanobis(Tables(spark, d).lineitem, ["l_quantity", "l_extendedprice"]).filter("d2_t > 2")
    return rounded(out.select(*KEYS, "d2", "d2_t"), 7, "d2", "d2_t").orderBy(F.col("d2").desc())


@query("resid_diag", ONE + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(fitted, 4) AS fitted, round(resid, 4) AS resid, round(std_resid, 7) AS std_resid,
  round(sqrt(abs(std_resid)), 7) AS root_abs FROM k""")
def resid_diag_query(spark, d):
    out = regress.resid_diag(lines(spark, d), F.col(Y), one()).select(*KEYS, "fitted", "resid", "std_resid", "root_abs")
    return rounded(rounded(out, 4, "fitted", "resid"), 7, "std_resid", "root_abs")
