"""Logistic models, trees, forests and clusters on order lines joined with their part."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import clusters, mlmodels, regress
from statloom.operators.recode import design_columns
from statloom.plans.models_linear import KEYS, lines, wide
from statloom.plans.registry import query
from statloom.plans.tables_grouped import rounded
from statloom.sources import Tables


def base_cost():
    """Quantity times list price: a target the features can explain."""
    return F.col("l_quantity") * F.col("p_retailprice")


def numeric():
    return {n: F.col(n) for n in ("l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice")}


LOGIT = """WITH RECURSIVE b AS (SELECT l_quantity / 10 AS x, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem),
g AS (SELECT x, sum(y) AS s, count(*)::DOUBLE AS n FROM b GROUP BY x),
it(i, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, b0 + (i11 * u0 - i01 * u1) / (i00 * i11 - i01 * i01), b1 + (i00 * u1 - i01 * u0) / (i00 * i11 - i01 * i01) FROM (
    SELECT i, b0, b1, sum(s - n * p) AS u0, sum(x * (s - n * p)) AS u1, sum(n * p * (1 - p)) AS i00, sum(n * x * p * (1 - p)) AS i01, sum(n * x * x * p * (1 - p)) AS i11
    FROM (SELECT i, b0, b1, x, s, n, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM it, g) GROUP BY i, b0, b1) WHERE i < 12),
f AS (SELECT b0, b1 FROM it WHERE i = 12),
e AS (SELECT b0, b1, sum(n * p * (1 - p)) AS i00, sum(n * x * p * (1 - p)) AS i01, sum(n * x * x * p * (1 - p)) AS i11,
  sum(s * ln(p) + (n - s) * ln(1 - p)) AS ll FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM f, g) GROUP BY b0, b1)
SELECT '(Intercept)' AS term, round(b0, 7) AS estimate, round(sqrt(i11 / (i00 * i11 - i01 * i01)), 7) AS std_error, round(4 - 2 * ll, 4) AS aic FROM e
UNION ALL SELECT 'x', round(b1, 7), round(sqrt(i00 / (i00 * i11 - i01 * i01)), 7), round(4 - 2 * ll, 4) FROM e"""


@query("logistic", LOGIT)
def logistic_query(spark, d):
    out = mlmodels.logistic(Tables(spark, d).lineitem, F.col("l_returnflag") == "R", {"x": F.col("l_quantity") / 10})
    return rounded(rounded(out.select("term", "estimate", "std_error", "aic"), 7, "estimate", "std_error"), 4, "aic")


@query("step_aic")
def step_aic_query(spark, d):
    rows = lines(spark, d)
    flags = design_columns(rows, [], ["l_linestatus"], intercept=False)
    return mlmodels.step_logistic(rows, F.col("l_returnflag") == "R", {
        "quantity": {"q": F.col("l_quantity")}, "discount": {"d": F.col("l_discount")}, "status": {n: c for n, c in flags.items()}})


@query("predict_class", """WITH tr AS (SELECT l_returnflag AS f, avg((l_linestatus = 'O')::INT::DOUBLE) AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1),
s AS (SELECT (p > 0.5)::INT AS predicted, (l_linestatus = 'O')::INT AS actual FROM lineitem JOIN tr ON l_returnflag = f WHERE l_shipdate >= TIMESTAMP '2000-01-01')
SELECT predicted, actual, count(*) AS n, round((SELECT avg((predicted = actual)::INT::DOUBLE) FROM s), 8) AS accuracy FROM s GROUP BY 1, 2""")
def predict_class_query(spark, d):
    """A factor as only predictor: scores are the training shares, which the SQL computes directly."""
    li = Tables(spark, d).lineitem
    early = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    cols = design_columns(li, [], ["l_returnflag"], intercept=False)
    out = mlmodels.predict_class(li.filter(early), li.filter(~early), F.col("l_linestatus") == "O", cols)
    return rounded(out, 8, "accuracy")


@query("random_forest")
def random_forest_query(spark, d):
    rows = lines(spark, d)
    train = regress.fold_column(KEYS, 4) != 0
    pred, _ = mlmodels.forest(rows.filter(train), rows.filter(~train), base_cost(), wide(rows))
    return regress.metrics(pred, F.col("label"), F.col("prediction"))


@query("forest_importance")
def forest_importance_query(spark, d):
    rows = lines(spark, d)
    train = regress.fold_column(KEYS, 4) != 0
    return mlmodels.forest(rows.filter(train), rows.filter(~train), base_cost(), wide(rows))[1]


@query("decision_tree")
def decision_tree_query(spark, d):
    rows = lines(spark, d)
    return mlmodels.decision_tree(rows, base_cost(), wide(rows), cp=0.01)


@query("tree_tune")
def tree_tune_query(spark, d):
    rows = lines(spark, d)
    return mlmodels.tree_tune(rows, base_cost(), numeric(), KEYS, [i / 100 for i in range(1, 51)])


def cluster_columns():
    return {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice") / 1000, "discount": F.col("l_discount") * 100}


@query("kmeans")
def kmeans_query(spark, d):
    return clusters.kmeans(Tables(spark, d).lineitem, cluster_columns(), [2, 3])


@query("kmeans_wss")
def kmeans_wss_query(spark, d):
    return clusters.kmeans_wss(Tables(spark, d).lineitem, cluster_columns(), 10)


@query("kmeans_wss_one", """SELECT 1 AS k, round((var_pop(l_quantity) + var_pop(l_extendedprice / 1000) + var_pop(l_discount * 100)) * count(*), 2) AS wss FROM lineitem""")
def kmeans_wss_one_query(spark, d):
    out = clusters.kmeans_wss(Tables(spark, d).lineitem, cluster_columns(), 1)
    return rounded(out, 2, "wss")


@query("kmeans_silhouette")
def kmeans_silhouette_query(spark, d):
    return clusters.kmeans_silhouette(Tables(spark, d).lineitem, cluster_columns(), 10)


@query("kmeans_gap")
def kmeans_gap_query(spark, d):
    return clusters.kmeans_gap(Tables(spark, d).lineitem, cluster_columns(), 10, references=50, starts=25)


@query("gmm_bic")
def gmm_bic_query(spark, d):
    return mlmodels.gmm_models(Tables(spark, d).lineitem, cluster_columns(), list(range(1, 10)))[0]


@query("gmm_classes")
def gmm_classes_query(spark, d):
    return mlmodels.gmm_models(Tables(spark, d).lineitem, cluster_columns(), list(range(1, 10)))[1]
