"""Aggregations, tabulation, windows, sorts and scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import scalars as X
from statloom.functions.ordered import quantiles
from statloom.operators import joins, recode, tabulate, windows
from statloom.plans.registry import query
from statloom.plans.tables_basic import HOLES, orders_with_holes
from statloom.sources import Tables

DAILY = "SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2"


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("group_stats", f"""
SELECT o_orderstatus, {HOLES} AS o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean,
  round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1, 2""")
def group_stats_query(spark, d):
    return rounded(tabulate.group_stats(orders_with_holes(Tables(spark, d)), ["o_orderstatus", "o_orderpriority"],
                                        "o_totalprice"), 4, "mean", "median")


@query("group_sum", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(quarter(o_orderdate) AS INTEGER) AS qtr, o_orderpriority,
  CASE WHEN count(*) = count(nullif(o_totalprice, (SELECT max(o_totalprice) FROM orders)))
       THEN round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY 1, 2, 3""")
def group_sum_query(spark, d):
    """Quarterly totals in which one null input (the largest price) makes its whole group null."""
    o = recode.with_constants(Tables(spark, d).orders, top=F.max("o_totalprice"))
    value = F.nullif(F.col("o_totalprice"), F.col("top"))
    return rounded(tabulate.group_sum(o, [F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("qtr"),
                                          "o_orderpriority"], value), 2, "total")


@query("group_count", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def group_count_query(spark, d):
    return tabulate.group_count(Tables(spark, d).orders, [F.to_date("o_orderdate").alias("day")])


@query("freq_table", f"""
SELECT 'o_orderstatus' AS variable, o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', {HOLES}, count(*) FROM orders WHERE {HOLES} IS NOT NULL GROUP BY 2""")
def freq_table_query(spark, d):
    return tabulate.freq_table(orders_with_holes(Tables(spark, d)), ["o_orderstatus", "o_orderpriority"])


@query("crosstab", """
WITH s AS (SELECT c_nationkey, c_mktsegment, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band FROM customer),
cells AS (SELECT * FROM (SELECT DISTINCT c_nationkey FROM s), (SELECT DISTINCT c_mktsegment FROM s), (SELECT DISTINCT band FROM s))
SELECT c_nationkey, c_mktsegment, band, count(s.band) AS n FROM cells LEFT JOIN s
USING (c_nationkey, c_mktsegment, band) GROUP BY 1, 2, 3""")
def crosstab_query(spark, d):
    """Customers by nation, segment and balance band; combinations that no customer has are empty cells."""
    band = F.floor(F.col("c_acctbal") / 1000).cast("bigint")
    return tabulate.crosstab(Tables(spark, d).customer.withColumn("band", band), ["c_nationkey", "c_mktsegment", "band"])


@query("crosstab_wide", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
  count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def crosstab_wide_query(spark, d):
    return tabulate.crosstab_wide(Tables(spark, d).orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("prop_total", "SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY 1")
def prop_total_query(spark, d):
    return rounded(tabulate.add_share(tabulate.group_count(Tables(spark, d).orders, ["o_orderstatus"])), 8, "share")


@query("prop_row", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) * 100, 2) AS percent FROM orders GROUP BY 1, 2""")
def prop_row_query(spark, d):
    table = tabulate.crosstab(Tables(spark, d).orders, ["o_orderpriority", "o_orderstatus"])
    return tabulate.add_share(table, ["o_orderpriority"], out="percent", percent_digits=2)


@query("dominant_levels", """
WITH f AS (SELECT 'l_returnflag' AS variable, l_returnflag AS level, count(*) AS n FROM lineitem GROUP BY 2
 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
 UNION ALL SELECT 'bulk', CASE WHEN l_quantity > 4 THEN 'yes' ELSE 'no' END, count(*) FROM lineitem GROUP BY 2)
SELECT variable, level, n, round(share, 8) AS share FROM (
  SELECT *, n / sum(n) OVER (PARTITION BY variable) AS share FROM f) WHERE share >= 0.85""")
def dominant_levels_query(spark, d):
    li = Tables(spark, d).lineitem.withColumn("bulk", F.when(F.col("l_quantity") > 4, "yes").otherwise("no"))
    return rounded(tabulate.dominant_levels(li, ["l_returnflag", "l_linestatus", "bulk"]), 8, "share")


@query("quantiles", " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS prob, round(quantile_cont(l_extendedprice, {p}), 4) AS q FROM lineitem"
    for p in (0.0, 0.25, 0.5, 0.75, 1.0)))
def quantiles_query(spark, d):
    q = quantiles(Tables(spark, d).lineitem, ["l_extendedprice"], [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select("prob", F.round("q", 4).alias("q"))


_DECILES = [i / 10 for i in range(11)]


@query("quantile_table", " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS prob, " + ", ".join(f"round(quantile_cont({c}, {p}), 4) AS {c}" for c in
                                                ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem"
    for p in _DECILES))
def quantile_table_query(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(tabulate.quantile_table(Tables(spark, d).lineitem, cols, _DECILES), 4, *cols)


@query("corr_pair", """
SELECT round(corr(l_quantity, l_extendedprice), 8) AS r,
  round(corr(l_quantity * p_retailprice, l_extendedprice), 8) AS r_expr FROM lineitem JOIN part ON l_partkey = p_partkey""")
def corr_pair_query(spark, d):
    t = Tables(spark, d)
    rows = joins.left_chain(t.lineitem, [(t.part, ["p_retailprice"], [("l_partkey", "p_partkey")])])
    return rows.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"),
                    F.round(F.corr(F.col("l_quantity") * F.col("p_retailprice"), F.col("l_extendedprice")), 8).alias("r_expr"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(corr({a}, {b}), 8) AS r FROM lineitem" for a in _NUM for b in _NUM))
def corr_matrix_query(spark, d):
    return rounded(tabulate.corr_matrix(Tables(spark, d).lineitem, _NUM), 8, "r")


@query("cov_means", " UNION ALL ".join(
    f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(avg({a}), 6) AS mean_i, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem"
    for a in ("l_quantity", "l_discount", "l_tax") for b in ("l_quantity", "l_discount", "l_tax")))
def cov_means_query(spark, d):
    return rounded(rounded(tabulate.cov_means(Tables(spark, d).lineitem, ["l_quantity", "l_discount", "l_tax"]), 6, "mean_i"), 4, "cov")


@query("histogram", """
WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders)
SELECT o_orderstatus, bin, round(lo + bin * w, 4) AS bin_start, count(*) AS n FROM (
 SELECT o_orderstatus, lo, w, CAST(least(floor((o_totalprice - lo) / w), 29) AS INTEGER) AS bin FROM orders, s)
GROUP BY o_orderstatus, bin, lo, w""")
def histogram_query(spark, d):
    return rounded(tabulate.histogram(Tables(spark, d).orders, "o_totalprice", 30, ["o_orderstatus"]), 4, "bin_start")


@query("group_bars", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median,
  format('{:,}', CAST(round(median(o_totalprice)) AS BIGINT)) AS label FROM orders GROUP BY 1, 2""")
def group_bars_query(spark, d):
    return rounded(tabulate.group_bars(Tables(spark, d).orders, "o_orderpriority", "o_orderstatus", "o_totalprice"), 4, "mean", "median")


@query("hier_rollup", """
WITH r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, p_type, l_extendedprice * (1 - l_discount) AS v
           FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT month, p_type, round(sum(v), 4) AS total, grouping(p_type) = 1 AS is_aggregated
FROM r GROUP BY GROUPING SETS ((month, p_type), (month))""")
def hier_rollup_query(spark, d):
    t = Tables(spark, d)
    rows = joins.left_chain(t.lineitem, [(t.part, ["p_type"], [("l_partkey", "p_partkey")])]).withColumn(
        "month", F.to_date(F.date_trunc("month", "l_shipdate")))
    out = tabulate.hier_rollup(rows, ["month"], ["p_type"], F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return out.select("month", "p_type", F.round("total", 4).alias("total"), "is_aggregated")


@query("confusion", """
WITH r AS (SELECT CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END AS predicted, l_returnflag AS actual FROM lineitem)
SELECT predicted, actual, count(*) AS n, round((SELECT avg(CASE WHEN predicted = actual THEN 1.0::DOUBLE ELSE 0 END) FROM r), 8) AS accuracy
FROM r GROUP BY predicted, actual""")
def confusion_query(spark, d):
    li = Tables(spark, d).lineitem.select(F.when(F.col("l_quantity") > 25, "R").otherwise("A").alias("predicted"),
                                          F.col("l_returnflag").alias("actual"))
    return rounded(tabulate.confusion(li, "predicted", "actual"), 8, "accuracy")


@query("scalar_agg", """
SELECT round(avg(x), 4) AS mean, round(max(x), 4) AS max, round(sum(x), 2) AS total, round(median(x), 4) AS median
FROM (SELECT abs(l_extendedprice - l_quantity * 1000) AS x FROM lineitem)""")
def scalar_agg_query(spark, d):
    li = Tables(spark, d).lineitem.withColumn("x", F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000))
    return rounded(rounded(tabulate.scalar_summary(li, "x"), 4, "mean", "max", "median"), 2, "total")


# ---------------------------------------------------------------- windows, sorts, sets

@query("diff_lag", f"""
SELECT key, day, round(y - lag(y) OVER (PARTITION BY key ORDER BY day), 2) AS diff FROM ({DAILY})""")
def diff_lag_query(spark, d):
    daily = Tables(spark, d).orders.groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("y"))
    return windows.diff_lag(daily, ["key"], "day", "y").select("key", "day", F.round("diff", 2).alias("diff"))


@query("zscore", """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS c_acctbal_z FROM customer""")
def zscore_query(spark, d):
    return rounded(windows.z_scores(Tables(spark, d).customer, ["c_acctbal"]).select("c_custkey", "c_acctbal_z"), 6, "c_acctbal_z")


@query("tscore", """
WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z, count(*) OVER () AS n FROM customer)
SELECT c_custkey, round(z * sqrt(n - 2) / sqrt(n - 1 - z * z), 6) AS t FROM z""")
def tscore_query(spark, d):
    return rounded(windows.t_scores(Tables(spark, d).customer, "c_acctbal").select("c_custkey", "t"), 6, "t")


@query("sort_rows", f"""
SELECT o_orderkey, {HOLES} AS o_orderpriority, o_totalprice FROM orders ORDER BY 2 DESC NULLS LAST, 3""")
def sort_rows_query(spark, d):
    o = orders_with_holes(Tables(spark, d)).select("o_orderkey", "o_orderpriority", "o_totalprice")
    return windows.sort_rows(o, ["-o_orderpriority", "o_totalprice"])


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def top_k_query(spark, d):
    return windows.top_k(Tables(spark, d).orders.select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"])


@query("union_rows", """
SELECT 'customer' AS kind, c_nationkey AS nationkey, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""")
def union_rows_query(spark, d):
    t = Tables(spark, d)
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nationkey"))
    return a.unionByName(b)


@query("set_minus_rows", """
SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL
SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) <= 2000""")
def set_minus_rows_query(spark, d):
    """Rows outside the training set: the flag is negated, no anti-join is needed."""
    o = Tables(spark, d).orders.withColumn("train", F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return o.filter(~F.col("train")).select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- scalar functions

@query("str_replace", "SELECT o_orderkey, regexp_replace(o_orderpriority, '^[0-9]-', '', 'g') AS label FROM orders")
def str_replace_query(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("label"))


@query("parse_date", """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def parse_date_query(spark, d):
    text = F.when(F.col("o_orderpriority") == "5-LOW", "not a date").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return Tables(spark, d).orders.select("o_orderkey", X.to_day(text).alias("day"))


@query("date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(quarter(o_orderdate) AS INTEGER) AS qtr,
  CAST(month(o_orderdate) AS INTEGER) AS mon FROM orders""")
def date_parts_query(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("qtr"),
                                          F.month("o_orderdate").alias("mon"))


@query("weekday_flag", """
SELECT o_orderkey, strftime(o_orderdate, '%a') AS day_name, isodow(o_orderdate) >= 6 AS weekend FROM orders""")
def weekday_flag_query(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", X.day_name(F.col("o_orderdate")).alias("day_name"),
                                          X.is_weekend(F.col("o_orderdate")).alias("weekend"))


@query("math_fns", """
SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, round(abs(o_totalprice - 250000), 2) AS gap,
  round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 6) AS lg, round(exp(o_totalprice / 1e6::DOUBLE), 6) AS ex,
  round(power(o_totalprice, 0.3::DOUBLE), 6) AS pw, round(1 / (1 + exp(-(o_totalprice / 1e6::DOUBLE))), 6) AS expit FROM orders""")
def math_fns_query(spark, d):
    p = F.col("o_totalprice")
    return Tables(spark, d).orders.select(
        "o_orderkey", F.floor(p / 1000).alias("thousands"), F.round(F.abs(p - 250000), 2).alias("gap"),
        F.round(F.sqrt(p), 6).alias("root"), F.round(F.log(p), 6).alias("lg"), F.round(F.exp(p / 1e6), 6).alias("ex"),
        F.round(F.pow(p, F.lit(0.3)), 6).alias("pw"), F.round(X.expit(p / 1e6), 6).alias("expit"))


@query("format_num", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS label FROM orders")
def format_num_query(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", X.comma(F.floor("o_totalprice")).alias("label"))
