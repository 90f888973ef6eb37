"""Sources, profiling, projections, recodes, filters and joins on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import scalars as X
from statloom.operators import joins, profile, recode, tabulate
from statloom.plans.registry import query
from statloom.session import fresh_path
from statloom.sources import Tables, rename_clean, scan_csv, sink_csv

HOLES = "nullif(o_orderpriority, '5-LOW')"


def orders_with_holes(t):
    """orders with one priority and the zero-free price band turned to null, to exercise null rules."""
    return t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))


# ---------------------------------------------------------------- sources and profiling

@query("scan_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders""")
def scan_csv_query(spark, d):
    src = orders_with_holes(Tables(spark, d)).withColumn("o_orderdate", F.to_date("o_orderdate"))
    path = sink_csv(src, fresh_path(spark, "orders-csv"))
    return scan_csv(spark, path, src.schema)


@query("sink_csv", "SELECT p_type, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY p_type")
def sink_csv_query(spark, d):
    table = Tables(spark, d).part.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))
    return scan_csv(spark, sink_csv(table, fresh_path(spark, "types-csv")), table.schema)


@query("rename_clean", """
SELECT s_suppkey AS Supplier_Key, s_name AS Supplier_Name_Text, s_acctbal AS Account_Balance FROM supplier""")
def rename_clean_query(spark, d):
    spaced = Tables(spark, d).supplier.select(
        F.col("s_suppkey").alias("Supplier Key"), F.col("s_name").alias("Supplier Name Text"),
        F.col("s_acctbal").alias("Account Balance"))
    return rename_clean(spaced)


@query("table_shape", """
SELECT p AS position, v AS variable, k AS kind, (SELECT count(*) FROM orders) AS n_rows, 6 AS n_cols
FROM (VALUES (1, 'o_orderkey', 'integer'), (2, 'o_custkey', 'integer'), (3, 'o_orderstatus', 'character'),
             (4, 'o_totalprice', 'numeric'), (5, 'o_orderdate', 'date'), (6, 'o_orderpriority', 'character')) s(p, v, k)""")
def table_shape_query(spark, d):
    return profile.table_shape(Tables(spark, d).orders)


_DESC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, round(min({e}), 4) AS min, round(quantile_cont({e}, 0.25), 4) AS q1,
       round(quantile_cont({e}, 0.5), 4) AS median, round(avg({e}), 4) AS mean,
       round(quantile_cont({e}, 0.75), 4) AS q3, round(max({e}), 4) AS max,
       count(*) - count({e}) AS n_missing FROM lineitem"""
    for c, e in ((c, "nullif(l_discount, 0)" if c == "l_discount" else c) for c in _DESC)))
def describe_query(spark, d):
    t = Tables(spark, d).lineitem.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    out = profile.describe(t, _DESC)
    return out.select("variable", "n_missing", *[F.round(c, 4).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")])


@query("null_audit", f"""
SELECT 'o_orderkey' AS variable, count(*) - count(o_orderkey) AS n_missing FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) - count({HOLES}) FROM orders
UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice) FROM orders""")
def null_audit_query(spark, d):
    return profile.null_audit(orders_with_holes(Tables(spark, d)), ["o_orderkey", "o_orderpriority", "o_totalprice"])


@query("row_index", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders")
def row_index_query(spark, d):
    return profile.row_index(Tables(spark, d).orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values_query(spark, d):
    return profile.distinct_values(Tables(spark, d).orders, "o_orderpriority")


@query("count_distinct", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS n_levels FROM part" for c in ("p_brand", "p_type", "p_size", "p_name")))
def count_distinct_query(spark, d):
    return profile.count_distinct(Tables(spark, d).part, ["p_brand", "p_type", "p_size", "p_name"])


# ---------------------------------------------------------------- projections and recodes

@query("select_cols", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def select_cols_query(spark, d):
    return recode.by_position(Tables(spark, d).orders, [1, 3, 6])


@query("drop_cols", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_cols_query(spark, d):
    return Tables(spark, d).orders.drop("o_orderstatus", "o_orderdate", "o_orderpriority")


@query("rename_cols", "SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_acctbal FROM customer")
def rename_cols_query(spark, d):
    return (Tables(spark, d).customer.select(F.col("c_custkey").alias("customer_id"), "c_mktsegment", "c_acctbal")
            .withColumnRenamed("c_mktsegment", "segment"))


@query("select_by_type", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_by_type_query(spark, d):
    return recode.select_by_type(Tables(spark, d).part, "numeric")


@query("reorder_cols", "SELECT o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def reorder_cols_query(spark, d):
    return recode.first_column(Tables(spark, d).orders, "o_totalprice")


@query("select_from_table", "SELECT l_quantity, l_discount FROM lineitem")
def select_from_table_query(spark, d):
    """Keep the measures whose largest value is at most 50 (quantity and discount, not tax by name list)."""
    li = Tables(spark, d).lineitem
    stats = profile.describe(li, ["l_quantity", "l_extendedprice", "l_discount"])
    return recode.select_listed(li, stats.filter(F.col("max") <= 50), "variable")


@query("derive_arith", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
       round(l_extendedprice - l_quantity * 900, 4) AS over_base,
       round(100 * l_discount / (1 + l_tax), 6) AS discount_pct,
       round(0.7 * l_quantity + 0.3 * l_extendedprice, 5) AS score
FROM lineitem""")
def derive_arith_query(spark, d):
    p, q, disc, tax = (F.col(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax"))
    return Tables(spark, d).lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(p * (1 - disc) * (1 + tax), 6).alias("charge"),
        F.round(p - q * 900, 4).alias("over_base"),
        F.round(100 * disc / (1 + tax), 6).alias("discount_pct"),
        F.round(0.7 * q + 0.3 * p, 5).alias("score"))


@query("cast_cols", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust_text, round(o_totalprice) AS price_back,
       CAST(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE left(o_orderpriority, 1) END AS DOUBLE) AS level_no
FROM orders""")
def cast_cols_query(spark, d):
    """Text with thousands commas back to a number, a key to text, a leading digit to a number."""
    return Tables(spark, d).orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("cust_text"),
        X.text_to_number(X.comma(F.round("o_totalprice"))).alias("price_back"),
        X.text_to_number(F.when(F.col("o_orderpriority") == "5-LOW", "n/a")
                         .otherwise(F.substring("o_orderpriority", 1, 1))).alias("level_no"))


@query("bin_ranges", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice <= 100000 THEN '0-100k'
  WHEN o_totalprice > 100000 AND o_totalprice <= 200000 THEN '>100-200k'
  WHEN o_totalprice >= 200001 AND o_totalprice <= 400000 THEN '>200-400k' END AS price_group FROM orders""")
def bin_ranges_query(spark, d):
    groups = [(0, True, 100000, True, "0-100k"), (100000, False, 200000, True, ">100-200k"),
              (200001, True, 400000, True, ">200-400k")]
    return Tables(spark, d).orders.select("o_orderkey", recode.bin_ranges(F.col("o_totalprice"), groups).alias("price_group"))


@query("cap_counts", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber >= 0 AND l_linenumber < 4 THEN l_linenumber
  WHEN l_linenumber >= 4 AND l_linenumber <= 6 THEN 4 END AS line_group FROM lineitem""")
def cap_counts_query(spark, d):
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                            recode.cap_counts(F.col("l_linenumber"), 4, 6).alias("line_group"))


@query("regroup_levels", f"""
SELECT o_orderkey, CASE WHEN {HOLES} IN ('1-URGENT', '2-HIGH') THEN 'top' WHEN {HOLES} IN ('2-HIGH', '3-MEDIUM') THEN 'middle'
  ELSE {HOLES} END AS priority_group FROM orders""")
def regroup_levels_query(spark, d):
    return orders_with_holes(Tables(spark, d)).select(
        "o_orderkey", recode.regroup(F.col("o_orderpriority"), {"top": ["1-URGENT", "2-HIGH"],
                                                                "middle": ["2-HIGH", "3-MEDIUM"]}).alias("priority_group"))


@query("recode_binary", f"""
SELECT o_orderkey, CASE WHEN {HOLES} = '1-URGENT' THEN 1 WHEN {HOLES} IS NOT NULL THEN 0 END AS urgent FROM orders""")
def recode_binary_query(spark, d):
    return orders_with_holes(Tables(spark, d)).select(
        "o_orderkey", recode.recode_binary(F.col("o_orderpriority"), "1-URGENT").alias("urgent"))


@query("collapse_factor", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'industry'
  WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'home' ELSE c_mktsegment END AS segment FROM customer""")
def collapse_factor_query(spark, d):
    levels = {"BUILDING": "industry", "MACHINERY": "industry", "HOUSEHOLD": "home", "FURNITURE": "home"}
    return Tables(spark, d).customer.select("c_custkey", recode.collapse(F.col("c_mktsegment"), levels).alias("segment"))


@query("ordered_factor", """
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3
  WHEN '1-URGENT' THEN 4 END AS priority_rank FROM orders""")
def ordered_factor_query(spark, d):
    return Tables(spark, d).orders.select(
        "o_orderkey", recode.ordinal(F.col("o_orderpriority"), ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]).alias("priority_rank"))


@query("relevel", """
SELECT 'c_mktsegment' || c_mktsegment AS term, CAST(count(*) AS DOUBLE) AS total FROM customer
WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_mktsegment""")
def relevel_query(spark, d):
    cust = Tables(spark, d).customer
    return recode.design_sums(cust, recode.design_columns(cust, [], {"c_mktsegment": "MACHINERY"}, intercept=False))


@query("fill_null", f"""
SELECT o_orderkey, coalesce({HOLES}, 'none') AS priority, coalesce(nullif(o_orderstatus, 'F'), o_orderpriority) AS status FROM orders""")
def fill_null_query(spark, d):
    status = F.nullif("o_orderstatus", F.lit("F"))
    src = Tables(spark, d).orders
    return src.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
                      F.coalesce(status, F.col("o_orderpriority")).alias("status")).fillna({"priority": "none"})


@query("decade_floor", "SELECT p_partkey, CAST(floor(p_size / 10.0::DOUBLE) * 10 AS BIGINT) AS size_decade FROM part")
def decade_floor_query(spark, d):
    return Tables(spark, d).part.select("p_partkey", X.floor_to(F.col("p_size"), 10).alias("size_decade"))


@query("design_matrix", """
SELECT '(Intercept)' AS term, CAST(count(*) AS DOUBLE) AS total FROM lineitem
UNION ALL SELECT 'l_quantity', round(sum(l_quantity), 4) FROM lineitem
UNION ALL SELECT 'l_discount', round(sum(l_discount), 4) FROM lineitem
UNION ALL SELECT 'l_returnflag' || l_returnflag, count(*)::DOUBLE FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus' || l_linestatus, count(*)::DOUBLE FROM lineitem WHERE l_linestatus <> 'F' GROUP BY l_linestatus""")
def design_matrix_query(spark, d):
    li = Tables(spark, d).lineitem
    sums = recode.design_sums(li, recode.design_columns(li, ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"]))
    return sums.withColumn("total", F.round("total", 4))


@query("cbind_results", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS actual,
       round(l_quantity * p_retailprice, 4) AS predicted, round(l_quantity * p_retailprice - l_extendedprice, 4) AS error
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def cbind_results_query(spark, d):
    t = Tables(spark, d)
    rows = joins.left_chain(t.lineitem, [(t.part, ["p_retailprice"], [("l_partkey", "p_partkey")])])
    pred = F.col("l_quantity") * F.col("p_retailprice")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("actual"),
                       F.round(pred, 4).alias("predicted"), F.round(pred - F.col("l_extendedprice"), 4).alias("error"))


# ---------------------------------------------------------------- filters

@query("filter_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 150000 AND o_orderpriority <> '5-LOW'")
def filter_compare_query(spark, d):
    o = Tables(spark, d).orders
    return o.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") <= 150000)
                    & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey", "o_totalprice")


@query("filter_in", f"SELECT o_orderkey, {HOLES} AS o_orderpriority FROM orders WHERE {HOLES} IN ('1-URGENT', '3-MEDIUM')")
def filter_in_query(spark, d):
    return recode.keep_in(orders_with_holes(Tables(spark, d)), "o_orderpriority", ["1-URGENT", "3-MEDIUM"]).select(
        "o_orderkey", "o_orderpriority")


@query("filter_not_in", f"""
SELECT o_orderkey, {HOLES} AS o_orderpriority FROM orders WHERE {HOLES} IS NULL OR {HOLES} NOT IN ('1-URGENT', '3-MEDIUM')""")
def filter_not_in_query(spark, d):
    return recode.keep_not_in(orders_with_holes(Tables(spark, d)), "o_orderpriority", ["1-URGENT", "3-MEDIUM"]).select(
        "o_orderkey", "o_orderpriority")


@query("filter_null", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def filter_null_query(spark, d):
    return orders_with_holes(Tables(spark, d)).filter(F.col("o_orderpriority").isNull()).select("o_orderkey")


@query("filter_bool", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem,
  (SELECT avg(l_extendedprice) AS m, count(*) AS n FROM lineitem)
WHERE l_extendedprice > 2 * m OR (l_discount > 4.0::DOUBLE / n AND l_quantity < 3)""")
def filter_bool_query(spark, d):
    li = recode.with_constants(Tables(spark, d).lineitem, m=F.avg("l_extendedprice"), n=F.count(F.lit(1)))
    return li.filter((F.col("l_extendedprice") > 2 * F.col("m"))
                     | ((F.col("l_discount") > 4.0 / F.col("n")) & (F.col("l_quantity") < 3))).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("filter_agg_level", """
SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def filter_agg_level_query(spark, d):
    o = Tables(spark, d).orders.withColumn("day", F.to_date("o_orderdate"))
    rows = tabulate.hier_rollup(o, ["day"], ["o_orderpriority"], F.col("o_totalprice"))
    return rows.filter("is_aggregated").select("day", F.round("total", 2).alias("total"))


@query("year_split", """
SELECT 'train' AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) <= 2000
UNION ALL SELECT 'test', count(*), round(sum(o_totalprice), 2) FROM orders WHERE year(o_orderdate) = 2001""")
def year_split_query(spark, d):
    o = Tables(spark, d).orders
    parts = [recode.up_to_year(o, "o_orderdate", 2000).withColumn("part", F.lit("train")),
             recode.in_year(o, "o_orderdate", 2001).withColumn("part", F.lit("test"))]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- joins

@query("join_left_chain", """
SELECT c.c_custkey, c.c_name, n.n_name, r.r_name, o.o_orderkey, o.o_totalprice
FROM (SELECT *, nullif(c_nationkey, 3) AS nk, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS ck FROM customer) c
LEFT JOIN (SELECT nullif(n_nationkey, 3) AS nk, n_name, n_regionkey FROM nation) n ON c.nk IS NOT DISTINCT FROM n.nk
LEFT JOIN region r ON n.n_regionkey IS NOT DISTINCT FROM r.r_regionkey
LEFT JOIN orders o ON c.ck IS NOT DISTINCT FROM o.o_custkey""")
def join_left_chain_query(spark, d):
    """Every customer with nation, region and orders; nation 3 and each fifth customer are turned into null keys."""
    t = Tables(spark, d)
    cust = t.customer.withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    nation = t.nation.withColumn("n_nationkey", F.nullif("n_nationkey", F.lit(3)))
    cust = cust.withColumn("ck", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")))
    return joins.left_chain(cust, [
        (nation, ["n_name", "n_regionkey"], [("c_nationkey", "n_nationkey")]),
        (t.region, ["r_name"], [("n_regionkey", "r_regionkey")]),
        (t.orders, ["o_orderkey", "o_totalprice"], [("ck", "o_custkey")]),
    ]).select("c_custkey", "c_name", "n_name", "r_name", "o_orderkey", "o_totalprice")


@query("join_left_lookup", """
SELECT p_type, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY p_type, n_name""")
def join_left_lookup_query(spark, d):
    t = Tables(spark, d)
    rows = joins.left_chain(t.lineitem, [
        (t.part, ["p_type"], [("l_partkey", "p_partkey")]),
        (t.supplier, ["s_nationkey"], [("l_suppkey", "s_suppkey")]),
        (t.nation, ["n_name"], [("s_nationkey", "n_nationkey")])])
    return rows.groupBy("p_type", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("cross_grid", """
SELECT cp / 100.0::DOUBLE AS cp, t.p_type, count(*) FILTER (p_size > cp) AS n_above
FROM part t, range(1, 51) g(cp) GROUP BY cp, t.p_type""")
def cross_grid_query(spark, d):
    """Every threshold of a 50-point grid against every part type; counts come from per-size totals."""
    sizes = Tables(spark, d).part.groupBy("p_type", "p_size").count()
    grid = joins.cross_grid(spark, step=list(range(1, 51)))
    return (sizes.crossJoin(F.broadcast(grid)).groupBy((F.col("step") / 100.0).alias("cp"), "p_type")
            .agg(F.sum(F.when(F.col("p_size") > F.col("step"), F.col("count")).otherwise(0)).alias("n_above")))


# ---------------------------------------------------------------- user functions

@query("map_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, count(*) AS n FROM lineitem GROUP BY {c}"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def map_columns_query(spark, d):
    return tabulate.freq_table(Tables(spark, d).lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("udf_rowwise", """
SELECT o_orderkey, CASE WHEN s > 0 AND s < 1 THEN round(-ln(-ln(s)), 6) END AS cloglog
FROM (SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS s FROM orders)""")
def udf_rowwise_query(spark, d):
    o = recode.with_constants(Tables(spark, d).orders, top=F.max("o_totalprice"))
    return o.select("o_orderkey", F.round(X.cloglog(F.col("o_totalprice") / F.col("top")), 6).alias("cloglog"))


@query("udaf_metrics", """
SELECT p_type, round(sqrt(avg(power(l_quantity * p_retailprice - l_extendedprice, 2))), 4) AS rmse,
  round(1 - sum(power(l_quantity * p_retailprice - l_extendedprice, 2)) / (var_pop(l_extendedprice) * count(*)), 8) AS r_square
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def udaf_metrics_query(spark, d):
    t = Tables(spark, d)
    rows = joins.left_chain(t.lineitem, [(t.part, ["p_retailprice", "p_type"], [("l_partkey", "p_partkey")])])
    m = rows.groupBy("p_type").agg(*X.sse_metrics(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")))
    return m.select("p_type", F.round("rmse", 4).alias("rmse"), F.round("r_square", 8).alias("r_square"))
