"""Association tests on order, line and customer attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import association
from statloom.plans.registry import query
from statloom.plans.tables_grouped import rounded
from statloom.sources import Tables


def chi2_tail_sql(x: str, df: str) -> str:
    """Upper chi-square tail as one minus the incomplete-gamma series."""
    return (f"(1 - list_sum(list_transform(range(0, 300), lambda k: "
            f"exp(-({x}) / 2 + (({df}) / 2.0::DOUBLE + k) * ln(({x}) / 2) - lgamma(({df}) / 2.0::DOUBLE + k + 1)))))")


def assoc_sql(pairs: dict[str, tuple[str, str, str]], tail: str) -> str:
    """Chi-square quantities per variable; pairs: name -> (level, target, from)."""
    counts = " UNION ALL ".join(
        f"SELECT '{n}' AS variable, CAST({lv} AS VARCHAR) AS level, CAST({tg} AS VARCHAR) AS target, count(*) AS n FROM {src} GROUP BY 2, 3"
        for n, (lv, tg, src) in pairs.items())
    return f"""
WITH c AS ({counts}),
lv AS (SELECT variable, level, sum(n) AS r FROM c GROUP BY ALL), tg AS (SELECT variable, target, sum(n) AS t FROM c GROUP BY ALL),
tot AS (SELECT variable, sum(n) AS nn FROM c GROUP BY ALL),
cells AS (SELECT lv.variable, r * t / nn AS e, coalesce(n, 0) AS o, nn FROM lv JOIN tg USING (variable) JOIN tot USING (variable)
          LEFT JOIN c USING (variable, level, target)),
dims AS (SELECT variable, count(DISTINCT level) AS rows, count(DISTINCT target) AS cols FROM c GROUP BY 1),
x AS (SELECT variable, CAST(max(nn) AS BIGINT) AS n, max(rows) AS rows, max(cols) AS cols, sum((o - e) * (o - e) / e) AS chi2,
      CAST((max(rows) - 1) * (max(cols) - 1) AS BIGINT) AS df FROM cells JOIN dims USING (variable) GROUP BY variable)
{tail}"""


_ONE = {"o_orderpriority": ("o_orderpriority", "o_orderstatus", "orders")}
_SCAN = {"p_type": ("p_type", "l_returnflag = 'R'", "lineitem JOIN part ON l_partkey = p_partkey"),
         "l_linestatus": ("l_linestatus", "l_returnflag = 'R'", "lineitem"),
         "l_linenumber": ("l_linenumber", "l_returnflag = 'R'", "lineitem"),
         "bulk": ("l_quantity > 25", "l_returnflag = 'R'", "lineitem")}
_V = "sqrt(chi2 / n / least(rows - 1, cols - 1))"
_VC = """sqrt(greatest(0, chi2 / n - (rows - 1) * (cols - 1) / (n - 1.0::DOUBLE)) /
 least(rows - (rows - 1) * (rows - 1) / (n - 1.0::DOUBLE) - 1, cols - (cols - 1) * (cols - 1) / (n - 1.0::DOUBLE) - 1))"""


@query("chi_square", assoc_sql(_ONE, f"""
SELECT variable, n, rows, cols, round(chi2, 6) AS chi2, df, round({chi2_tail_sql('chi2', 'df')}, 6) AS p_value FROM x"""))
def chi_square_query(spark, d):
    o = Tables(spark, d).orders
    return rounded(association.chi_square(o, {"o_orderpriority": F.col("o_orderpriority")}, F.col("o_orderstatus")), 6, "chi2", "p_value")


@query("cramers_v", assoc_sql(_ONE, f"SELECT variable, round({_V}, 8) AS v FROM x"))
def cramers_v_query(spark, d):
    o = Tables(spark, d).orders
    v = association.cramers_v(o, {"o_orderpriority": F.col("o_orderpriority")}, F.col("o_orderstatus"))
    return v.select("variable", F.round("v", 8).alias("v"))


_BC = {"segment": ("c_mktsegment", "c_acctbal > 0", "customer"), "nation": ("c_nationkey", "c_acctbal > 0", "customer"),
       "rich": ("c_acctbal > 5000", "c_acctbal > 0", "customer")}


@query("cramers_v_bc", assoc_sql(_BC, f"SELECT variable, round({_VC}, 8) AS v_corrected FROM x"))
def cramers_v_bc_query(spark, d):
    c = Tables(spark, d).customer
    v = association.cramers_v(c, {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"),
                                  "rich": F.col("c_acctbal") > 5000}, F.col("c_acctbal") > 0)
    return v.select("variable", F.round("v_corrected", 8).alias("v_corrected"))


@query("cramers_v_scan", assoc_sql(_SCAN, f"""
SELECT variable, n, round(chi2, 6) AS chi2, round({_V}, 8) AS v, round({_VC}, 8) AS v_corrected FROM x"""))
def cramers_v_scan_query(spark, d):
    t = Tables(spark, d)
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    v = association.cramers_v(rows, {"p_type": F.col("p_type"), "l_linestatus": F.col("l_linestatus"),
                                     "l_linenumber": F.col("l_linenumber"), "bulk": F.col("l_quantity") > 25},
                              F.col("l_returnflag") == "R")
    return rounded(rounded(v.select("variable", "n", "chi2", "v", "v_corrected"), 6, "chi2"), 8, "v", "v_corrected")


@query("fisher_2x2", """
WITH t AS (SELECT count(*) FILTER (s AND u) AS a, count(*) FILTER (s AND NOT u) AS b, count(*) FILTER (NOT s AND u) AS c,
  count(*) FILTER (NOT s AND NOT u) AS d FROM (SELECT o_orderstatus = 'F' AS s, o_orderpriority = '1-URGENT' AS u FROM orders)),
k AS (SELECT t.*, unnest(range(greatest(0, (a + b) + (a + c) - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM t),
l AS (SELECT *, lgamma(a + b + 1.0::DOUBLE) + lgamma(c + d + 1.0::DOUBLE) + lgamma(a + c + 1.0::DOUBLE) + lgamma(b + d + 1.0::DOUBLE)
  - lgamma(a + b + c + d + 1.0::DOUBLE) - lgamma(k + 1.0::DOUBLE) - lgamma(a + b - k + 1.0::DOUBLE) - lgamma(a + c - k + 1.0::DOUBLE)
  - lgamma(d - a + k + 1.0::DOUBLE) AS lp FROM k)
SELECT a, b, c, d, round(a::DOUBLE * d / (b::DOUBLE * c), 6) AS odds_ratio,
  round(sum(exp(lp)) FILTER (lp <= (SELECT max(lp) FROM l WHERE k = a) + 1e-7), 6) AS p_value FROM l GROUP BY a, b, c, d""")
def fisher_2x2_query(spark, d):
    o = Tables(spark, d).orders
    return rounded(association.fisher_2x2(o, F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"),
                   6, "odds_ratio", "p_value")
