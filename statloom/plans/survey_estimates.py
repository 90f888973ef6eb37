"""Survey estimates: orders as respondents, priority as stratum, customer block as cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import survey, tabulate
from statloom.operators.survey import Z95, SurveyDesign
from statloom.plans.registry import query
from statloom.plans.tables_grouped import rounded
from statloom.sources import Tables

DESIGN = SurveyDesign("o_orderpriority", "psu", "wt")

BASE = """b AS (SELECT o_orderpriority AS h, o_custkey % 20 AS c, CAST(1 + o_orderkey % 7 AS DOUBLE) AS w, o_totalprice AS y,
  o_orderstatus AS s, CAST(o_orderstatus = 'F' AS INTEGER)::DOUBLE AS f,
  CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d FROM orders)"""


def respondents(spark, d):
    return Tables(spark, d).orders.withColumns({"psu": F.col("o_custkey") % 20, "wt": 1 + F.col("o_orderkey") % 7})


def since_1998():
    return F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")


def var_sql(name: str, score: str, source: str) -> str:
    """CTE ``name(v)``: design variance of a row score."""
    return (f"{name} AS (SELECT sum(n * vs) AS v FROM (SELECT h, count(*) AS n, var_samp(t) AS vs FROM "
            f"(SELECT h, c, sum({score}) AS t FROM {source} GROUP BY h, c) GROUP BY h))")


MEAN = f"""WITH {BASE}, m AS (SELECT sum(w * d) AS sw, sum(w * d * y) / sum(w * d) AS m, sum(d) AS n FROM b),
v AS (SELECT sum(w * d * (y - m) * (y - m)) / max(sw) * max(n) / (max(n) - 1) AS s2 FROM b, m), bm AS (SELECT * FROM b, m, v),
{var_sql('vm', 'w * d * (y - m) / sw', 'bm')}, {var_sql('vv', 'w * d * ((y - m) * (y - m) * n / (n - 1) - s2) / sw', 'bm')}"""


@query("svy_design", f"""WITH {BASE}, p AS (SELECT h, c, count(*) AS n, sum(w) AS w FROM b GROUP BY h, c),
s AS (SELECT h, count(*) AS c, sum(n) AS n, sum(w) AS w FROM p GROUP BY h)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, sum(w) AS sum_weights, count(*) AS n_strata, CAST(sum(c) AS BIGINT) AS n_psu,
  CAST(sum(c) - count(*) AS BIGINT) AS design_df, min(c) AS min_psu FROM s""")
def svy_design_query(spark, d):
    return survey.svy_design(respondents(spark, d), DESIGN)


@query("svy_mean", MEAN + " SELECT round(m, 4) AS mean, round(sqrt(vm.v), 4) AS se FROM m, vm")
def svy_mean_query(spark, d):
    m = survey.svy_mean(respondents(spark, d), DESIGN, F.col("o_totalprice"), domain=since_1998())
    return rounded(m.select("mean", "se"), 4, "mean", "se")


@query("svy_var", MEAN + " SELECT round(s2, 0) AS variance, round(sqrt(vv.v), 0) AS var_se FROM v, vv")
def svy_var_query(spark, d):
    m = survey.svy_mean(respondents(spark, d), DESIGN, F.col("o_totalprice"), domain=since_1998())
    return rounded(m.select("variance", "var_se"), 0, "variance", "var_se")


@query("svy_cv", MEAN + " SELECT round(sqrt(vm.v) / m, 8) AS cv FROM m, vm")
def svy_cv_query(spark, d):
    m = survey.svy_mean(respondents(spark, d), DESIGN, F.col("o_totalprice"), domain=since_1998())
    return rounded(m.select("cv"), 8, "cv")


@query("svy_deff", MEAN + " SELECT round(vm.v / (s2 * (1 - n / sw) / n), 6) AS deff FROM m, v, vm")
def svy_deff_query(spark, d):
    m = survey.svy_mean(respondents(spark, d), DESIGN, F.col("o_totalprice"), domain=since_1998())
    return rounded(m.select("deff"), 6, "deff")


@query("svy_table", f"""WITH {BASE} SELECT s AS o_orderstatus, h AS o_orderpriority, sum(w * d) AS n,
  round(sum(w * d) / sum(sum(w * d)) OVER (), 8) AS share FROM b GROUP BY s, h""")
def svy_table_query(spark, d):
    t = survey.svy_table(respondents(spark, d), DESIGN, ["o_orderstatus", "o_orderpriority"], since_1998())
    return rounded(t, 8, "share")


BY = f"""WITH {BASE}, m AS (SELECT s, sum(w * d) AS sw, sum(w * d * y) / sum(w * d) AS m, CAST(sum(d) AS BIGINT) AS n FROM b GROUP BY s),
p AS (SELECT m.s, m.m, m.sw, m.n, b.h, b.c, sum(CASE WHEN b.s = m.s THEN w * d * (y - m) / sw ELSE 0 END) AS t
      FROM b CROSS JOIN m GROUP BY ALL),
q AS (SELECT s, m, sw, n, h, count(*) * var_samp(t) AS v FROM p GROUP BY s, m, sw, n, h)"""


@query("svy_by", BY + """ SELECT s AS o_orderstatus, n, round(m, 4) AS mean, round(sqrt(sum(v)), 4) AS se FROM q GROUP BY s, n, m""")
def svy_by_query(spark, d):
    m = survey.svy_mean(respondents(spark, d), DESIGN, F.col("o_totalprice"), ["o_orderstatus"], since_1998())
    return rounded(m.select("o_orderstatus", "n", "mean", "se"), 4, "mean", "se")


@query("svy_domain", f"""WITH {BASE}, k AS (SELECT *, CASE WHEN s <> 'F' AND d = 1 AND h <> '5-LOW' THEN 1.0::DOUBLE ELSE 0 END AS e FROM b),
m AS (SELECT sum(w * e) AS sw, sum(w * e * y) / sum(w * e) AS m, sum(e) AS n FROM k), km AS (SELECT * FROM k, m),
{var_sql('vm', 'w * e * (y - m) / sw', 'km')}
SELECT CAST(n AS BIGINT) AS n, round(m, 4) AS mean, round(sqrt(v), 4) AS se FROM m, vm""")
def svy_domain_query(spark, d):
    """A domain that leaves one whole stratum empty; its clusters still count."""
    dom = (F.col("o_orderstatus") != "F") & since_1998() & (F.col("o_orderpriority") != "5-LOW")
    m = survey.svy_mean(respondents(spark, d), DESIGN, F.col("o_totalprice"), domain=dom)
    return rounded(m.select("n", "mean", "se"), 4, "mean", "se")


_Q = [0.1, 0.25, 0.5, 0.75, 0.9]
QUANT = f"""WITH {BASE}, g AS (SELECT y, sum(w) AS w FROM b WHERE d = 1 GROUP BY y),
cum AS (SELECT y, sum(w) OVER (ORDER BY y) AS cw, sum(w) OVER () AS sw FROM g),
ps AS (SELECT unnest({_Q})::DOUBLE AS p), pts AS (SELECT p, min(y) AS q FROM cum, ps WHERE cw >= p * sw GROUP BY p),
fl AS (SELECT p, q, sum(w * d * (y <= q)::INT) / sum(w * d) AS ff, sum(w * d) AS fw FROM b, pts GROUP BY p, q),
t AS (SELECT p, q, ff, fw, h, c, sum(w * d * ((y <= q)::INT - ff) / fw) AS t FROM b, fl GROUP BY ALL),
v AS (SELECT p, q, sqrt(sum(vh)) AS se FROM (SELECT p, q, h, count(*) * var_samp(t) AS vh FROM t GROUP BY p, q, h) GROUP BY p, q),
e AS (SELECT v.p, v.q, least(greatest(p - {Z95} * se, 0), 1) AS lo, least(greatest(p + {Z95} * se, 0), 1) AS hi FROM v)
SELECT p AS prob, q, min(y) FILTER (cw >= lo * sw) AS ci_low, min(y) FILTER (cw >= hi * sw) AS ci_high FROM e, cum GROUP BY p, q"""


@query("svy_quantile", QUANT)
def svy_quantile_query(spark, d):
    return survey.svy_quantile(respondents(spark, d), DESIGN, F.col("o_totalprice"), _Q, domain=since_1998(), ci=True)


@query("svy_ciprop", f"""WITH {BASE}, m AS (SELECT sum(w * d) AS sw, sum(w * d * f) / sum(w * d) AS p FROM b), bm AS (SELECT * FROM b, m),
{var_sql('vm', 'w * d * (f - p) / sw', 'bm')}, k AS (SELECT p, sqrt(v) AS se, ln(p / (1 - p)) AS l, {Z95} * sqrt(v) / (p * (1 - p)) AS hw FROM m, vm)
SELECT round(p, 8) AS proportion, round(se, 8) AS se, round(1 / (1 + exp(-(l - hw))), 8) AS ci_low, round(1 / (1 + exp(-(l + hw))), 8) AS ci_high FROM k""")
def svy_ciprop_query(spark, d):
    p = survey.svy_ciprop(respondents(spark, d), DESIGN, F.col("o_orderstatus") == "F", domain=since_1998())
    return rounded(p, 8, *p.columns)


@query("svy_ttest", f"""WITH {BASE}, m AS (SELECT sum(w*f) AS w1, sum(w*(1-f)) AS w0, sum(w*f*y)/sum(w*f) AS m1, sum(w*(1-f)*y)/sum(w*(1-f)) AS m0 FROM b),
bm AS (SELECT * FROM b, m), {var_sql('vm', 'w * f * (y - m1) / w1 - w * (1 - f) * (y - m0) / w0', 'bm')},
k AS (SELECT count(DISTINCT (h, c)) - count(DISTINCT h) - 1 AS df FROM b)
SELECT round(m1, 4) AS mean1, round(m0, 4) AS mean0, round(m1 - m0, 4) AS difference, round(sqrt(v), 4) AS se, round((m1 - m0) / sqrt(v), 6) AS t, df FROM m, vm, k""")
def svy_ttest_query(spark, d):
    t = survey.svy_ttest(respondents(spark, d), DESIGN, F.col("o_totalprice"), F.col("o_orderstatus") == "F")
    return rounded(rounded(t.drop("p_value"), 4, "mean1", "mean0", "difference", "se"), 6, "t")


@query("svy_ttest_one", MEAN + """, k AS (SELECT count(DISTINCT (h, c)) - count(DISTINCT h) AS df FROM b)
SELECT round(m, 4) AS mean, round(sqrt(vm.v), 4) AS se, round((m - 150000) / sqrt(vm.v), 6) AS t, df FROM m, vm, k""")
def svy_ttest_one_query(spark, d):
    t = survey.svy_ttest_one(respondents(spark, d), DESIGN, F.col("o_totalprice"), 150000.0, domain=since_1998())
    return rounded(rounded(t.drop("p_value"), 4, "mean", "se"), 6, "t")


@query("svy_hist", f"""WITH {BASE}, s AS (SELECT min(y) AS lo, (max(y) - min(y)) / 20 AS width FROM b)
SELECT bin, round(lo + bin * width, 4) AS bin_start, CAST(sum(w) AS BIGINT) AS n
FROM (SELECT lo, width, w, CAST(least(floor((y - lo) / width), 19) AS INTEGER) AS bin FROM b, s) GROUP BY bin, lo, width""")
def svy_hist_query(spark, d):
    return rounded(tabulate.histogram(respondents(spark, d), "o_totalprice", 20, weight=F.col("wt")), 4, "bin_start")


@query("svy_chisq", f"""WITH {BASE}, t AS (SELECT sum(w) AS sw, sum(w*f*d)/sum(w) AS p11, sum(w*f)/sum(w) AS p1, sum(w*d)/sum(w) AS q1 FROM b),
bt AS (SELECT * FROM b, t), {var_sql('vm', 'w / sw * ((f * d - p11) - q1 * (f - p1) - p1 * (d - q1))', 'bt')},
k AS (SELECT count(DISTINCT (h, c)) - count(DISTINCT h) AS design_df FROM b)
SELECT round((p11 - p1 * q1) * (p11 - p1 * q1) / v, 8) AS wald, 1::BIGINT AS k, design_df, design_df AS df2,
  round((p11 - p1 * q1) * (p11 - p1 * q1) / v, 8) AS f FROM t, vm, k""")
def svy_chisq_query(spark, d):
    rows = respondents(spark, d).withColumns({"done": (F.col("o_orderstatus") == "F").cast("int"), "late": since_1998().cast("int")})
    return rounded(survey.svy_chisq(rows, DESIGN, "done", "late").drop("p_value"), 8, "wald", "f")


CELLS = f"""WITH {BASE}, g AS (SELECT f, d, sum(w) AS sw, sum(w * y) / sum(w) AS m FROM b GROUP BY f, d),
bm AS (SELECT b.*, CASE WHEN b.f = 0 AND b.d = 0 THEN w * (y - m) / sw ELSE 0 END AS u00, CASE WHEN b.f = 1 AND b.d = 0 THEN w * (y - m) / sw ELSE 0 END AS u10,
  CASE WHEN b.f = 0 AND b.d = 1 THEN w * (y - m) / sw ELSE 0 END AS u01, CASE WHEN b.f = 1 AND b.d = 1 THEN w * (y - m) / sw ELSE 0 END AS u11
  FROM b JOIN g USING (f, d)),
m AS (SELECT sum(m) FILTER (f = 0 AND d = 0) AS m00, sum(m) FILTER (f = 1 AND d = 0) AS m10, sum(m) FILTER (f = 0 AND d = 1) AS m01,
  sum(m) FILTER (f = 1 AND d = 1) AS m11 FROM g),
{var_sql('va', 'u00', 'bm')}, {var_sql('vb', 'u10 - u00', 'bm')}, {var_sql('vc', 'u01 - u00', 'bm')}, {var_sql('vd', 'u11 - u10 - u01 + u00', 'bm')}"""


@query("svy_lm", CELLS + """
SELECT '(Intercept)' AS term, round(m00, 4) AS estimate, round(sqrt(v), 4) AS std_error FROM m, va
UNION ALL SELECT 'done', round(m10 - m00, 4), round(sqrt(v), 4) FROM m, vb
UNION ALL SELECT 'late', round(m01 - m00, 4), round(sqrt(v), 4) FROM m, vc
UNION ALL SELECT 'done:late', round(m11 - m10 - m01 + m00, 4), round(sqrt(v), 4) FROM m, vd""")
def svy_lm_query(spark, d):
    """Two crossed two-level factors: coefficients are contrasts of cell means, which the SQL computes directly."""
    done, late = (F.col("o_orderstatus") == "F").cast("double"), since_1998().cast("double")
    t = survey.svy_lm(respondents(spark, d), DESIGN, F.col("o_totalprice"),
                      {"(Intercept)": F.lit(1.0), "done": done, "late": late, "done:late": done * late})
    return rounded(t.select("term", "estimate", "std_error"), 4, "estimate", "std_error")


@query("svy_logit", f"""WITH {BASE}, g AS (SELECT d, sum(w) AS sw, sum(w * f) / sum(w) AS p FROM b GROUP BY d),
bm AS (SELECT b.*, CASE WHEN b.d = 0 THEN w * (f - p) / (sw * p * (1 - p)) ELSE 0 END AS u0,
  CASE WHEN b.d = 1 THEN w * (f - p) / (sw * p * (1 - p)) ELSE 0 END AS u1 FROM b JOIN g USING (d)),
m AS (SELECT sum(ln(p / (1 - p))) FILTER (d = 0) AS l0, sum(ln(p / (1 - p))) FILTER (d = 1) AS l1 FROM g),
{var_sql('va', 'u0', 'bm')}, {var_sql('vb', 'u1 - u0', 'bm')}
SELECT '(Intercept)' AS term, round(l0, 6) AS estimate, round(sqrt(v), 6) AS std_error FROM m, va
UNION ALL SELECT 'late', round(l1 - l0, 6), round(sqrt(v), 6) FROM m, vb""")
def svy_logit_query(spark, d):
    t = survey.svy_logit(respondents(spark, d), DESIGN, F.col("o_orderstatus") == "F", {"late": since_1998()})
    return rounded(t.select("term", "estimate", "std_error"), 6, "estimate", "std_error")


@query("svy_boxstats", f"""WITH {BASE}, g AS (SELECT s, y, sum(w) AS w FROM b WHERE d = 1 GROUP BY s, y),
cum AS (SELECT s, y, sum(w) OVER (PARTITION BY s ORDER BY y) AS cw, sum(w) OVER (PARTITION BY s) AS sw FROM g),
q AS (SELECT s, min(y) AS min, min(y) FILTER (cw >= 0.25::DOUBLE * sw) AS q1, min(y) FILTER (cw >= 0.5::DOUBLE * sw) AS median,
  min(y) FILTER (cw >= 0.75::DOUBLE * sw) AS q3, max(y) AS max FROM cum GROUP BY s)
SELECT s AS o_orderstatus, min, q1, median, q3, max,
  count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM b JOIN q USING (s) WHERE d = 1 GROUP BY ALL""")
def svy_boxstats_query(spark, d):
    return survey.svy_boxstats(respondents(spark, d), DESIGN, F.col("o_totalprice"), ["o_orderstatus"], since_1998())


@query("svy_density", f"""WITH {BASE}, e AS (SELECT min(y) AS lo, max(y) AS hi FROM b WHERE d = 1),
h AS (SELECT lo + (hi - lo) / 401 * (k + 0.5) AS mid, sum(w) AS w FROM (
  SELECT w, lo, hi, least(floor((y - lo) / ((hi - lo) / 401)), 400) AS k FROM b, e WHERE d = 1) GROUP BY k, lo, hi),
x AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 100 AS x FROM e, range(0, 101) r(i))
SELECT i, round(x, 4) AS x, round(1e6 * sum(w * 0.3989422804014327 * exp(-((x - mid) / 20000) * ((x - mid) / 20000) / 2)) / (sum(w) * 20000), 6) AS density
FROM x, h GROUP BY i, x""")
def svy_density_query(spark, d):
    """Density per million currency units."""
    g = survey.svy_density(respondents(spark, d), DESIGN, F.col("o_totalprice"), 20000.0, domain=since_1998())
    return g.select("i", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))
