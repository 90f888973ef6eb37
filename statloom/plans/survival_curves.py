"""Customer lifetimes: months between first and last order, ended before 2001-02 or still open."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import survival
from statloom.operators.recode import design_columns
from statloom.plans.registry import query
from statloom.plans.tables_grouped import rounded
from statloom.sources import Tables

BASE = """s AS (SELECT c_custkey AS id, c_mktsegment AS g, c_acctbal / 1000 AS x1,
  date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) // 30 AS t,
  (max(o_orderdate) < TIMESTAMP '2001-02-01')::INTEGER AS e, count(*)::DOUBLE AS x2
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_acctbal)"""


def lifetimes(spark, d):
    """One row per customer; orders are reduced per customer before the join."""
    t = Tables(spark, d)
    spans = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"),
                                              F.count(F.lit(1)).cast("double").alias("x2"))
    return spans.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"), (F.col("c_acctbal") / 1000).alias("x1"), "x2",
        F.floor(F.datediff("b", "a") / 30).alias("t"), (F.col("b") < F.lit("2001-02-01").cast("timestamp_ntz")).cast("int").alias("e"))


KM = f"""WITH {BASE}, l AS (SELECT g, t, sum(e) AS d, count(*) AS n FROM s GROUP BY g, t),
r AS (SELECT g, t, CAST(d AS BIGINT) AS n_event, CAST(n - d AS BIGINT) AS n_censor,
  CAST(sum(n) OVER (PARTITION BY g ORDER BY t DESC) AS BIGINT) AS n_risk FROM l),
k AS (SELECT *, product(1 - n_event / n_risk) OVER w AS surv, sum(n_event / n_risk) OVER w AS na,
  CASE WHEN min(n_risk - n_event) OVER w > 0 THEN sqrt(sum(CASE WHEN n_risk > n_event THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END) OVER w) END AS root
  FROM r WINDOW w AS (PARTITION BY g ORDER BY t))"""


@query("risk_table", KM + " SELECT g, t, n_risk, n_event, n_censor FROM k")
def risk_table_query(spark, d):
    return survival.risk_table(lifetimes(spark, d), "t", "e", ["g"])


_BREAKS = [0, 20, 40, 60, 80]


@query("risk_breaks", f"""WITH {BASE} SELECT g, b::DOUBLE AS break, count(*) FILTER (t >= b) AS n_risk,
  CAST(coalesce(sum(e) FILTER (t <= b), 0) AS BIGINT) AS n_event FROM s, (SELECT unnest({_BREAKS}) AS b) GROUP BY g, b""")
def risk_breaks_query(spark, d):
    return survival.risk_at(survival.risk_table(lifetimes(spark, d), "t", "e", ["g"]), "t", _BREAKS, ["g"])


@query("kaplan_meier", KM + """ SELECT g, t, n_risk, n_event, round(surv, 8) AS surv, round(surv * root, 8) AS std_err,
  round(surv * exp(-1.959963984540054 * root), 8) AS lower, round(least(surv * exp(1.959963984540054 * root), 1), 8) AS upper FROM k""")
def kaplan_meier_query(spark, d):
    km = survival.kaplan_meier(lifetimes(spark, d), "t", "e", ["g"])
    return rounded(km.select("g", "t", "n_risk", "n_event", "surv", "std_err", "lower", "upper"), 8, "surv", "std_err", "lower", "upper")


@query("km_median", KM + """ SELECT g, max(n_risk) AS n, CAST(sum(n_event) AS BIGINT) AS events, min(t) FILTER (surv <= 0.5 + 1e-12) AS median,
  min(t) FILTER (surv * exp(-1.959963984540054 * root) <= 0.5 + 1e-12) AS lower,
  min(t) FILTER (least(surv * exp(1.959963984540054 * root), 1) <= 0.5 + 1e-12) AS upper FROM k GROUP BY g""")
def km_median_query(spark, d):
    return survival.km_median(lifetimes(spark, d), "t", "e", ["g"])


@query("logrank", f"""WITH {BASE}, q AS (SELECT id, t, e, g = 'BUILDING' AS b FROM s),
l AS (SELECT t, sum(e) AS d, sum(e) FILTER (b) AS d1, count(*) AS n, count(*) FILTER (b) AS n1 FROM q GROUP BY t),
r AS (SELECT t, d, coalesce(d1, 0) AS d1, sum(n) OVER w AS n, sum(n1) OVER w AS n1 FROM l WINDOW w AS (ORDER BY t DESC)),
x AS (SELECT sum(d1) AS o, sum(d * n1 / n) AS ex, sum(d) AS od, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r),
c AS (SELECT b, count(*) AS n FROM q GROUP BY b)
SELECT b AS building, n, CAST(CASE WHEN b THEN o ELSE od - o END AS BIGINT) AS observed, round(CASE WHEN b THEN ex ELSE od - ex END, 6) AS expected,
  round((o - ex) * (o - ex) / v, 6) AS chi2, 1::BIGINT AS df FROM x, c""")
def logrank_query(spark, d):
    rows = lifetimes(spark, d).withColumn("building", F.col("g") == "BUILDING")
    return rounded(survival.logrank(rows, "t", "e", "building").drop("p_value"), 6, "expected", "chi2")


@query("logrank_groups", f"""WITH {BASE}, l AS (SELECT g, t, sum(e) AS d, count(*) AS n FROM s GROUP BY g, t),
gr AS (SELECT DISTINCT g FROM s), ti AS (SELECT DISTINCT t FROM s),
f AS (SELECT g, t, coalesce(d, 0) AS d, sum(coalesce(n, 0)) OVER (PARTITION BY g ORDER BY t DESC) AS n FROM gr CROSS JOIN ti LEFT JOIN l USING (g, t)),
w AS (SELECT *, sum(d) OVER (PARTITION BY t) AS dt, sum(n) OVER (PARTITION BY t) AS nt FROM f)
SELECT g, CAST(max(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS observed, round(sum(dt * n / nt), 6) AS expected FROM w GROUP BY g""")
def logrank_groups_query(spark, d):
    out = survival.logrank(lifetimes(spark, d), "t", "e", "g")
    return rounded(out.select("g", "n", "observed", "expected"), 6, "expected")


@query("cum_hazard", KM + " SELECT g, t, CASE WHEN surv > 0 THEN round(-ln(surv), 8) END AS cum_hazard, round(na, 8) AS nelson_aalen FROM k")
def cum_hazard_query(spark, d):
    km = survival.kaplan_meier(lifetimes(spark, d), "t", "e", ["g"])
    return rounded(km.select("g", "t", "cum_hazard", "nelson_aalen"), 8, "cum_hazard", "nelson_aalen")


@query("cloglog", KM + " SELECT g, t, CASE WHEN surv > 0 AND surv < 1 THEN round(-ln(-ln(surv)), 7) END AS cloglog FROM k")
def cloglog_query(spark, d):
    km = survival.kaplan_meier(lifetimes(spark, d), "t", "e", ["g"])
    return rounded(km.select("g", "t", "cloglog"), 7, "cloglog")


# ---------------------------------------------------------------- proportional hazards, two covariates
# The SQL runs the same Newton iteration as a recursive query, with one row per tied event.

def cox_sql(strata: str) -> str:
    per_time = """SELECT {head} st, t, sum(e) AS d, sum(e * x1) AS e1, sum(e * x2) AS e2,
      sum(r) AS s0, sum(r * x1) AS s1, sum(r * x2) AS s2, sum(r * x1 * x1) AS s11, sum(r * x1 * x2) AS s12, sum(r * x2 * x2) AS s22,
      sum(e * r) AS d0, sum(e * r * x1) AS d1, sum(e * r * x2) AS d2, sum(e * r * x1 * x1) AS d11, sum(e * r * x1 * x2) AS d12, sum(e * r * x2 * x2) AS d22
      FROM (SELECT *, exp(b1 * x1 + b2 * x2) AS r FROM z CROSS JOIN {src}) GROUP BY {head} st, t"""
    cum = ", ".join(f"sum({c}) OVER w AS r{c[1:]}" for c in ("s0", "s1", "s2", "s11", "s12", "s22"))

    def ties(head, src):
        part = f"PARTITION BY {head} st ORDER BY t DESC"
        return f"""SELECT *, l / d AS u, r0 - l / d * d0 AS phi FROM (SELECT *, unnest(range(CAST(d AS BIGINT)))::DOUBLE AS l FROM
          (SELECT *, {cum} FROM ({per_time.format(head=head, src=src)}) WINDOW w AS ({part})) WHERE d > 0)"""

    m1, m2 = "(r1 - u * d1) / phi", "(r2 - u * d2) / phi"
    sums = f"""sum(e1 / d - {m1}) AS u1, sum(e2 / d - {m2}) AS u2, sum((r11 - u * d11) / phi - {m1} * {m1}) AS i11,
      sum((r12 - u * d12) / phi - {m1} * {m2}) AS i12, sum((r22 - u * d22) / phi - {m2} * {m2}) AS i22"""
    return f"""WITH RECURSIVE {BASE}, c AS (SELECT avg(x1) AS c1, avg(x2) AS c2 FROM s),
z AS (SELECT id, g, {strata} AS st, t::DOUBLE AS t, e, x1 - c1 AS x1, x2 - c2 AS x2 FROM s, c),
it(i, b1, b2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, b1 + (i22 * u1 - i12 * u2) / (i11 * i22 - i12 * i12), b2 + (i11 * u2 - i12 * u1) / (i11 * i22 - i12 * i12)
  FROM (SELECT i, b1, b2, {sums} FROM ({ties('i, b1, b2,', 'it')}) GROUP BY i, b1, b2) WHERE i < 9),
fin AS (SELECT b1, b2 FROM it WHERE i = 9),
tie AS ({ties('b1, b2,', 'fin')}), tie0 AS ({ties('b1, b2,', '(SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)')}),
inf AS (SELECT b1, b2, {sums}, sum((b1 * e1 + b2 * e2) / d - ln(phi)) AS ll FROM tie GROUP BY b1, b2),
inf0 AS (SELECT {sums}, sum(-ln(phi)) AS ll FROM tie0),
est AS (SELECT *, sqrt(i22 / (i11 * i22 - i12 * i12)) AS se1, sqrt(i11 / (i11 * i22 - i12 * i12)) AS se2, i22 / (i11 * i22 - i12 * i12) AS v11,
  -i12 / (i11 * i22 - i12 * i12) AS v12, i11 / (i11 * i22 - i12 * i12) AS v22 FROM inf),
hz AS (SELECT st, t, max(d) AS d, sum(1 / phi) AS h, sum(u / phi) AS tie, sum({m1}) AS m1, sum({m2}) AS m2, max(e1) AS e1, max(e2) AS e2 FROM tie GROUP BY st, t),
ch AS (SELECT z.id, z.t, z.st, z.e, b1 * x1 + b2 * x2 AS eta, coalesce((SELECT sum(h) FROM hz WHERE hz.st = z.st AND hz.t <= z.t), 0)
  - z.e * coalesce((SELECT tie FROM hz WHERE hz.st = z.st AND hz.t = z.t), 0) AS hazard FROM z, fin)
"""


COX, COX_STRATA = cox_sql("'all'"), cox_sql("g")


def two_covariates():
    return {"x1": F.col("x1"), "x2": F.col("x2")}


def fit_two(spark, d, **kw):
    return survival.cox_fit(lifetimes(spark, d), "t", "e", two_covariates(), **kw)


_SUMMARY = """SELECT 'x1' AS term, round(b1, 7) AS coef, round(exp(b1), 7) AS hazard_ratio, round(se1, 7) AS std_error, round(b1 / se1, 5) AS z,
  round(exp(b1 - 1.959963984540054 * se1), 7) AS hr_low, round(exp(b1 + 1.959963984540054 * se1), 7) AS hr_high FROM est
UNION ALL SELECT 'x2', round(b2, 7), round(exp(b2), 7), round(se2, 7), round(b2 / se2, 5),
  round(exp(b2 - 1.959963984540054 * se2), 7), round(exp(b2 + 1.959963984540054 * se2), 7) FROM est"""


@query("cox_ph", COX + "SELECT 'x1' AS term, round(b1, 7) AS coef FROM est UNION ALL SELECT 'x2', round(b2, 7) FROM est")
def cox_ph_query(spark, d):
    return rounded(survival.cox_summary(fit_two(spark, d)).select("term", "coef"), 7, "coef")


@query("cox_factor", f"""WITH {BASE}, l AS (SELECT t, sum(e) AS d, count(*) AS n, sum(e) FILTER (g = 'MACHINERY') AS dm, count(*) FILTER (g = 'MACHINERY') AS nm,
  sum(x1) AS sx, sum(x1 * x1) AS sxx, sum(e * x1) AS dx, sum(e * x1 * x1) AS dxx, sum(x1) FILTER (g = 'MACHINERY') AS smx, sum(e * x1) FILTER (g = 'MACHINERY') AS dmx FROM s GROUP BY t),
r AS (SELECT t, d, dx, dxx, coalesce(dm, 0) AS dm, coalesce(dmx, 0) AS dmx, sum(n) OVER w AS rn, sum(nm) OVER w AS rm, sum(sx) OVER w AS rx, sum(sxx) OVER w AS rxx,
  sum(coalesce(smx, 0)) OVER w AS rmx FROM l WINDOW w AS (ORDER BY t DESC)),
q AS (SELECT *, u / d AS f, rn - u AS phi FROM (SELECT *, unnest(range(CAST(d AS BIGINT)))::DOUBLE AS u FROM r)),
x AS (SELECT sum(dm / d - (rm - f * dm) / phi) AS um, sum(dx / d - (rx - f * dx) / phi) AS ux,
  sum((rm - f * dm) / phi * (1 - (rm - f * dm) / phi)) AS imm, sum((rmx - f * dmx) / phi - (rm - f * dm) / phi * (rx - f * dx) / phi) AS imx,
  sum((rxx - f * dxx) / phi - (rx - f * dx) / phi * (rx - f * dx) / phi) AS ixx FROM q)
SELECT 'machinery' AS term_i, 'machinery' AS term_j, round(um, 5) AS score_i, round(imm, 5) AS information FROM x
UNION ALL SELECT 'machinery', 'x1', round(um, 5), round(imx, 5) FROM x UNION ALL SELECT 'x1', 'machinery', round(ux, 5), round(imx, 5) FROM x
UNION ALL SELECT 'x1', 'x1', round(ux, 5), round(ixx, 5) FROM x""")
def cox_factor_query(spark, d):
    """Mixed factor and numeric covariates: score and information where the iteration starts."""
    fit = survival.cox_fit(lifetimes(spark, d), "t", "e", {"machinery": F.col("g") == "MACHINERY", "x1": F.col("x1")})
    return rounded(survival.cox_start(fit), 5, "score_i", "information")


@query("cox_strata", COX_STRATA + _SUMMARY)
def cox_strata_query(spark, d):
    out = survival.cox_summary(fit_two(spark, d, strata="g")).drop("p_value")
    return rounded(rounded(out, 7, "coef", "hazard_ratio", "std_error", "hr_low", "hr_high"), 5, "z")


@query("cox_summary", COX + _SUMMARY)
def cox_summary_query(spark, d):
    out = survival.cox_summary(fit_two(spark, d)).drop("p_value")
    return rounded(rounded(out, 7, "coef", "hazard_ratio", "std_error", "hr_low", "hr_high"), 5, "z")


@query("cox_concordance", f"""WITH {BASE} SELECT
  sum((b.x2 < a.x2)::INT)::DOUBLE AS concordant, sum((b.x2 = a.x2)::INT)::DOUBLE AS tied, count(*)::DOUBLE AS pairs,
  round((sum((b.x2 < a.x2)::INT) + sum((b.x2 = a.x2)::INT) / 2) / count(*), 8) AS raw_share
  FROM s a JOIN s b ON b.t > a.t OR (b.t = a.t AND b.e = 0) WHERE a.e = 1""")
def cox_concordance_query(spark, d):
    """One-covariate score: the order count, whose sign decides which share is reported as concordant."""
    fit = survival.cox_fit(lifetimes(spark, d), "t", "e", {"x2": F.col("x2")})
    c = survival.cox_concordance(fit)
    if fit.beta[0] < 0:  # a falling score swaps concordant and discordant
        c = c.withColumn("concordant", F.col("pairs") - F.col("concordant") - F.col("tied"))
    return c.select("concordant", "tied", "pairs", F.round((F.col("concordant") + F.col("tied") / 2) / F.col("pairs"), 8).alias("raw_share"))


@query("cox_baseline", COX_STRATA + """SELECT st AS stratum, t AS time, CAST(d AS BIGINT) AS n_event, round(h, 8) AS hazard,
  round(sum(h) OVER w, 8) AS cum_hazard, round(exp(-sum(h) OVER w), 8) AS surv FROM hz WINDOW w AS (PARTITION BY st ORDER BY t)""")
def cox_baseline_query(spark, d):
    return rounded(survival.cox_baseline(fit_two(spark, d, strata="g")).drop("tie"), 8, "hazard", "cum_hazard", "surv")


@query("cox_lrt", COX + """SELECT 'x1 + x2' AS model, round(inf.ll, 5) AS loglik, round(2 * (inf.ll - inf0.ll), 5) AS chi2, 2::BIGINT AS df,
  round(-2 * inf.ll + 4, 5) AS aic FROM inf, inf0""")
def cox_lrt_query(spark, d):
    return rounded(survival.cox_lrt([("x1 + x2", fit_two(spark, d))]).drop("p_value"), 5, "loglik", "chi2", "aic")


@query("cox_anova")
def cox_anova_query(spark, d):
    """Sequential likelihood-ratio table: balance, then order count, then segment."""
    rows = lifetimes(spark, d).persist()
    seg = design_columns(rows, [], ["g"], intercept=False)
    cols = two_covariates()
    steps = [("x1", {"x1": cols["x1"]}), ("+ x2", cols), ("+ segment", {**cols, **seg})]
    out = survival.cox_lrt([(n, survival.cox_fit(rows, "t", "e", c)) for n, c in steps])
    return out


@query("cox_zph", COX + """, km AS (SELECT t, coalesce(product(1 - d / n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM
  (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS n FROM (SELECT t, sum(e) AS d, count(*) AS n FROM z GROUP BY t))),
res AS (SELECT hz.d, 1 - before AS g, e1 - m1 AS r1, e2 - m2 AS r2 FROM hz JOIN km USING (t)),
gb AS (SELECT sum(d * g) / sum(d) AS gb, sum(d) AS k FROM res),
uu AS (SELECT sum((g - gb) * r1) AS u1, sum((g - gb) * r2) AS u2, sum(d * (g - gb) * (g - gb)) AS ss, max(k) AS k FROM res, gb)
SELECT 'x1' AS term, round(k * (v11 * uu.u1 + v12 * uu.u2) * (v11 * uu.u1 + v12 * uu.u2) / (v11 * ss), 5) AS chi2, 1::BIGINT AS df FROM uu, est
UNION ALL SELECT 'x2', round(k * (v12 * uu.u1 + v22 * uu.u2) * (v12 * uu.u1 + v22 * uu.u2) / (v22 * ss), 5), 1 FROM uu, est
UNION ALL SELECT 'GLOBAL', round(k * (v11 * uu.u1 * uu.u1 + 2 * v12 * uu.u1 * uu.u2 + v22 * uu.u2 * uu.u2) / ss, 5), 2 FROM uu, est""")
def cox_zph_query(spark, d):
    return rounded(survival.cox_zph(fit_two(spark, d)).drop("p_value"), 5, "chi2")


@query("cox_resid", COX + """SELECT id, t AS time, e AS event, round(e - exp(eta) * hazard, 6) AS martingale FROM ch""")
def cox_resid_query(spark, d):
    out = survival.cox_residuals(fit_two(spark, d, keep=["id"]))
    return rounded(out.select("id", "time", "event", "martingale"), 6, "martingale")


@query("cox_resid_all")
def cox_resid_all_query(spark, d):
    return survival.cox_residuals(fit_two(spark, d, keep=["id"]))


@query("cox_select")
def cox_select_query(spark, d):
    """Backward steps from balance, order count and segment, with the refitted model's log likelihood."""
    rows = lifetimes(spark, d).persist()
    seg = design_columns(rows, [], ["g"], intercept=False)
    full = survival.cox_fit(rows, "t", "e", {**two_covariates(), **seg})
    kept, trace = survival.cox_select(full, {"x1": ["x1"], "x2": ["x2"], "segment": list(seg)})
    lines = [(int(i), t, float(w), int(k), float(a)) for i, t, w, k, a in trace] + [(0, "kept: " + " + ".join(kept), None, None, None)]
    return spark.createDataFrame(lines, "step int, term string, wald double, df int, aic_change double")


@query("cox_gof", COX + """, q AS (SELECT *, percent_rank() OVER (ORDER BY eta) AS pr FROM ch)
SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS observed, round(sum(exp(eta) * hazard), 4) AS expected FROM ch""")
def cox_gof_query(spark, d):
    """Bands of the risk score; their totals must give all rows and as many expected as observed events."""
    bands = survival.cox_gof(fit_two(spark, d, keep=["id"]))
    return bands.agg(F.sum("n").alias("n"), F.sum("observed").alias("observed"), F.round(F.sum("expected"), 4).alias("expected"))


@query("cox_gof_bands")
def cox_gof_bands_query(spark, d):
    return survival.cox_gof(fit_two(spark, d, keep=["id"]))


@query("aft_residuals")
def aft_residuals_query(spark, d):
    return survival.aft_residuals(lifetimes(spark, d), "t", "e", ["x1", "x2"], ["id"])


@query("cox_spline")
def cox_spline_query(spark, d):
    return survival.cox_spline(lifetimes(spark, d), "t", "e", "x1", {"x2": F.col("x2")})
