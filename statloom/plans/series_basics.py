"""Daily order totals (thousands) by priority: panels, diagnostics, decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import scalars as X
from statloom.operators import series
from statloom.plans.registry import query
from statloom.plans.tables_grouped import rounded
from statloom.sources import Tables

K, T, Y = ["key"], "day", "y"
DAILY = """o AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1000 AS y FROM orders GROUP BY 1, 2)"""
PANEL = f"""{DAILY}, days AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM o),
p AS (SELECT k.key, days.day, coalesce(o.y, 0) AS y FROM (SELECT DISTINCT key FROM o) k CROSS JOIN days LEFT JOIN o ON o.key = k.key AND o.day = days.day)"""
TRAIN = PANEL + ", tr AS (SELECT * FROM p WHERE day < DATE '2001-01-01')"


def daily(spark, d):
    o = Tables(spark, d).orders.select(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return o.groupBy("key", "day").agg((F.sum("o_totalprice") / 1000).alias("y"))


def panel(spark, d):
    return series.fill_gaps(daily(spark, d), K, T, {"y": 0.0})


def train(spark, d):
    return panel(spark, d).filter(F.col("day") < F.lit("2001-01-01").cast("date"))


def test(spark, d):
    return panel(spark, d).filter(F.col("day") >= F.lit("2001-01-01").cast("date"))


@query("ts_resample", """SELECT o_orderpriority AS key, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS day, round(sum(o_totalprice) / 1000, 6) AS y
FROM orders GROUP BY 1, 2""")
def ts_resample_query(spark, d):
    return rounded(series.resample(daily(spark, d), K, T, Y, "quarter"), 6, "y")


@query("ts_key_check", f"WITH {DAILY} SELECT key, count(*) AS n FROM o GROUP BY key")
def ts_key_check_query(spark, d):
    return series.checked(daily(spark, d), K, T).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("ts_duplicates", "SELECT o_orderstatus AS key, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def ts_duplicates_query(spark, d):
    o = Tables(spark, d).orders.select(F.col("o_orderstatus").alias("key"), F.to_date("o_orderdate").alias("day"))
    return series.duplicates(o, K, T)


@query("fill_gaps", f"WITH {PANEL} SELECT key, day, round(y, 6) AS y FROM p")
def fill_gaps_query(spark, d):
    return rounded(panel(spark, d), 6, "y")


ACF = f"""{PANEL}, m AS (SELECT key, avg(y) AS m, count(*) AS n FROM p GROUP BY key),
e AS (SELECT p.key, row_number() OVER (PARTITION BY p.key ORDER BY day) AS i, y - m AS e, n FROM p JOIN m USING (key)),
c0 AS (SELECT key, sum(e * e) AS c0, max(n) AS n FROM e GROUP BY key),
r AS (SELECT a.key, CAST(a.i - b.i AS INTEGER) AS lag, sum(a.e * b.e) / max(c0) AS acf, max(c0.n) AS n FROM e a JOIN e b ON a.key = b.key AND a.i - b.i BETWEEN 1 AND 14
  JOIN c0 ON c0.key = a.key GROUP BY a.key, a.i - b.i)"""


@query("acf", f"WITH {ACF} SELECT key, lag, round(acf, 8) AS acf, round(1.96::DOUBLE / sqrt(n), 8) AS band FROM r")
def acf_query(spark, d):
    return rounded(series.acf(panel(spark, d), K, T, Y, 14), 8, "acf", "band")


@query("pacf", f"""WITH {ACF}, w AS (SELECT key, max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2, max(acf) FILTER (lag = 3) AS r3 FROM r GROUP BY key)
SELECT key, 1 AS lag, round(r1, 8) AS pacf FROM w UNION ALL SELECT key, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 8) FROM w
UNION ALL SELECT key, 3, round((r3 - 2 * r1 * r2 + r1 * r1 * r1 + r1 * r2 * r2 - r1 * r1 * r3) / (1 - 2 * r1 * r1 - r2 * r2 + 2 * r1 * r1 * r2), 8) FROM w""")
def pacf_query(spark, d):
    return rounded(series.pacf(panel(spark, d), K, T, Y, 3).select("key", "lag", "pacf"), 8, "pacf")


@query("eacf")
def eacf_query(spark, d):
    return series.eacf(panel(spark, d), K, T, Y)


@query("eacf_row0", f"""WITH {ACF} SELECT key, CAST(lag - 1 AS INTEGER) AS ma, round(acf, 8) AS eacf, abs(acf) > 2.0::DOUBLE / sqrt(n - lag + 1) AS significant FROM r WHERE lag <= 8""")
def eacf_row0_query(spark, d):
    """The row without an autoregression, which is the plain autocorrelations."""
    out = series.eacf(panel(spark, d), K, T, Y).filter("ar = 0")
    return rounded(out.select("key", "ma", "eacf", "significant"), 8, "eacf")


@query("portmanteau", f"""WITH {ACF} SELECT key, round(max(n) * sum(acf * acf), 5) AS box_pierce, round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 5) AS ljung_box,
  10::BIGINT AS df FROM r WHERE lag <= 10 GROUP BY key""")
def portmanteau_query(spark, d):
    return rounded(series.portmanteau(panel(spark, d), K, T, Y, 10).drop("bp_p", "lb_p"), 5, "box_pierce", "ljung_box")


@query("boxcox_lambda", f"""WITH {DAILY}, f AS (SELECT key, i, i / 10.0::DOUBLE AS lam, y FROM o, range(-20, 21) t(i)),
l AS (SELECT key, lam, -count(*) / 2.0::DOUBLE * ln(var_pop(CASE WHEN i = 0 THEN ln(y) ELSE (power(y, lam) - 1) / lam END)) + (lam - 1) * sum(ln(y)) AS ll FROM f GROUP BY key, lam, i)
SELECT key, arg_max(lam, ll) AS lambda, round(max(ll), 4) AS loglik FROM l GROUP BY key""")
def boxcox_lambda_query(spark, d):
    return rounded(series.boxcox_lambda(daily(spark, d), K, T, Y), 4, "loglik")


@query("boxcox", f"""WITH {DAILY} SELECT key, day, round((power(y, 0.3::DOUBLE) - 1) / 0.3::DOUBLE, 7) AS z, round(ln(y), 7) AS lg, round(y, 5) AS back FROM o""")
def boxcox_query(spark, d):
    z = X.box_cox(F.col("y"), 0.3)
    return daily(spark, d).select("key", "day", F.round(z, 7).alias("z"), F.round(X.box_cox(F.col("y"), 0), 7).alias("lg"),
                                  F.round(X.inv_box_cox(z, 0.3), 5).alias("back"))


KPSS = f"""{PANEL}, m AS (SELECT key, avg(y) AS m, count(*) AS n, CAST(floor(4 * power(count(*) / 100, 0.25::DOUBLE)) AS BIGINT) AS l FROM p GROUP BY key),
e AS (SELECT p.key, row_number() OVER w AS i, y - m AS e, sum(y - m) OVER w AS s, n, l FROM p JOIN m USING (key) WINDOW w AS (PARTITION BY p.key ORDER BY day)),
g AS (SELECT a.key, a.i - b.i AS k, sum(a.e * b.e) / max(a.n) AS c, max(a.l) AS l FROM e a JOIN e b ON a.key = b.key AND a.i - b.i BETWEEN 0 AND a.l GROUP BY a.key, a.i - b.i),
v AS (SELECT key, sum(CASE WHEN k = 0 THEN c ELSE 2 * (1 - k / (l + 1.0::DOUBLE)) * c END) AS s2 FROM g GROUP BY key),
kp AS (SELECT e.key, max(n) AS n, max(l) AS lags, sum(s * s) / (max(n) * max(n)) / max(s2) AS kpss FROM e JOIN v USING (key) GROUP BY e.key)"""


@query("kpss", f"WITH {KPSS} SELECT key, n, lags, round(kpss, 7) AS kpss FROM kp")
def kpss_query(spark, d):
    return rounded(series.kpss(panel(spark, d), K, T, Y), 7, "kpss")


@query("ndiffs", f"WITH {KPSS} SELECT key, CASE WHEN kpss < 0.463 THEN 0 ELSE 1 END AS ndiffs FROM kp")
def ndiffs_query(spark, d):
    return series.ndiffs(panel(spark, d), K, T, Y, 1)


DEC = f"""{PANEL}, t AS (SELECT key, day, y, CAST(dayofweek(day) + 1 AS INTEGER) AS season, CASE WHEN count(*) OVER w = 7 THEN avg(y) OVER w END AS trend FROM p
  WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
f AS (SELECT key, season, avg(y - trend) AS f FROM t GROUP BY key, season), g AS (SELECT key, season, f - avg(f) OVER (PARTITION BY key) AS seasonal FROM f),
dc AS (SELECT t.*, seasonal, y - trend - seasonal AS remainder FROM t JOIN g USING (key, season))"""


@query("nsdiffs", f"""WITH {DEC} SELECT key, round(greatest(0, 1 - var_samp(remainder) / var_samp(remainder + seasonal)), 7) AS strength,
  (greatest(0, 1 - var_samp(remainder) / var_samp(remainder + seasonal)) > 0.64)::INT AS nsdiffs FROM dc GROUP BY key""")
def nsdiffs_query(spark, d):
    return rounded(series.nsdiffs(panel(spark, d), K, T, Y, F.dayofweek("day"), 7), 7, "strength")


@query("lag_table", f"WITH {PANEL} SELECT key, day, round(y, 6) AS y, round(lag(y, 1) OVER w, 6) AS lag1, round(lag(y, 2) OVER w, 6) AS lag2 FROM p WINDOW w AS (PARTITION BY key ORDER BY day)")
def lag_table_query(spark, d):
    return rounded(series.lagged(panel(spark, d), K, T, Y, 2), 6, "y", "lag1", "lag2")


@query("subseries_means", f"WITH {PANEL} SELECT key, CAST(month(day) AS INTEGER) AS season, round(avg(y), 5) AS mean, count(*) AS n FROM p GROUP BY 1, 2")
def subseries_means_query(spark, d):
    return rounded(series.subseries_means(panel(spark, d), K, F.month("day"), Y), 5, "mean")


@query("series_display", f"""WITH {ACF}, w AS (SELECT key, max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2 FROM r GROUP BY key)
SELECT key, 'value' AS kind, CAST(row_number() OVER (PARTITION BY key ORDER BY day) AS INTEGER) AS position, round(y, 5) AS value FROM p
UNION ALL SELECT key, 'acf', lag, round(acf, 5) FROM r WHERE lag <= 2
UNION ALL SELECT key, 'pacf', 1, round(r1, 5) FROM w UNION ALL SELECT key, 'pacf', 2, round((r2 - r1 * r1) / (1 - r1 * r1), 5) FROM w""")
def series_display_query(spark, d):
    return rounded(series.series_display(panel(spark, d), K, T, Y, 2), 5, "value")


@query("decompose", f"WITH {DEC} SELECT key, day, round(trend, 5) AS trend, round(seasonal, 5) AS seasonal, round(remainder, 5) AS remainder FROM dc")
def decompose_query(spark, d):
    parts = series.decompose(panel(spark, d), K, T, Y, F.dayofweek("day"), 7)
    return rounded(parts.select("key", "day", "trend", "seasonal", "remainder"), 5, "trend", "seasonal", "remainder")
