"""Right-censored durations: life tables, log-rank and proportional hazards.

Rows are reduced to one line per (stratum, time) first.  Risk sets are running sums
over those lines, taken in two levels so that a long time axis stays distributed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.ordered import quantiles, row_positions, running, with_chunks
from statloom.functions.scalars import cloglog
from statloom.functions.tails import chi2_p, z_p
from statloom.functions.vectors import vector_udf
from statloom.operators.linear import gram, unpack
from statloom.operators.recode import levels_of

Z95 = 1.959963984540054


# ---------------------------------------------------------------- life tables

def risk_table(df: DataFrame, time: str, event: str, by: list[str] = ()) -> DataFrame:
    """(by, time, n_risk, n_event, n_censor) at every observed time."""
    return _risk_lines(df, time, event, by).drop("chunk")


def _risk_lines(df: DataFrame, time: str, event: str, by: list[str]) -> DataFrame:
    by = list(by)
    lines = df.dropna(subset=[time, event]).groupBy(*by, time).agg(
        F.sum(F.col(event).cast("bigint")).alias("n_event"),
        F.sum(1 - F.col(event).cast("bigint")).alias("n_censor"), F.count(F.lit(1)).alias("n"))
    out = running(with_chunks(lines, time, "chunk"), by, time, sums=["n"], reverse=True, chunk="chunk")
    return out.select(*by, time, F.col("cum_n").alias("n_risk"), "n_event", "n_censor", "chunk")


def risk_at(table: DataFrame, time: str, breaks: list[float], by: list[str] = ()) -> DataFrame:
    """Number still at risk and events so far at plot breaks."""
    at = F.explode(F.array(*[F.lit(float(b)) for b in breaks])).alias("break")
    left = F.when(F.col(time) >= F.col("break"), F.col("n_event") + F.col("n_censor")).otherwise(0)
    return table.select("*", at).groupBy(*by, "break").agg(
        F.sum(left).alias("n_risk"), F.sum(F.when(F.col(time) <= F.col("break"), F.col("n_event")).otherwise(0)).alias("n_event"))


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str] = (), z: float = Z95) -> DataFrame:
    """Survival with Greenwood error and log-scale interval, cumulative hazards and cloglog."""
    by = list(by)
    n, d = F.col("n_risk"), F.col("n_event")
    steps = _risk_lines(df, time, event, by).withColumns({
        "keep": 1 - d / n, "gw": F.when(n > d, d / (n * (n - d)).cast("double")),
        "dn": d / n, "gone": F.when(n == d, 1).otherwise(0)})
    steps = steps.withColumn("gw", F.coalesce("gw", F.lit(0.0)))
    out = running(steps, by, time, sums=["gw", "dn", "gone"], products=["keep"], chunk="chunk")
    s = F.col("cumprod_keep")
    root = F.when(F.col("cum_gone") == 0, F.sqrt("cum_gw"))
    return out.select(*by, time, "n_risk", "n_event", "n_censor", s.alias("surv"), (s * root).alias("std_err"),
                      (s * F.exp(-z * root)).alias("lower"), F.least(s * F.exp(z * root), F.lit(1.0)).alias("upper"),
                      F.when(s > 0, -F.log(s)).alias("cum_hazard"), F.col("cum_dn").alias("nelson_aalen"),
                      cloglog(s).alias("cloglog"))


def km_median(df: DataFrame, time: str, event: str, by: list[str] = ()) -> DataFrame:
    """(by, n, events, median, lower, upper); a curve that stays above one half gives null."""
    km = kaplan_meier(df, time, event, by)
    half = 0.5 + 1e-12

    def first(c):
        return F.min(F.when(F.col(c) <= half, F.col(time)))

    return km.groupBy(*by).agg(F.max("n_risk").alias("n"), F.sum("n_event").alias("events"),
                               first("surv").alias("median"), first("lower").alias("lower"), first("upper").alias("upper"))


@vector_udf("double")
def _chi2_of(y: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([float(np.asarray(a) @ np.linalg.pinv(unpack(b), hermitian=True) @ np.asarray(a))
                      for a, b in zip(y, v)])


def logrank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Per group: n, observed, expected; with the test's chi2, df and p on every row."""
    levels = levels_of(df, group)
    rows = df.dropna(subset=[time, event, group])
    k = len(levels)
    lines = rows.groupBy(time).agg(
        *[F.sum(F.when(F.col(group) == F.lit(v), 1).otherwise(0)).alias(f"n{i}") for i, v in enumerate(levels)],
        *[F.sum(F.when(F.col(group) == F.lit(v), F.col(event).cast("bigint")).otherwise(0)).alias(f"d{i}")
          for i, v in enumerate(levels)])
    at = running(lines, [], time, sums=[f"n{i}" for i in range(k)], reverse=True)
    r = [F.col(f"cum_n{i}").cast("double") for i in range(k)]
    n = sum(r[1:], r[0])
    d = sum((F.col(f"d{i}") for i in range(1, k)), F.col("d0"))
    spread = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    cov = [F.sum(spread * (r[i] / n) * ((1.0 if i == j else 0.0) - r[j] / n)) for i in range(k - 1) for j in range(i, k - 1)]
    one = at.agg(F.array(*[F.sum(f"n{i}") for i in range(k)]).alias("n"),
                 F.array(*[F.sum(f"d{i}") for i in range(k)]).alias("o"),
                 F.array(*[F.sum(d * r[i] / n) for i in range(k)]).alias("e"), F.array(*cov).alias("v"))
    diff = F.array(*[F.col("o")[i] - F.col("e")[i] for i in range(k - 1)])
    one = one.withColumn("chi2", _chi2_of(diff, "v"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(v).alias(group), F.col("n")[i].alias("n"), F.col("o")[i].alias("observed"), F.col("e")[i].alias("expected"))
        for i, v in enumerate(levels)]))
    out = one.select(cells.alias("c"), "chi2", F.lit(k - 1).cast("bigint").alias("df")).select("c.*", "chi2", "df")
    return out.withColumn("p_value", chi2_p("chi2", F.col("df").cast("double")))


# ---------------------------------------------------------------- proportional hazards

EFRON = "a1 double, a2 double, b0 double, b1 double, b2 double, lg double"


CUTS = 1000  # chunks of the time axis at most; a chunk holds a thousandth of the rows, or one time
LAST = 16  # ties that are summed one by one, from the smallest denominator up


def _harmonic(low: np.ndarray, high: np.ndarray):
    """Sums of 1/x, 1/x^2 and log x over x = low, low + 1, ..., high by the Euler-Maclaurin formula; low is above LAST."""
    i, j, step = 1 / low, 1 / high, np.log1p((high - low) / low)
    one = step + (i + j) / 2 + (i ** 2 - j ** 2) / 12 - (i ** 4 - j ** 4) / 120 + (i ** 6 - j ** 6) / 252 - (i ** 8 - j ** 8) / 240
    two = i - j + (i ** 2 + j ** 2) / 2 + (i ** 3 - j ** 3) / 6 - (i ** 5 - j ** 5) / 30 + (i ** 7 - j ** 7) / 42
    logs = ((high - low) * (np.log(high) - 1) + low * step + (np.log(low) + np.log(high)) / 2 - (i - j) / 12
            + (i ** 3 - j ** 3) / 360 - (i ** 5 - j ** 5) / 1260)
    return one, two, logs


def _tie_sums(s0, d0, d) -> np.ndarray:
    """Per event time, with u = l/d and phi = s0 - u d0 over its ties l:
    sum 1/phi, sum u/phi, sum u^k/phi^2 for k = 0, 1, 2, and sum log phi.

    The LAST ties with the smallest phi are added up, the others have phi = (a - l) d0 / d with a - l above LAST.
    """
    s0, d0, d = (np.asarray(v, dtype=float) for v in (s0, d0, d))
    out = np.zeros((len(s0), 6))
    for back in range(1, LAST + 1):
        at = np.flatnonzero(d >= back)
        u = (d[at] - back) / d[at]
        phi = s0[at] - u * d0[at]
        out[at] += np.column_stack([1 / phi, u / phi, 1 / phi ** 2, u / phi ** 2, (u / phi) ** 2, np.log(phi)])
    more = np.flatnonzero(d > LAST)
    if len(more):
        e, k, m = d0[more], d[more], d[more] - LAST
        a = np.maximum(k * s0[more] / e, k)
        one, two, logs = _harmonic(a - m + 1, a)
        out[more] += np.column_stack([k / e * one, (a * one - m) / e, (k / e) ** 2 * two, k / e ** 2 * (a * two - one),
                                      (a * a * two - 2 * a * one + m) / e ** 2, m * np.log(e / k) + logs])
    return out


@vector_udf(EFRON)
def _efron(s0: pd.Series, d0: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_tie_sums(s0, d0, d), columns=["a1", "a2", "b0", "b1", "b2", "lg"])


@dataclass
class CoxFit:
    """A fitted model: p-sized results here, row-sized ones through ``rows``."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    loglik0: float
    score0: np.ndarray
    info0: np.ndarray
    n: int
    events: int
    rows: DataFrame = field(repr=False)
    centre: np.ndarray = field(repr=False)
    scale: np.ndarray = field(repr=False)
    iterations: int = 0

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * len(self.beta)


def _at(prefix: str, p: int, i: int, j: int) -> Column:
    """Cross product (i, j) of a packed (p+1) x (p+1) triangle kept as columns."""
    i, j = min(i, j), max(i, j)
    return F.col(f"{prefix}{i * (p + 1) - i * (i - 1) // 2 + j - i}")


def _prepare(df: DataFrame, time: str, event: str, cols: dict[str, Column], strata: str | None, keep: list[str]):
    xs = [f"x{i}" for i in range(len(cols))]
    rows = df.select(F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("ev"),
                     (F.lit("all") if strata is None else F.col(strata).cast("string")).alias("st"),
                     *[c.cast("double").alias(x) for x, c in zip(xs, cols.values())],
                     *[F.col(k).alias(f"k_{k}") for k in keep]).dropna(subset=["time", "ev", "st", *xs])
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("ev").alias("e"), *[F.avg(x).alias(f"m_{x}") for x in xs],
                   *[F.stddev_pop(x).alias(f"s_{x}") for x in xs],
                   F.percentile_approx("time", [i / CUTS for i in range(1, CUTS)], 10 * CUTS).alias("cuts")).first()
    centre = np.array([one[f"m_{x}"] for x in xs])
    scale = np.array([one[f"s_{x}"] or 1.0 for x in xs])
    rows = rows.withColumns({x: (F.col(x) - F.lit(float(c))) / F.lit(float(s)) for x, c, s in zip(xs, centre, scale)})
    # the time axis is cut once, at about every thousandth row or more; each pass then accumulates inside the chunks
    cuts = sorted(set((one["cuts"] or [0.0])[::max(CUTS * 1000 // max(one["n"], 1), 1)]))
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="time", outputCol="chunk", handleInvalid="keep")
    return split.transform(rows).withColumn("chunk", F.col("chunk").cast("int")).persist(), xs, centre, scale, int(one["n"]), int(one["e"] or 0)


def _eta(beta, xs) -> Column:
    return sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, xs)), F.lit(0.0))


def _risk_parts(rows: DataFrame, xs: list[str], beta) -> DataFrame:
    """Weighted cross products per (stratum, chunk, time, event).

    The coefficients ride along as a one-row table: the plan stays the same in every
    iteration, and with it the generated code.
    """
    b = F.broadcast(rows.sparkSession.createDataFrame([([float(v) for v in beta],)], "__beta array<double>"))
    eta = sum((F.col("__beta")[i] * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return gram(rows.crossJoin(b), [F.lit(1.0), *[F.col(x) for x in xs]], ["st", "chunk", "time", "ev"], F.exp(eta))


def _per_time(rows: DataFrame, xs: list[str], beta) -> DataFrame:
    """Event times with risk-set sums ``cum_s*``, event sums ``d*`` and the tie sums."""
    m = (len(xs) + 1) * (len(xs) + 2) // 2
    each = range(m)
    # one statement: building the same plan step by step takes longer than running it
    at = rows.sparkSession.sql(f"""
        WITH lines AS (
          SELECT st, chunk, time, sum(if(ev = 1, n, 0)) AS nd, {", ".join(f"sum(g[{i}]) AS s{i}, sum(if(ev = 1, g[{i}], 0D)) AS d{i}" for i in each)}
          FROM {{parts}} GROUP BY st, chunk, time),
        later AS (
          SELECT st, chunk, {", ".join(f"coalesce(sum(sum(s{i})) OVER w, 0D) AS o{i}" for i in each)}
          FROM lines GROUP BY st, chunk WINDOW w AS (PARTITION BY st ORDER BY chunk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        summed AS (
          SELECT l.st, l.chunk, time, nd, {", ".join(f"d{i}, o{i} + sum(s{i}) OVER w AS cum_s{i}" for i in each)}
          FROM lines l JOIN later o ON l.st = o.st AND l.chunk = o.chunk
          WINDOW w AS (PARTITION BY l.st, l.chunk ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT * FROM summed WHERE nd > 0""", parts=_risk_parts(rows, xs, beta).repartition("st", "chunk"))
    return at.withColumn("t", _efron("cum_s0", "d0", "nd"))


def _derivatives(at: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """sum log phi, expected covariate sums and information, as one collected row."""
    t = lambda name: F.col(f"t.{name}")
    s = lambda i, j: _at("cum_s", p, i, j)
    d = lambda i, j: _at("d", p, i, j)
    mean = [F.sum(s(0, i) * t("a1") - d(0, i) * t("a2")) for i in range(1, p + 1)]
    info = [F.sum(s(i, j) * t("a1") - d(i, j) * t("a2")
                  - (s(0, i) * s(0, j) * t("b0") - (s(0, i) * d(0, j) + d(0, i) * s(0, j)) * t("b1")
                     + d(0, i) * d(0, j) * t("b2")))
            for i in range(1, p + 1) for j in range(i, p + 1)]
    one = at.agg(F.sum(t("lg")).alias("lg"), F.array(*mean).alias("mean"), F.array(*info).alias("info")).first()
    return one["lg"], np.array(one["mean"]), unpack(one["info"])


def cox_fit(df: DataFrame, time: str, event: str, cols: dict[str, Column], strata: str | None = None,
            penalty: np.ndarray | None = None, keep: list[str] = (), tol: float = 1e-9, max_iter: int = 25) -> CoxFit:
    """Newton iteration with Efron ties; every step is one pass that returns p + p^2 numbers.

    ``cols`` maps coefficient names to expressions (see ``recode.design_columns``);
    ``strata`` gives each of its levels an own baseline.
    """
    rows, xs, centre, scale, n, events = _prepare(df, time, event, cols, strata, list(keep))
    p = len(xs)
    moved = rows.filter("ev = 1").agg(F.array(*[F.sum(x) for x in xs]).alias("x")).first()["x"]
    event_x = np.array([v or 0.0 for v in moved])
    pen = np.zeros((p, p)) if penalty is None else np.asarray(penalty) / np.outer(scale, scale)
    beta, best, start = np.zeros(p), -math.inf, None
    for step in range(1, max_iter + 1):
        lg, mean, info = _derivatives(_per_time(rows, xs, beta), p)
        loglik = float(beta @ event_x - lg)
        score = event_x - mean
        if start is None:
            start = (loglik, score.copy(), info.copy())
        target = loglik - 0.5 * beta @ pen @ beta
        if target < best - 1e-9 * abs(best):
            beta = (beta + held) / 2
            continue
        move = np.linalg.pinv(info + pen, hermitian=True) @ (score - pen @ beta)
        done = abs(target - best) < tol * (abs(target) + tol) and np.abs(move).max(initial=0) < 1e-6
        best, held = target, beta
        if done:
            break
        beta = beta + move
    else:
        raise RuntimeError("Cox iteration did not settle")
    inv = np.linalg.pinv(info + pen, hermitian=True)
    return CoxFit(list(cols), beta / scale, inv / np.outer(scale, scale), loglik, start[0], start[1] * scale,
                  start[2] * np.outer(scale, scale), n, events, rows, centre, scale, step)


def _std_beta(fit: CoxFit) -> np.ndarray:
    return fit.beta * fit.scale


def _xs(fit: CoxFit) -> list[str]:
    return [f"x{i}" for i in range(len(fit.beta))]


def _table(fit: CoxFit, columns: dict[str, list]) -> DataFrame:
    """Driver-side coefficient table: one line per coefficient."""
    spark = fit.rows.sparkSession
    return spark.createDataFrame(pd.DataFrame(columns))


def cox_summary(fit: CoxFit) -> DataFrame:
    """term, coef, hazard ratio, standard error, z, p and the 95 % interval of the ratio."""
    se = np.sqrt(np.maximum(np.diag(fit.cov), 0))
    out = _table(fit, {"term": fit.names, "coef": fit.beta, "hazard_ratio": np.exp(fit.beta), "std_error": se,
                       "z": fit.beta / np.where(se > 0, se, np.nan), "hr_low": np.exp(fit.beta - Z95 * se),
                       "hr_high": np.exp(fit.beta + Z95 * se)})
    return out.withColumn("p_value", z_p("z"))


def cox_start(fit: CoxFit) -> DataFrame:
    """Score and information at zero coefficients, in long form."""
    p = len(fit.beta)
    i, j = np.meshgrid(range(p), range(p), indexing="ij")
    return _table(fit, {"term_i": np.array(fit.names)[i.ravel()], "term_j": np.array(fit.names)[j.ravel()],
                        "score_i": fit.score0[i.ravel()], "information": fit.info0.ravel()})


def _scored(fit: CoxFit) -> DataFrame:
    return fit.rows.withColumn("eta", _eta(_std_beta(fit), _xs(fit)))


def cox_concordance(fit: CoxFit) -> DataFrame:
    """Share of comparable pairs ordered by the risk score; ties count one half.

    Scores are replaced by their ranks.  Two ranks differ first, from the top, in one binary digit: below it they share a block
    in which one has digit 0 and the other 1.  So an event's lower scores are counted, digit by digit, among the later rows of its
    block with digit 0, by running sums along the time; no pair is ever formed and no score is rounded.
    """
    rows = _scored(fit)
    ranks = row_positions(rows.select("eta").distinct(), "eta", "rank")
    cells = rows.join(ranks, "eta").groupBy("st", "chunk", "time", "rank").agg(
        F.sum("ev").cast("bigint").alias("e"), F.count(F.lit(1)).alias("n"))
    digits = range(int(fit.n).bit_length())
    rank = F.col("rank")

    def line(level, block, lower, upper):
        return F.struct(F.lit(level).alias("level"), block.cast("bigint").alias("block"),
                        lower.cast("int").alias("lower"), upper.cast("int").alias("upper"))

    places = [line(-2, F.lit(0), F.lit(1), F.lit(1)), line(-1, rank, F.lit(1), F.lit(1))]  # all pairs, and those of one rank
    places += [line(i, F.shiftright("rank", i + 1), 1 - F.shiftright("rank", i) % 2, F.shiftright("rank", i) % 2) for i in digits]
    keys = ["st", "level", "block"]
    lines = cells.select("st", "chunk", "time", "e", "n", F.explode(F.array(*places)).alias("p")).select("*", "p.*").groupBy(
        *keys, "chunk", "time").agg(F.sum(F.col("n") * F.col("lower")).alias("low"), F.sum(F.col("e") * F.col("lower")).alias("low_e"),
                                    F.sum(F.col("e") * F.col("upper")).alias("up"))
    # a censored row of the same time outlives the event
    counted = running(lines, keys, "time", sums=["low"], reverse=True, chunk="chunk").filter("up > 0")
    pairs = F.col("up").cast("double") * (F.col("cum_low") - F.col("low_e"))

    def total(name, which):
        return F.coalesce(F.sum(F.when(which, pairs)), F.lit(0.0)).alias(name)

    one = counted.agg(total("concordant", F.col("level") >= 0), total("tied", F.col("level") == -1), total("pairs", F.col("level") == -2))
    return one.withColumn("concordance", F.when(F.col("pairs") > 0, (F.col("concordant") + F.col("tied") / 2) / F.col("pairs")))


def cox_baseline(fit: CoxFit) -> DataFrame:
    """Hazard steps, cumulative hazard and survival at the covariate means."""
    at = _per_time(fit.rows, _xs(fit), _std_beta(fit)).select(
        "st", "chunk", "time", "nd", F.col("t.a1").alias("h"), F.col("t.a2").alias("tie"))
    out = running(at, ["st"], "time", sums=["h"], chunk="chunk")
    return out.select(F.col("st").alias("stratum"), "time", F.col("nd").alias("n_event"), F.col("h").alias("hazard"),
                      F.col("cum_h").alias("cum_hazard"), F.exp(-F.col("cum_h")).alias("surv"), "tie")


def cox_lrt(fits: list[tuple[str, CoxFit]], null: bool = True) -> DataFrame:
    """Likelihood-ratio tests of each model against the one before it (first: no covariates)."""
    lines, last_ll, last_p = [], fits[0][1].loglik0, 0
    for i, (label, fit) in enumerate(fits):
        if i or null:
            lines.append((label, float(fit.loglik), 2 * (fit.loglik - last_ll), len(fit.beta) - last_p, float(fit.aic)))
        last_ll, last_p = fit.loglik, len(fit.beta)
    spark = fits[0][1].rows.sparkSession
    out = spark.createDataFrame(lines, "model string, loglik double, chi2 double, df bigint, aic double")
    return out.withColumn("p_value", chi2_p("chi2", F.col("df").cast("double")))


def _zph_table(fit: CoxFit) -> DataFrame:
    """Per event time: events, summed Schoenfeld residuals ``r*`` (standardised units) and KM transform ``g``."""
    xs, p = _xs(fit), len(fit.beta)
    at = _per_time(fit.rows, xs, _std_beta(fit))
    moved = fit.rows.filter("ev = 1").groupBy("st", "time").agg(*[F.sum(x).alias(f"e{i}") for i, x in enumerate(xs)])
    keep = _risk_lines(fit.rows, "time", "ev", []).select("time", "chunk", (1 - F.col("n_event") / F.col("n_risk")).alias("keep"))
    g = running(keep, [], "time", products=["keep"], chunk="chunk", inclusive=False).select("time", (1 - F.col("cumprod_keep")).alias("g"))
    joined = at.join(moved, ["st", "time"]).join(g, "time")
    resid = {f"r{i}": F.col(f"e{i}") - (_at("cum_s", p, 0, i + 1) * F.col("t.a1") - _at("d", p, 0, i + 1) * F.col("t.a2"))
             for i in range(p)}
    return joined.withColumns(resid).select("st", "time", "nd", "g", *resid)


def cox_zph(fit: CoxFit) -> DataFrame:
    """Proportional-hazards test per term and overall: scaled Schoenfeld residuals against 1 - KM(t-)."""
    p = len(fit.beta)
    rows = _zph_table(fit)
    gbar = rows.agg((F.sum(F.col("nd") * F.col("g")) / F.sum("nd")).alias("gbar"))
    c = F.col("g") - F.col("gbar")
    one = rows.crossJoin(F.broadcast(gbar)).agg(
        F.array(*[F.sum(c * F.col(f"r{i}")) for i in range(p)]).alias("u"), F.sum(F.col("nd") * c * c).alias("ss")).first()
    u, ss = np.array(one["u"]) * fit.scale, one["ss"]
    vu = fit.cov @ u
    chi = fit.events * vu ** 2 / (np.diag(fit.cov) * ss)
    total = fit.events * float(u @ vu) / ss
    out = fit.rows.sparkSession.createDataFrame(
        [(t, float(x), 1) for t, x in zip(fit.names, chi)] + [("GLOBAL", total, p)], "term string, chi2 double, df bigint")
    return out.withColumn("p_value", chi2_p("chi2", F.col("df").cast("double")))


def cox_residuals(fit: CoxFit) -> DataFrame:
    """Martingale, deviance, Schoenfeld (events only) and dfbeta columns beside the kept keys."""
    xs, p = _xs(fit), len(fit.beta)
    at = _per_time(fit.rows, xs, _std_beta(fit))
    t = lambda name: F.col(f"t.{name}")
    s, d = (lambda i: _at("cum_s", p, 0, i + 1)), (lambda i: _at("d", p, 0, i + 1))
    steps = at.select(
        "st", "time", t("a1").alias("h"), t("a2").alias("tie"),
        *[((s(i) * t("a1") - d(i) * t("a2")) / F.col("nd")).alias(f"m{i}") for i in range(p)],
        *[(s(i) * t("b0") - d(i) * t("b1")).alias(f"q{i}") for i in range(p)],
        *[(s(i) * t("b1") - d(i) * t("b2")).alias(f"qt{i}") for i in range(p)])
    # censored rows of times without events need the hazard so far, so every time gets a line
    times = fit.rows.select("st", "chunk", "time").distinct().join(steps, ["st", "time"], "left").fillna(
        0.0, ["h", "tie", *[f"q{i}" for i in range(p)], *[f"qt{i}" for i in range(p)]])
    table = running(times, ["st"], "time", sums=["h", *[f"q{i}" for i in range(p)]], chunk="chunk").drop("chunk")
    rows = _scored(fit).join(table, ["st", "time"])
    risk, ev = F.exp("eta"), F.col("ev")
    hazard = F.col("cum_h") - ev * F.col("tie")
    mart = ev - risk * hazard
    dev = F.signum(mart) * F.sqrt(F.greatest(-2 * (mart + F.when(ev == 1, F.log(ev - mart)).otherwise(0.0)), F.lit(0.0)))
    sch = [F.when(ev == 1, F.col(x) - F.col(f"m{i}")) for i, x in enumerate(xs)]
    score = [F.coalesce(sch[i], F.lit(0.0)) - risk * (F.col(x) * hazard - (F.col(f"cum_q{i}") - ev * F.col(f"qt{i}")))
             for i, x in enumerate(xs)]
    std_cov = fit.cov * np.outer(fit.scale, fit.scale)
    keep = [c for c in fit.rows.columns if c.startswith("k_")]
    return rows.select(
        *[F.col(k).alias(k[2:]) for k in keep], "time", F.col("ev").alias("event"), "eta", mart.alias("martingale"),
        dev.alias("deviance"),
        *[(sch[i] * float(fit.scale[i])).alias(f"schoenfeld_{n}") for i, n in enumerate(fit.names)],
        *[(sum((score[j] * float(std_cov[i, j]) for j in range(p)), F.lit(0.0)) / float(fit.scale[i])).alias(f"dfbeta_{n}")
          for i, n in enumerate(fit.names)])


def cox_select(fit: CoxFit, terms: dict[str, list[str]]) -> tuple[list[str], list[tuple]]:
    """Backward elimination by AIC on the fitted coefficients and covariance.

    Uses the estimates conditional on the dropped terms being zero, so no refits are
    needed; ``terms`` maps a term to its coefficient names.
    """
    kept, trace = list(terms), []
    place = {n: i for i, n in enumerate(fit.names)}
    dropped: list[int] = []
    while kept:
        live = [place[n] for t in kept for n in terms[t]]
        beta, cov = fit.beta[live], fit.cov[np.ix_(live, live)]
        if dropped:
            cross = fit.cov[np.ix_(live, dropped)] @ np.linalg.inv(fit.cov[np.ix_(dropped, dropped)])
            beta = beta - cross @ fit.beta[dropped]
            cov = cov - cross @ fit.cov[np.ix_(dropped, live)]
        where = {n: i for i, n in enumerate(live)}
        scores = []
        for t in kept:
            idx = [where[place[n]] for n in terms[t]]
            wald = float(beta[idx] @ np.linalg.solve(cov[np.ix_(idx, idx)], beta[idx]))
            scores.append((wald - 2 * len(idx), wald, len(idx), t))
        gain, wald, df, term = min(scores)
        if gain >= 0:
            break
        kept.remove(term)
        dropped += [place[n] for n in terms[term]]
        trace.append((len(trace) + 1, term, wald, df, gain))
    return kept, trace


def cox_gof(fit: CoxFit, groups: int = 10) -> DataFrame:
    """Observed against expected events in bands of the risk score."""
    resid = cox_residuals(fit).select("eta", "event", "martingale").persist()  # read three times below
    cuts = quantiles(resid, ["eta"], [i / groups for i in range(1, groups)]).agg(
        F.sort_array(F.collect_list("q")).alias("cuts"))
    band = F.size(F.filter("cuts", lambda c: c < F.col("eta"))).cast("int") + 1
    out = resid.crossJoin(F.broadcast(cuts)).groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("observed"), F.sum(F.col("event") - F.col("martingale")).alias("expected"))
    out = out.withColumn("z", (F.col("observed") - F.col("expected")) / F.sqrt("expected"))
    return out.withColumn("p_value", z_p("z"))


# ---------------------------------------------------------------- parametric and smooth forms

def aft_residuals(df: DataFrame, time: str, event: str, numeric: list[str], keep: list[str] = ()) -> DataFrame:
    """Weibull fit and standardised log-time residuals of rows with a positive time."""
    rows = df.filter(F.col(time) > 0).dropna(subset=[time, event, *numeric])
    ready = VectorAssembler(inputCols=numeric, outputCol="features").transform(
        rows.withColumns({"label": F.col(time).cast("double"), "censor": F.col(event).cast("double")}))
    model = AFTSurvivalRegression(maxIter=200, tol=1e-9).fit(ready)
    lp = sum((F.lit(float(b)) * F.col(n) for b, n in zip(model.coefficients, numeric)), F.lit(float(model.intercept)))
    return rows.select(*keep, time, event, lp.alias("lp"), F.lit(float(model.scale)).alias("scale"),
                       ((F.log(time) - lp) / float(model.scale)).alias("residual"))


def spline_columns(x: Column, low: float, high: float, pieces: int = 8) -> dict[str, Column]:
    """Uniform cubic B-spline basis over [low, high], one column less than the full partition of unity."""
    h = (high - low) / pieces
    out = {}
    for k in range(0, pieces + 2):
        u = F.abs((x - F.lit(low + k * h)) / h)
        out[f"s{k}"] = F.when(u <= 1, (4 - 6 * u * u + 3 * u * u * u) / 6).when(u < 2, F.pow(2 - u, F.lit(3.0)) / 6).otherwise(0.0)
    return out


def cox_spline(df: DataFrame, time: str, event: str, x: str, others: dict[str, Column] | None = None,
               pieces: int = 8, ridge: float = 1.0, grid: int = 41) -> DataFrame:
    """Smooth effect of one covariate: the fitted log hazard on an even grid, centred at its mean."""
    ends = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    basis = spline_columns(F.col(x).cast("double"), lo, hi, pieces)
    names = list(basis)
    diff = np.diff(np.eye(len(names)), n=2, axis=0)
    pen = np.zeros((len(names) + len(others or {}),) * 2)
    pen[:len(names), :len(names)] = ridge * (diff.T @ diff + 1e-3 * np.eye(len(names)))
    fit = cox_fit(df, time, event, {**basis, **(others or {})}, penalty=pen)
    points = df.sparkSession.range(grid).select(
        (F.lit(lo) + F.lit((hi - lo) / (grid - 1)) * F.col("id")).alias("x"))
    on_grid = spline_columns(F.col("x"), lo, hi, pieces)
    effect = sum((F.lit(float(fit.beta[i])) * (on_grid[n] - F.lit(float(fit.centre[i]))) for i, n in enumerate(names)), F.lit(0.0))
    return points.select("x", effect.alias("log_hazard"))
