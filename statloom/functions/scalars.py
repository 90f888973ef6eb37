"""Scalar functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_to_number(col: Column) -> Column:
    """Number from text with thousands commas; unreadable text gives null."""
    return F.regexp_replace(col, ",", "").try_cast("double")


def to_day(col: Column, fmt: str = "M/d/yyyy") -> Column:
    """Date from text; unreadable text gives null."""
    return F.try_to_date(col, fmt)


def day_name(col: Column) -> Column:
    return F.date_format(col, "E")


def is_weekend(col: Column) -> Column:
    return F.dayofweek(col).isin(1, 7)


def floor_to(col: Column, step: int) -> Column:
    return F.floor(col / step) * step


def comma(col: Column, digits: int = 0) -> Column:
    """Thousands separators for labels."""
    return F.format_number(col, digits)


def cloglog(s: Column) -> Column:
    """-log(-log(s)); null at 0 and 1 where the curve is not defined."""
    return F.when((s > 0) & (s < 1), -F.log(-F.log(s)))


def logit(p: Column) -> Column:
    """Log odds; null at 0 and 1."""
    return F.log(F.nullif(F.try_divide(p, 1 - p), F.lit(0.0)))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def box_cox(y: Column, lam: float) -> Column:
    """(y^lambda - 1)/lambda, log at 0; null where a log is not defined."""
    if lam == 0:
        return F.when(y > 0, F.log(y))
    return (F.pow(y, F.lit(float(lam))) - 1) / lam


def inv_box_cox(z: Column, lam: float) -> Column:
    if lam == 0:
        return F.exp(z)
    base = z * lam + 1
    return F.when(base > 0, F.pow(base, F.lit(1.0 / lam)))


def regression_metrics(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates: squared-correlation R2, RMSE and MAE."""
    err = predicted - actual
    r = F.corr(actual, predicted)
    return [(r * r).alias("r2"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae")]


def sse_metrics(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates: RMSE and 1 - SSE/SST (which may be negative, unlike squared correlation)."""
    sse = F.sum((predicted - actual) * (predicted - actual))
    sst = F.var_pop(actual) * F.count(actual)
    return [F.sqrt(sse / F.count(F.lit(1))).alias("rmse"), (1 - F.try_divide(sse, sst)).alias("r_square")]


# Coefficients of the normal tail approximation, Abramowitz and Stegun 26.2.17.
NORMAL_TAIL_P = 0.2316419
NORMAL_TAIL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327


def norm_pdf(x: Column) -> Column:
    return F.lit(INV_SQRT_2PI) * F.exp(-x * x / 2)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error below 7.5e-8."""
    t = 1 / (1 + NORMAL_TAIL_P * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(NORMAL_TAIL_B):
        poly = (poly + b) * t
    tail = norm_pdf(x) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


# The published rational approximation of the normal quantile (algorithm AS 241, 16 digits),
# numerator and denominator by rising power, for the middle, the tails and the far tails.
NORMAL_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
NORMAL_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
NORMAL_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _ratio(table, x: Column) -> Column:
    top, bottom = (reduce(lambda a, c: a * x + F.lit(c), reversed(side[:-1]), F.lit(side[-1])) for side in table)
    return top / bottom


def normal_score(p: Column) -> Column:
    """Standard normal quantile as an expression; null outside (0, 1)."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.signum(q) * F.when(r <= 5, _ratio(NORMAL_TAIL, r - 1.6)).otherwise(_ratio(NORMAL_FAR, r - 5))
    middle = q * _ratio(NORMAL_MIDDLE, F.lit(0.180625) - q * q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(tail))
