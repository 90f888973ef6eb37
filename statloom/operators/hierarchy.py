"""Aggregation levels and reconciliation of a total with its parts.

For one parent over its leaves the projection has a closed form: every leaf takes the
gap between parent and leaf sum in proportion to a weight.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.nulls import join_null_safe
from statloom.session import cut


def hier_levels(df: DataFrame, index: list[str], sets: list[list[str]], value: Column, out: str = "y") -> DataFrame:
    """One row per (index, level, key subset): ``level`` numbers the given sets."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    leaves = df.groupBy(*index, *keys).agg(F.sum(value).alias("__v"))
    cols = [[F.col(c) for c in [*index, *s]] for s in sets]
    marks = [(F.grouping(k) == 0) for k in keys]
    level = None
    for i, s in enumerate(sets):
        hit = F.lit(True)
        for k, m in zip(keys, marks):
            hit = hit & (m if k in s else ~m)
        level = F.when(hit, F.lit(i)) if level is None else level.when(hit, F.lit(i))
    return leaves.groupingSets(cols, *index, *keys).agg(F.sum("__v").alias(out), level.alias("level"))


def crossed_sets(keys: list[str]) -> list[list[str]]:
    """All key subsets, for groupings that cross instead of nesting."""
    return [list(c) for k in range(len(keys) + 1) for c in combinations(keys, k)]


def _gap(leaf: DataFrame, total: DataFrame, at: list[str], mean: str, **sums: str) -> DataFrame:
    """Leaves with the gap of their step, the number of leaves and further sums: one line a step joined to the leaves."""
    steps = leaf.groupBy(*at).agg(F.sum(mean).alias("__s"), F.count(F.lit(1)).alias("__m"), *[F.sum(c).alias(n) for n, c in sums.items()])
    steps = join_null_safe(steps, total.select(*at, F.col(mean).alias("__t")), at)
    return join_null_safe(leaf, steps.withColumn("__gap", F.col("__t") - F.col("__s")).drop("__s"), at)


def bottom_up(leaf: DataFrame, at: list[str], mean: str = "mean") -> DataFrame:
    """Total := sum of the leaves."""
    return leaf.groupBy(*at).agg(F.sum(mean).alias(mean))


def recon_ols(leaf: DataFrame, total: DataFrame, at: list[str], mean: str = "mean") -> DataFrame:
    """Equal weights: every leaf takes gap / (m + 1)."""
    rows = _gap(leaf, total, at, mean)
    return rows.withColumn("reconciled", F.col(mean) + F.col("__gap") / (F.col("__m") + 1)).drop("__t", "__gap", "__m")


def recon_wls(leaf: DataFrame, total: DataFrame, at: list[str], leaf_var: str, total_var: str, mean: str = "mean") -> DataFrame:
    """Weights by residual variance; ``total`` holds ``total_var``."""
    rows = _gap(leaf, total, at, mean, __lv=leaf_var)
    rows = join_null_safe(rows, total.select(*at, F.col(total_var).alias("__tv")), at)
    share = F.try_divide(F.col(leaf_var), F.col("__tv") + F.col("__lv"))
    return rows.withColumn("reconciled", F.col(mean) + share * F.col("__gap")).drop("__t", "__gap", "__m", "__tv", "__lv")


def _cross_norm(rows: DataFrame, k: int, block: int = 512) -> DataFrame:
    """One row ``norm2``: squared Frobenius norm of X'X for rows holding an array ``x`` of length ``k``.

    The columns are cut into blocks, and a task holds the products of one pair of blocks at a time, whatever ``k`` is.
    Several pairs are dealt by pair and sorted, so each is summed in one run over its rows; a single one is summed where the rows are.
    """
    count = -(-k // block)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(count) for j in range(i, count)]
    part = lambda c: F.slice("x", c * block + 1, F.lit(block))
    dealt = rows.select("x", F.explode(F.array(*pairs)).alias("p")).select(
        F.col("p.i").alias("i"), F.col("p.j").alias("j"), part(F.col("p.i")).alias("a"), part(F.col("p.j")).alias("b"))
    if count > 1:
        dealt = dealt.repartition(len(pairs), "i", "j").sortWithinPartitions("i", "j")

    def partial(batches):
        pair, held = None, None

        def table():
            n = held.shape[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([pair[0]] * n, pa.int32()), pa.array([pair[1]] * n, pa.int32()), pa.array(range(n), pa.int32()),
                 pa.array(list(held), pa.list_(pa.float64()))], ["i", "j", "r", "v"])

        for batch in batches:
            i, j = (batch.column(c).to_numpy() for c in "ij")
            cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(i)]):
                if low == high:
                    continue
                a, b = (batch.column(c).slice(low, high - low).flatten().to_numpy(zero_copy_only=False).reshape(high - low, -1) for c in "ab")
                now = (int(i[low]), int(j[low]))
                if now != pair:
                    if pair is not None:
                        yield table()
                    pair, held = now, np.zeros((a.shape[1], b.shape[1]))
                held += a.T @ b
        if pair is not None:
            yield table()

    parts = dealt.mapInArrow(partial, "i int, j int, r int, v array<double>")
    cells = parts.select("i", "j", "r", F.posexplode("v").alias("s", "c")).groupBy("i", "j", "r", "s").agg(F.sum("c").alias("c"))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return cells.agg(F.sum(twice * F.col("c") * F.col("c")).alias("norm2"))


def _shrinkage(z: DataFrame, key: str, index: str) -> DataFrame:
    """One row ``lam`` from scaled residuals ``z`` of complete series.

    Sums over all pairs of series reduce to sums per date, except the norm of the
    correlation matrix; that one is taken over series or over dates, whichever are fewer.
    """
    size = z.agg(F.count_distinct(key).alias("m"), F.count_distinct(index).alias("t"), F.count("z").alias("n")).first()
    m, t = size["m"], size["t"]
    if size["n"] != m * t:
        short = z.groupBy(key).agg(F.count("z").alias("n")).filter(F.col("n") != t).limit(3).collect()
        raise ValueError(f"residual series must cover the same {t} steps; not so: {[r[0] for r in short]}")
    row, col, k = (index, key, m) if m <= t else (key, index, t)
    arrays = z.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct(col, "z"))), lambda s: s["z"]).alias("x"))
    z2 = F.col("z") * F.col("z")
    per = z.groupBy(index).agg(F.sum(z2).alias("s"), F.sum(z2 * z2).alias("q"), F.count_if(F.col("z") != 0).alias("__c"))
    square = per.agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("w2"))
    live = z.groupBy(key).agg(F.max(F.abs("z")).alias("a")).agg(F.count_if(F.col("a") > 0).alias("live"))
    one = _cross_norm(arrays, k).crossJoin(square).crossJoin(live)
    off = F.col("norm2") / (float(t) * t) - F.col("live")  # sum of r_ij^2 over i != j
    v = (F.col("w2") - t * off) / (float(t) * (t - 1))
    return one.select(F.when(off > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / off))).otherwise(1.0).alias("lam"))


def shrunk_weights(resid: DataFrame, key: str, index: str, e: str, total: str, shrink: float | None = None) -> DataFrame:
    """(key, weight): row sums W C' of the shrunk residual covariance against the constraint.

    ``resid`` holds complete residual series of every leaf and of the total, whose key is
    ``total``.  With c = total - sum of leaves, the plain covariances with c need one more
    series and no pairs.  The residuals are stored once, as each sum reads them.
    """
    resid = cut(resid.select(key, index, F.col(e).cast("double").alias(e)))
    scale = resid.groupBy(key).agg(F.sqrt(F.avg(F.col(e) * F.col(e))).alias("__sd"))
    rows = join_null_safe(resid.select(key, index, F.col(e).alias("d")), scale, [key])
    if shrink is None:
        z = rows.select(key, index, F.when(F.col("__sd") > 0, F.col("d") / F.col("__sd")).otherwise(0.0).alias("z"))
        lam = _shrinkage(z, key, index)
    else:
        lam = resid.sparkSession.range(1).select(F.lit(float(shrink)).alias("lam"))
    sign = F.when(F.col(key) == total, 1.0).otherwise(-1.0)
    c = rows.groupBy(index).agg(F.sum(sign * F.col("d")).alias("c"))
    own = rows.join(c, index).groupBy(key).agg(F.avg(F.col("d") * F.col("c")).alias("cov_c"), F.avg(F.col("d") * F.col("d")).alias("var"))
    # W = lam * diag + (1 - lam) * full, so W C' mixes the plain covariance with the signed variance
    return own.crossJoin(F.broadcast(lam)).select(
        key, ((1 - F.col("lam")) * F.col("cov_c") + F.col("lam") * sign * F.col("var")).alias("weight"), "lam")


def recon_mint(leaf: DataFrame, total: DataFrame, at: list[str], key: str, weights: DataFrame, total_key: str,
               mean: str = "mean") -> DataFrame:
    """Minimum-trace projection with the weights of :func:`shrunk_weights`; returns leaves and total."""
    sign = F.when(F.col(key) == total_key, 1.0).otherwise(-1.0)
    denom = weights.agg(F.sum(sign * F.col("weight")).alias("__den"))
    every = leaf.select(key, *at, mean).unionByName(total.select(F.lit(total_key).alias(key), *at, mean))
    rows = join_null_safe(every, weights.select(key, "weight"), [key]).crossJoin(F.broadcast(denom))
    steps = every.groupBy(*at).agg(F.sum(sign * F.col(mean)).alias("__gap"))
    rows = join_null_safe(rows, steps, at)
    return rows.select(key, *at, mean, (F.col(mean) - F.try_divide(F.col("weight"), F.col("__den")) * F.col("__gap")).alias("reconciled"))


def level_consistency(leaf: DataFrame, total: DataFrame, at: list[str], mean: str = "mean") -> DataFrame:
    """Total beside the sum of its parts."""
    return join_null_safe(total.select(*at, F.col(mean).alias("total")), bottom_up(leaf, at, mean).withColumnRenamed(mean, "children"), at
                          ).withColumn("gap", F.col("total") - F.col("children"))
