"""Refined bins, exact quantiles and row numbers on awkward columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions import ordered


def awkward():
    rng = np.random.default_rng(11)
    parts = [rng.normal(0, 1, 4000), rng.normal(1e9, 1e-3, 4000), -np.exp(rng.normal(0, 30, 4000)), [0.0, -0.0, 1e300, -1e300, 5e-324, np.inf, -np.inf],
             np.full(3000, 42.0)]
    return np.concatenate(parts)


def jobs_of(spark, name, build):
    spark.sparkContext.setJobGroup(name, name)
    out = build()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setJobGroup("other", "other")
    return out


def test_coarse_bins_ascend(spark):
    values = np.unique(awkward())
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    bins = df.select("x", ordered.coarse_bin(F.col("x")).alias("b")).orderBy("x").toPandas()
    assert bins.b.is_monotonic_increasing and bins.b.nunique() > 1000


def test_quantiles_are_exact_and_lazy(spark):
    values = awkward()
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(values)) % 2, "x": values, "n": None, "w": 1.0 + np.arange(len(values)) % 3})
                               .astype({"n": float})).repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 0.999]
    found = jobs_of(spark, "quantiles", lambda: ordered.quantiles(df, ["x", "n"], probs, ["g"])).toPandas()
    assert len(found) == 14 and set(found.variable) == {"x"}
    for (g, p), q in found.set_index(["g", "prob"]).q.items():
        assert q == pytest.approx(np.quantile(values[g::2], p), rel=1e-12, nan_ok=True)
    cells = ordered.long_values(df, ["x"], [], F.col("w"))
    found = jobs_of(spark, "weighted", lambda: ordered.weighted_quantiles(cells, [], probs)).toPandas().set_index("prob").q
    order = np.argsort(values, kind="stable")
    total = np.cumsum((1.0 + np.arange(len(values)) % 3)[order])
    for p in probs:
        assert found[p] == values[order][np.searchsorted(total, max(p * total[-1], 5e-324))]


def test_one_value_in_nine_of_ten_rows(spark):
    df = spark.range(1_000_000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("double") ** 3).otherwise(7.0).alias("x"))
    found = ordered.quantiles(df, ["x"], [0.05, 0.5, 0.95]).toPandas().set_index("prob").q
    x = np.where(np.arange(1_000_000) % 10 == 0, np.arange(1_000_000.0) ** 3, 7.0)
    assert all(found[p] == pytest.approx(np.quantile(x, p), rel=1e-12) for p in (0.05, 0.5, 0.95))
    lines = df.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    sizes = jobs_of(spark, "chunks", lambda: ordered.with_chunks(lines, "x", "chunk", 50)).groupBy("chunk").count().toPandas()["count"]
    assert sizes.sum() == 100_001 and sizes.max() <= 2 * sizes.mean()


def test_chunks_and_row_numbers_of_crowded_values(spark):
    values = np.unique(np.concatenate([awkward(), 1e9 + np.arange(20000) * 1e-6]))
    df = spark.createDataFrame(pd.DataFrame({"x": values})).unionByName(spark.createDataFrame([(None,)], "x double")).repartition(4)
    chunks = ordered.with_chunks(df, "x", "c", 20).toPandas().sort_values("x")
    known = chunks.dropna(subset=["x"])
    assert chunks.c.isna().sum() == 1 and known.c.is_monotonic_increasing
    assert known.groupby("c").size().max() <= 2 * len(values) / 20
    numbers = jobs_of(spark, "rows", lambda: ordered.row_positions(df, "x")).toPandas().sort_values("row_id")
    assert numbers.row_id.tolist() == list(range(1, len(values) + 2)) and numbers.x.iloc[1:].is_monotonic_increasing and np.isnan(numbers.x.iloc[0])
    totals = ordered.running(df.dropna().withColumn("w", F.lit(1)), [], "x", sums=["w"], chunks=20).toPandas().sort_values("x")
    assert totals.cum_w.tolist() == list(range(1, len(values) + 1))
