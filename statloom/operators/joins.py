"""Enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.nulls import join_null_safe


def left_chain(fact: DataFrame, lookups: list[tuple]) -> DataFrame:
    """Left-join pruned tables one after another.

    Each lookup is ``(table, columns, [(fact_key, table_key), ...])``.  A null key
    matches a null key.  Broadcast or sort-merge is left to the optimizer's size
    estimates, and hot keys of a sort-merge join to its skew splitting.
    """
    for table, columns, keys in lookups:
        right_keys = [k if isinstance(k, str) else k[1] for k in keys]
        pruned = table.select(*dict.fromkeys([*right_keys, *columns]))
        keep = [c for c in columns if c not in right_keys]
        again = {c: f"__v_{c}" for c in keep}
        fact = (join_null_safe(fact, pruned.withColumnsRenamed(again), keys, "left")
                .withColumnsRenamed({v: k for k, v in again.items()}))
    return fact


def salted_lookup(fact: DataFrame, dim: DataFrame, key: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Lookup for a dimension too large to broadcast when one key holds much of the fact table.

    Fact rows of a key spread over ``salts`` partitions; each dimension row is repeated that often.
    """
    spread = fact.withColumn("__salt", F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int"))
    copies = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_null_safe(spread, copies, [key, "__salt"], how).drop("__salt")


def cross_grid(spark, **values: list) -> DataFrame:
    """Cross product of parameter values."""
    grid = None
    for name, items in values.items():
        column = spark.createDataFrame([(v,) for v in items], [name])
        grid = column if grid is None else grid.crossJoin(column)
    return grid
