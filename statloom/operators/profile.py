"""Shape, summaries and null counts of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.nulls import join_null_safe
from statloom.functions.ordered import quantiles_wide, row_positions


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "logical" if isinstance(data_type, T.BooleanType) else "character"


def table_shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, kind, with the table's row and column counts."""
    fields = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("variable"), F.lit(_kind(f.dataType)).alias("kind"))
        for i, f in enumerate(df.schema.fields, 1)])).alias("f")
    return (df.agg(F.count(F.lit(1)).alias("n_rows"))
            .select(fields, "n_rows", F.lit(len(df.columns)).alias("n_cols"))
            .select("f.*", "n_rows", "n_cols"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def character_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _per_column(df: DataFrame, cols: list[str], measures: dict) -> DataFrame:
    """One aggregate over the table, turned into a row per column."""
    one = df.agg(*[fn(F.col(c)).alias(f"{i}_{m}") for i, c in enumerate(cols) for m, fn in measures.items()])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{i}_{m}").alias(m) for m in measures])
        for i, c in enumerate(cols)])).alias("r")
    return one.select(rows).select("r.*")


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """min, quartiles, mean, max and number of nulls per numeric column."""
    cols = cols or numeric_columns(df)
    moments = _per_column(df, cols, {
        "min": lambda c: F.min(c.cast("double")), "mean": lambda c: F.avg(c.cast("double")),
        "max": lambda c: F.max(c.cast("double")), "n_missing": lambda c: F.count(F.lit(1)) - F.count(c)})
    middle = quantiles_wide(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(middle, "variable", "left")


def null_audit(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return _per_column(df, cols or df.columns, {"n_missing": lambda c: F.count(F.lit(1)) - F.count(c)})


def row_index(df: DataFrame, order: str | None = None, out: str = "row_id") -> DataFrame:
    """Row ids along ``order``; without an order they are unique but arbitrary."""
    if order is None:
        return df.withColumn(out, F.monotonically_increasing_id())
    return row_positions(df, order, out)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def count_distinct(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Number of non-null levels per column; the sketch variant needs no shuffle of levels."""
    if not exact:
        return _per_column(df, cols, {"n_levels": F.approx_count_distinct})
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])).alias("r"))
    return (long.select("r.*").filter(F.col("level").isNotNull()).distinct()
            .groupBy("variable").agg(F.count(F.lit(1)).alias("n_levels")))


def group_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Put two per-group result tables side by side."""
    return join_null_safe(left, right, keys)
