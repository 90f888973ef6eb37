"""Projections, recodes and filters with the source analyses' null behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.nulls import member, not_member
from statloom.operators.profile import character_columns, numeric_columns


def by_position(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns by 1-based position."""
    return df.select(*[df.columns[i - 1] for i in positions])


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*(numeric_columns(df) if kind == "numeric" else character_columns(df)))


def first_column(df: DataFrame, name: str) -> DataFrame:
    return df.select(name, *[c for c in df.columns if c != name])


def select_listed(df: DataFrame, names: DataFrame, col: str) -> DataFrame:
    """Keep the columns named in another table, of any length; a name that is no column of ``df`` is an error."""
    asked = names.select(F.col(col).alias("name")).filter(F.col("name").isNotNull())
    unknown = asked.filter(~F.col("name").isin(*df.columns)).limit(5).collect()
    if unknown:
        raise ValueError(f"not columns: {sorted(r[0] for r in unknown)}")
    listed = {r[0] for r in asked.distinct().collect()}  # as many as df has columns at most
    return df.select(*[c for c in df.columns if c in listed])


def bin_ranges(x: Column, ranges: list[tuple]) -> Column:
    """First matching ``(low, low_closed, high, high_closed, label)``; gaps give null."""
    out = None
    for low, low_closed, high, high_closed, label in ranges:
        hit = (x >= low if low_closed else x > low) & (x <= high if high_closed else x < high)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def cap_counts(n: Column, cap: int, top: int) -> Column:
    """0..cap-1 stay, cap..top become cap, anything else is null."""
    return F.when((n >= 0) & (n < cap), n).when((n >= cap) & (n <= top), F.lit(cap))


def regroup(x: Column, groups: dict[str, list], rest: str | None = None) -> Column:
    """Merge levels by list, first list wins; other values pass through unless ``rest`` is given."""
    out = None
    for label, levels in groups.items():
        hit = member(x, levels)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(x if rest is None else F.when(x.isNotNull(), F.lit(rest)))


def recode_binary(x: Column, yes, if_yes=1, if_no=0) -> Column:
    return F.when(x == yes, F.lit(if_yes)).when(x.isNotNull(), F.lit(if_no))


def collapse(x: Column, level_map: dict) -> Column:
    """Many-to-one level map; values outside the map stay as they are."""
    table = F.create_map(*[F.lit(v) for pair in level_map.items() for v in pair])
    return F.coalesce(F.try_element_at(table, x), x)


def ordinal(x: Column, levels: list) -> Column:
    """1-based place in the level order; unknown level gives null."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), x)
    return F.when(place > 0, place.cast("int"))


def levels_of(df: DataFrame, col: str, reference=None) -> list:
    """Sorted levels with the reference level first: as many values as the result has columns or lines."""
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect()]
    found.sort()
    if reference is not None:
        if reference not in found:
            raise ValueError(f"{reference!r} is not a level of {col}")
        found.remove(reference)
        found.insert(0, reference)
    return found


def all_levels(df: DataFrame, cols: list[str]) -> dict[str, list]:
    """Levels of several columns in their own type and order, found in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    rows = df.select(cells.alias("r")).select("r.*").filter(F.col("v").isNotNull()).distinct()
    found = rows.collect()  # as many as the design has columns
    out = {c: [r["v"] for r in found if r["c"] == c] for c in cols}
    for c, values in out.items():
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        values.sort(key=float if numeric else None)
    return out


def design_columns(df: DataFrame, numeric: list[str], factors: dict[str, object] | list[str] = (),
                   intercept: bool = True) -> dict[str, Column]:
    """Treatment-coded design: name -> expression.  ``factors`` may map to reference levels."""
    refs = dict(factors) if isinstance(factors, dict) else {f: None for f in factors}
    cols: dict[str, Column] = {"(Intercept)": F.lit(1.0)} if intercept else {}
    cols.update({n: F.col(n).cast("double") for n in numeric})
    levels = all_levels(df, list(refs)) if refs else {}
    for factor, reference in refs.items():
        names, kind = levels[factor], df.schema[factor].dataType
        base = names[0] if reference is None else str(reference)
        if base not in names:
            raise ValueError(f"{reference!r} is not a level of {factor}")
        for level in names:
            if level != base:
                cols[f"{factor}{level}"] = (F.col(factor) == F.lit(level).cast(kind)).cast("double")
    return cols


def design_sums(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Column sums of a design, one row per design column."""
    names = list(cols)
    one = df.agg(*[F.sum(cols[n]).alias(f"s{i}") for i, n in enumerate(names)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("term"), F.col(f"s{i}").alias("total")) for i, n in enumerate(names)]))
    return one.select(rows.alias("r")).select("r.*")


def keep_in(df: DataFrame, col: str, values) -> DataFrame:
    return df.filter(member(F.col(col), values))


def keep_not_in(df: DataFrame, col: str, values) -> DataFrame:
    """Rows outside the set; rows with a null value stay."""
    return df.filter(not_member(F.col(col), values))


def with_constants(df: DataFrame, **aggs: Column) -> DataFrame:
    """Attach table-level aggregates to every row through a one-row broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggs.items()])))


def _new_year(df: DataFrame, col: str, year: int) -> Column:
    """1 January as a literal of the column's own type, so that the comparison reaches the file scan."""
    return F.lit(f"{year}-01-01").cast(df.schema[col].dataType)


def up_to_year(df: DataFrame, col: str, year: int) -> DataFrame:
    """Training part, written as a range so that files can be skipped."""
    return df.filter(F.col(col) < _new_year(df, col, year + 1))


def in_year(df: DataFrame, col: str, year: int) -> DataFrame:
    return df.filter((F.col(col) >= _new_year(df, col, year)) & (F.col(col) < _new_year(df, col, year + 1)))
