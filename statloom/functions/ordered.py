"""Running totals and exact quantiles that never put a whole group in one task.

Numbers are cut into bins by refining a histogram: first into equal steps of the logarithm, then each bin that is still
large into equal parts between its own smallest and largest value.  Running totals are accumulated over the bins and, inside a
bin, over its rows, so a key that holds a third of all rows is spread over its bins.  Quantiles look for the bin that holds a
wanted position, then for its part, and order only the values of that part.  All of it is one lazy plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.nulls import join_null_safe

STEPS = 1024  # bins of the first cut for each doubling
MIDDLE = 1_100_000  # moves the numbers of positive values above 0; the smallest double has -1074 * STEPS
FARTHEST = 10**8  # beyond all numbers: infinities and NaN
PARTS = 1 << 16  # parts of a large bin
FINE = 1 << 21  # parts of a bin that holds a wanted position; what is left holds at most as many different doubles


def coarse_bin(x: Column) -> Column:
    """Ascending whole number of a double, STEPS for each doubling on both sides of zero; NaN comes last, null stays null."""
    size = F.floor(F.log2(F.abs(x)) * STEPS).cast("long") + MIDDLE
    infinite = F.lit(float("inf"))
    return (F.when(F.isnan(x), F.lit(FARTHEST + 1)).when(x == infinite, F.lit(FARTHEST)).when(x == -infinite, F.lit(-FARTHEST))
            .when(x == 0, F.lit(0)).when(x > 0, size).when(x < 0, -size).cast("long"))


def part_of(x: Column, low: Column, high: Column, parts: int) -> Column:
    """Which of equal parts of the range from ``low`` to ``high``, both included, holds x; 0 in an empty range."""
    return F.when(low < high, F.least(F.floor((x - low) / (high - low) * parts), F.lit(parts - 1))).otherwise(F.lit(0)).cast("int")


def _numeric(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "date":
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double")


def with_chunks(df: DataFrame, order: str, out: str, chunks: int = 256) -> DataFrame:
    """Number the rows by chunks that ascend with ``order``, each with about a ``chunks``-th of the rows, wherever outliers lie.

    Bins over the limit are split between their own ends; neighbours then go together while they start below the next multiple of the
    limit, so a chunk holds less than a limit and one part, which is one value
    unless values crowd into a PARTS-th of their bin.  A null order has no chunk.
    """
    work = df.withColumn("__x", _numeric(df, order)).withColumn("__a", coarse_bin(F.col("__x")))
    levels = ["__a"]
    whole = Window.partitionBy(F.lit(0))

    def counted():
        sizes = work.filter(F.col("__x").isNotNull()).groupBy(*levels).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        return sizes.withColumn("__limit", F.greatest(F.sum("__n").over(whole) / chunks, F.lit(1.0)))

    # at most ``chunks`` bins are over the limit
    large = F.broadcast(counted().filter(F.col("__n") > F.col("__limit")).select("__a", "__lo", "__hi"))
    part = F.coalesce(part_of(F.col("__x"), F.col("__lo"), F.col("__hi"), PARTS), F.lit(0))
    work = work.join(large, "__a", "left").withColumn("__b", part).drop("__lo", "__hi")
    levels.append("__b")
    start = F.coalesce(F.sum("__n").over(whole.orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = counted().select(*levels, F.floor(start / F.col("__limit")).cast("int").alias(out))
    return work.join(named, levels, "left").drop("__x", *levels)


def running(df: DataFrame, keys: list[str], order: str, sums: list[str] = (),
            products: list[str] = (), reverse: bool = False, chunk: str | None = None,
            chunks: int = 256, inclusive: bool = True) -> DataFrame:
    """Running sums (``cum_*``) and products (``cumprod_*``) along ``order``, with or without the own row.

    ``df`` has one row per (keys, order).  ``chunk`` names an existing column that
    ascends with ``order``; without it the order is cut by ``with_chunks``.
    """
    own = chunk is None
    if own:
        chunk = "__chunk"
        df = with_chunks(df, order, chunk, chunks)
    totals = df.groupBy(*keys, chunk).agg(
        *[F.sum(c).alias(f"__s_{c}") for c in sums],
        *[F.product(c).alias(f"__p_{c}") for c in products])

    def along(name):
        return F.col(name).desc() if reverse else F.col(name).asc()

    before = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(along(chunk))
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *keys, chunk,
        *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__s_{c}") for c in sums],
        *[F.coalesce(F.product(f"__p_{c}").over(before), F.lit(1.0)).alias(f"__p_{c}") for c in products])
    inside = (Window.partitionBy(*keys, chunk).orderBy(along(order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    out = join_null_safe(df, offsets, [*keys, chunk]).withColumns({
        **{f"cum_{c}": F.col(f"__s_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums},
        **{f"cumprod_{c}": F.col(f"__p_{c}") * F.coalesce(F.product(c).over(inside), F.lit(1.0)) for c in products}})
    return out.drop(*[f"__s_{c}" for c in sums], *[f"__p_{c}" for c in products],
                    *([chunk] if own else []))


def long_values(df: DataFrame, cols: list[str], keys: list[str] = (), weight: Column | None = None) -> DataFrame:
    """Non-null cells (keys, variable, value, w) of the listed columns."""
    base = df.select(*keys, *cols, (F.lit(1) if weight is None else weight).alias("__w"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols]))
    return (base.select(*keys, "__w", cells.alias("__cell"))
            .select(*keys, "__cell.*", F.col("__w").alias("w")).filter(F.col("value").isNotNull()))


def _bins(values: DataFrame, groups: list[str], number: Column) -> DataFrame:
    return values.groupBy(*groups, number.alias("bin")).agg(
        F.sum("w").alias("bin_w"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _reached(bins: DataFrame, keys: list[str], labels: list[str], order: str, cum: Column, off: Column) -> DataFrame:
    """For each goal the first bin whose running weight reaches it, or the last one if rounding leaves the goal above the total."""
    hit = F.col("__cum") >= F.col("goal")
    first = F.min(F.struct(F.when(hit, 0).otherwise(1).alias("miss"), F.when(hit, F.col(order)).otherwise(-F.col(order)).alias("at"),
                           F.col("__off").alias("off"), "lo", "hi"))
    found = bins.withColumns({"__cum": cum, "__off": off}).groupBy(*keys, *labels).agg(F.max("goal").alias("goal"), first.alias("f"))
    return found.select(*keys, *labels, "goal", "f.off", "f.lo", "f.hi")


def _inside(values: DataFrame, goals: DataFrame, keys: list[str]) -> DataFrame:
    """Values between the limits of each goal's bin; without group keys there are as many goals as were asked for."""
    near = goals.withColumnsRenamed({k: f"__{k}" for k in keys})
    near = near if set(keys) - {"variable"} else F.broadcast(near)
    cond = reduce(lambda a, b: a & b, [values[k].eqNullSafe(near[f"__{k}"]) for k in keys], F.col("value").between(F.col("lo"), F.col("hi")))
    return values.join(near, cond).drop(*[f"__{k}" for k in keys])


def _select(values: DataFrame, keys: list[str], labels: list[str], goals_of) -> DataFrame:
    """(keys, labels, goal, q): the smallest value whose running weight reaches each goal.

    ``values`` has one row per (keys, value), so equal values weigh in once.  ``goals_of`` adds labels and goals to rows with
    keys and ``total_w``, one row for each goal.
    """
    def upto(groups, order):
        return Window.partitionBy(*(groups or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    bins = _bins(values, keys, coarse_bin(F.col("value"))).withColumns({
        "cum": F.sum("bin_w").over(upto(keys, "bin")),
        "total_w": F.sum("bin_w").over(Window.partitionBy(*(keys or [F.lit(0)])))})
    found = _reached(goals_of(bins), keys, labels, "bin", F.col("cum"), F.col("cum") - F.col("bin_w"))
    parts = _bins(_inside(values, found, keys).withColumnsRenamed({"lo": "__lo", "hi": "__hi"}), [*keys, *labels, "goal", "off"],
                  part_of(F.col("value"), F.col("__lo"), F.col("__hi"), FINE))
    cum = F.col("off") + F.sum("bin_w").over(upto([*keys, *labels], "bin"))
    found = _reached(parts, keys, labels, "bin", cum, cum - F.col("bin_w"))
    last = F.col("off") + F.sum("w").over(upto([*keys, *labels], "value"))
    rows = _inside(values, found, keys).withColumn("cum", last)
    return rows.groupBy(*keys, *labels).agg(F.max("goal").alias("goal"), F.coalesce(
        F.min(F.when(F.col("cum") >= F.col("goal"), F.col("value"))), F.max("value")).alias("q"))


def quantiles(df: DataFrame, cols: list[str], probs: list[float], keys: list[str] = ()) -> DataFrame:
    """Exact interpolated quantiles (position ``(n-1)p``): (keys, variable, prob, q)."""
    groups = [*keys, "variable"]

    def goals_of(totals):
        pos = (F.col("total_w") - 1) * F.col("prob")
        each = totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(probs))])))
        places = F.array_distinct(F.array(F.floor(pos) + 1, F.ceil(pos) + 1))
        return each.withColumns({"frac": pos - F.floor(pos), "place": F.explode(places)}).withColumn("goal", F.col("place"))

    values = long_values(df, cols, keys).groupBy(*groups, "value").agg(F.sum("w").alias("w"))
    found = _select(values, groups, ["prob", "frac", "place"], goals_of)
    low, high = F.min("q"), F.max("q")
    return found.groupBy(*groups, "prob").agg((low + F.max("frac") * (high - low)).alias("q"))


def weighted_quantiles(cells: DataFrame, keys: list[str], probs) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``prob`` of the total: (keys, prob, ..., q).

    ``cells`` comes from :func:`long_values`; ``probs`` is a list, or a table that
    holds ``prob`` (and label columns) per key.
    """
    table = isinstance(probs, DataFrame)
    labels = [c for c in probs.columns if c not in keys] if table else ["prob"]

    def goals_of(totals):
        if table:
            on = [k for k in keys if k in probs.columns]
            each = join_null_safe(totals, probs, on) if on else totals.crossJoin(probs)
        else:
            each = totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        return each.withColumn("goal", F.greatest(F.col("prob") * F.col("total_w"), F.lit(5e-324)))

    values = cells.groupBy(*keys, "value").agg(F.sum("w").alias("w"))
    return _select(values, list(keys), labels, goals_of).drop("goal")


def quantiles_wide(df: DataFrame, cols: list[str], named_probs: dict[str, float],
                   keys: list[str] = ()) -> DataFrame:
    """One row per (keys, variable) with a column per named probability."""
    long = quantiles(df, cols, sorted(set(named_probs.values())), keys)
    return long.groupBy(*keys, "variable").agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("q"))).alias(n) for n, p in named_probs.items()])


def row_positions(df: DataFrame, order: str, out: str = "row_id", chunks: int = 256) -> DataFrame:
    """1-based row numbers along a unique numeric column, without a one-task sort; a null order comes first."""
    binned = with_chunks(df, order, "__bin", chunks)
    sizes = binned.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(F.lit(0)).orderBy("__bin")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__bin").orderBy(order)
    return (join_null_safe(binned, F.broadcast(offsets), ["__bin"])  # at most chunks + 2 lines
            .withColumn(out, F.col("__off") + F.row_number().over(inside)).drop("__bin", "__off"))
