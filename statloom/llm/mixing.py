"""Interleave sources to target weights: Pfair releases and deadlines, earliest deadline first.  DataFrame functions only."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 1000  # weights are whole parts of about this many
BLOCK = 100_000  # characters in a block
OUTPUT = ["mix_block", "mix_slot", "mix_place"]
LONGEST = 10_000  # given weights whose smallest whole parts add up to this at most are kept exactly


def _whole(weights: dict[str, float], parts: int) -> tuple[dict[str, int], bool]:
    """Given weights as whole numbers, and whether these are the parts themselves: 0.5, 0.3, 0.2 are exactly 5, 3, 2 parts."""
    ratios = {k: Fraction(str(v)) for k, v in weights.items() if v > 0}
    scale = math.lcm(*(r.denominator for r in ratios.values()))
    whole = {k: int(r * scale) for k, r in ratios.items()}
    common = math.gcd(*whole.values()) or 1
    whole = {k: v // common for k, v in whole.items()}
    if sum(whole.values()) <= max(LONGEST, parts):
        return whole, True
    every = sum(ratios.values())
    return {k: max(1, round(r / every * 10**12)) for k, r in ratios.items()}, False


def _shares(totals: DataFrame, parts: int | None) -> DataFrame:
    """One row: ``lanes``, a list of (lane, parts) as long as there are sources, and ``period``, the sum of the parts.

    Without ``parts`` the weights are the parts.
    """
    one = totals.agg(F.array_sort(F.collect_list(F.struct("lane", "weight", "least"))).alias("lanes"), F.sum("weight").alias("every"))
    share = lambda x: x["weight"] if parts is None else F.greatest(
        F.floor(parts * x["weight"] / F.greatest(F.col("every"), F.lit(1))), x["least"]).cast("long")
    one = one.select(F.transform("lanes", lambda x: F.struct(x["lane"].alias("lane"), share(x).alias("parts"))).alias("lanes"))
    return one.withColumn("period", F.aggregate("lanes", F.lit(0).cast("long"), lambda n, x: n + x["parts"]))


def _schedule(one: DataFrame) -> DataFrame:
    """(lane, turn, slot, parts, period) for one period, from the row of ``_shares``.

    In a period of Q slots a source with a parts gets a blocks.  Its k-th block may run from slot floor(k Q / a) and must
    run before ceil((k + 1) Q / a).  Each slot takes the released block with the earliest deadline, ties by source name,
    which meets every deadline, so at any slot a source is less than one block off its weight.  The table holds Q rows.

    Blocks are listed under the slot that releases them; the fold over the slots carries those that wait, two a source at most.
    """
    whole = lambda a, b: F.floor(a / b).cast("long")
    lanes = one.filter("period > 0").select("period", F.posexplode("lanes").alias("i", "lane"))
    blocks = lanes.filter("lane.parts > 0").select("period", "i", F.col("lane.parts").alias("a"), F.explode(F.expr("sequence(0L, lane.parts - 1)")).alias("k"))
    due = whole((F.col("k") + 1) * F.col("period") + F.col("a") - 1, F.col("a"))
    released = blocks.groupBy(whole(F.col("k") * F.col("period"), F.col("a")).alias("slot")).agg(
        F.collect_list(F.struct(due.alias("due"), "i", "k")).alias("new"))
    kind = "array<struct<due:bigint,i:int,k:bigint>>"
    slots = one.filter("period > 0").select(F.explode(F.expr("sequence(0L, period - 1)")).alias("slot")).join(released, "slot", "left")
    line = slots.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("new", F.expr(f"cast(array() as {kind})")).alias("new")))).alias("slots"))

    def step(state: Column, slot: Column) -> Column:
        ready = F.concat(state["ready"], slot["new"])
        first = F.array_min(ready)
        return F.struct(F.array_except(ready, F.array(first)).alias("ready"),
                        F.concat(state["out"], F.array(F.struct(first.alias("block"), slot["slot"].alias("t")))).alias("out"))

    start = F.struct(F.expr(f"cast(array() as {kind})").alias("ready"), F.expr("cast(array() as array<struct<block:struct<due:bigint,i:int,k:bigint>,t:bigint>>)").alias("out"))
    rows = line.select(F.explode(F.aggregate("slots", start, step, lambda s: s["out"])).alias("s"))
    names = lanes.select("period", "i", F.col("lane.lane").alias("lane"), F.col("lane.parts").alias("parts"))
    return rows.join(names, F.col("s.block.i") == F.col("i")).select(
        "lane", F.col("s.block.k").alias("turn"), F.col("s.t").alias("slot"), "parts", "period")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
                size: Column | None = None, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Every row with ``mix_slot`` (when its block runs), ``mix_block`` (number inside its source) and ``mix_place``
    (where in the source's character stream it starts).  Order by (mix_slot, mix_place) to read the mixture.

    A source is its documents in the order of md5(id); its k-th block holds the rows that start in characters
    [k * block, (k + 1) * block).  ``weights`` names target weights; a source that is not named, or has a weight of 0 or less, takes no part: its rows
    are kept with a null ``mix_slot``.  Given weights are kept exactly if their smallest whole parts add up to ``LONGEST`` (or ``parts``)
    at most.  Other weights, and the square roots of the sources' sizes that stand for missing ones, are rounded down to
    whole parts of about ``parts``, one at least.  When a source has run out, the others go on in their own slots.
    The schedule of one period is repeated, so it is as small as the parts and sources whatever the data hold.

    A null source is a source of its own, a null or empty text has size 0, rows that repeat an id keep their place beside
    each other, and input columns named like an output column are replaced.  Running sizes are summed in 65536 bins
    of the id hash for each source, so no source is sorted in one task.
    """
    inputs = [c for c in docs.columns if c not in OUTPUT]
    amount = F.coalesce(F.length("text") if size is None else size, F.lit(0)).cast("long")
    work = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(inputs)],
                       F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("lane"),
                       F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("mark"), amount.alias("size"))
    work = work.withColumn("bin", F.substring("mark", 1, 4))
    bins = work.groupBy("lane", "bin").agg(F.sum("size").alias("chars"))
    before = Window.partitionBy("lane").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("lane", "bin", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("ahead"))
    totals = bins.groupBy("lane").agg(F.sum("chars").alias("chars"))
    exact = False
    if weights is None:
        totals = totals.withColumns({"weight": F.floor(F.sqrt("chars")).cast("long"), "least": F.lit(1)})
    else:
        whole, exact = _whole(weights, parts)
        given = F.create_map(*[x for k, v in sorted(whole.items()) for x in (F.lit("=" + k), F.lit(v).cast("long"))]) \
            if whole else F.create_map().cast("map<string,bigint>")
        totals = totals.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("lane")), F.lit(0)).cast("long"))
        totals = totals.withColumn("least", (F.col("weight") > 0).cast("int"))
    shares = _shares(totals, None if exact else parts)
    inside = Window.partitionBy("lane", "bin").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = work.join(starts, ["lane", "bin"]).withColumn(
        "place", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.withColumn("block", F.floor(F.col("place") / block).cast("long"))
    quota = shares.select(F.inline("lanes")).withColumnRenamed("parts", "quota")
    timed = placed.join(quota, "lane").withColumn("turn", F.pmod("block", F.nullif("quota", F.lit(0)))).join(_schedule(shares), ["lane", "turn"], "left")
    slot = F.floor(F.try_divide("block", "quota")).cast("long") * F.col("period") + F.col("slot")
    return timed.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(inputs)], F.col("block").alias("mix_block"),
                        slot.alias("mix_slot"), F.col("place").alias("mix_place"))
