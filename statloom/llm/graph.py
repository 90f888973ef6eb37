"""Connected components of a link table, without gathering links or groups anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.store import keep, settled


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``node -> label`` pointers to their ends; the path halves with every join."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = keep(parents.join(up, "label", "left").select(
            "node", F.coalesce("above", "label").alias("label"), (F.col("above") != F.col("label")).alias("moved")), "roots")
        parents = jumped.select("node", "label")
        if jumped.filter("moved").isEmpty():
            return parents


@settled
def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; the label is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the pointers and contracts the links, which at least
    halves the groups.  Only unique tables stand on one side of the joins, so a hub with a third of all links is split.
    """
    spark = links.sparkSession
    edges = keep(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hooked = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"))
        step = _roots(keep(hooked, "hooks"))
        if labels is None:
            labels = step
        else:
            onto = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = keep(labels.join(onto, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("label").alias("to")), end).withColumn(end, F.col("to")).drop("to")
        edges = keep(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if labels is None:
        kind = links.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, label {kind}")
    return labels
