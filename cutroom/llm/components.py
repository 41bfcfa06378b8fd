"""Connected components of an edge table, by hash-min with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, near, tally


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round every node takes the smallest label around it and then its label's label, so chains shrink by half at
    least. Labels are combined before the shuffle; nothing but a count reaches the driver.
    """
    both = tally(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct())
    labels = tally(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        known = near(labels)
        around = both.join(known.select(F.col("u").alias("v"), F.col("label").alias("far")), "v").groupBy("u").agg(F.min("far").alias("far"))
        low = around.join(known, "u").select("u", F.col("label").alias("old"), F.least("label", "far").alias("label"))
        jump = low.join(known.select(F.col("u").alias("label"), F.col("label").alias("next")), "label", "left")
        labels = tally(jump.select("u", "old", F.least("label", F.coalesce("next", "label")).alias("label")), changed=F.count_if(F.col("label") != F.col("old")))
        if not counted(labels, "changed"):
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def merged(comps: DataFrame, later: DataFrame) -> DataFrame:
    """(component, whole): what components of tallied ``comps`` (node, component) become through later edges (a, b), for those that change.

    A node that ``comps`` doesn't have is a component of its own. Only edges between different components count, so what is known
    isn't walked through again.
    """
    known, rows = near(comps), later
    for side in ("a", "b"):
        own = known.select(F.col("node").alias(side), F.col("component").alias("c"))
        rows = rows.join(own, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    return components(rows.where("a <> b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("whole"))
