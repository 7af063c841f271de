"""Connected components of a table of links, without gathering a component anywhere.

Each round points every node at its smallest neighbour, follows the pointers to their ends, and contracts the links to those
ends; a star is done in one round, a chain of n in about log n. Tables that a later step joins are written to the shared folder
first, so both sides of each join are scans whose hot keys AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchmark.operators.lineage import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has a link; the label is one of the component's nodes. Null ends and loops are left out."""
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    edges = cut(links.filter(f"{a} is not null and {b} is not null and {a} <> {b}").select(lo, hi).distinct(), "links")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        points = cut(both.groupBy(F.col("lo").alias("node")).agg(F.least(F.min("hi"), F.first("lo")).alias("to")), "points")
        while True:
            ahead = points.select(F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = cut(points.join(ahead, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "jumps")
            points = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = points.select("node", F.col("to").alias("label"))
        else:
            moved = points.select(F.col("node").alias("label"), "to")
            labels = cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = points.select(F.col("node").alias("lo"), F.col("to").alias("x"))
        right = points.select(F.col("node").alias("hi"), F.col("to").alias("y"))
        merged = edges.join(left, "lo").join(right, "hi").filter("x <> y")
        edges = cut(merged.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("lo").alias("node"), F.col("hi").alias("label"))
    return labels
