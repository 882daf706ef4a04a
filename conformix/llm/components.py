"""Connected components of an edge list, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs


def components(edges: DataFrame) -> DataFrame:
    """(id, group): group is the lowest id connected to id. Edges: columns a and b, longs.

    Only ids in some edge are listed. Each round takes the least label among the
    neighbours and that label's own label, so rounds grow with the logarithm of
    the longest chain; lineage is cut by reliable checkpoints.
    """
    both = jobs.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = jobs.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("group")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("seen"))
        jump = label.select(F.col("id").alias("group"), F.col("group").alias("over"))
        new = label.join(near, label["id"] == near["a"]).join(jump, "group", "left")
        least = F.least("group", "seen", "over")
        new = jobs.cut(new.select("id", least.alias("group"), (least < F.col("group")).alias("moved")))
        if not new.where("moved").head(1):
            return new.select("id", "group")
        label = new.select("id", "group")
