"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links over long nodes -> (node, root): root is the smallest node reachable. Nodes without a link are left out.

    Each round points every node at its smallest neighbour (never at a larger one, so there is no cycle),
    doubles the pointers until all end at nodes without one, and rewrites the links between these. They are
    the least of their neighbourhoods, half of the nodes at most, so rounds and doublings each grow with a
    logarithm. Links are kept distinct; hubs are met by partial aggregation and by skew joins, never by lists.
    """
    links = materialise(_oriented(edges.select("a", "b")), "links")
    maps: list[DataFrame] = []
    while links.limit(1).count():
        up = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        moving = True
        while moving:
            nxt = up.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            step = materialise(up.join(nxt, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "pointers")
            moving = bool(step.where("moved").limit(1).count())
            up = step.select("node", "to")
        maps.append(up)
        for end in ("a", "b"):
            links = links.join(up.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = materialise(_oriented(links), "links")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        # a node of an earlier round keeps pointing at the end of its chain; nodes that only a later round moves are among the earlier ends
        ends = later.select("node", "to")
        moved = out.join(step, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
        out = moved.unionByName(ends.join(out.select("node"), "node", "left_anti"))
    roots = out.select(F.col("to").alias("node"), F.col("to").alias("root")).distinct()
    return out.select("node", F.col("to").alias("root")).unionByName(roots.join(out.select("node"), "node", "left_anti"))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
