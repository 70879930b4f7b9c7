"""Connected components of edges that are rows, by rounds of hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import stored


def _flat(parents: DataFrame) -> DataFrame:
    """``parents`` (node, up) with every node pointing at the root above it; each step halves the depth."""
    while True:
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumped = stored(
            parents.join(above, "up", "left").select(
                "node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")
            ),
            "jump",
        )
        parents = jumped.select("node", "up")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node reachable.

    In each round every node with a smaller neighbour hooks onto its smallest one, the trees are flattened, and the
    edges between different roots go to the next round; the number of roots falls at least by half each time.
    """
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stored(edges.where("a <> b").select(*pair).distinct(), "edges")
    found = stored(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "nodes")
    while not left.isEmpty():
        roots = _flat(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        low, high = roots.toDF("a", "low"), roots.toDF("b", "high")
        moved = left.join(low, "a", "left").join(high, "b", "left")
        moved = moved.select(F.coalesce("low", "a").alias("a"), F.coalesce("high", "b").alias("b"))
        left = stored(moved.where("a <> b").select(*pair).distinct(), "edges")
        found = stored(
            found.join(roots.toDF("component", "root"), "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            ),
            "nodes",
        )
    return found
