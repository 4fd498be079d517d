"""Connected components of an edge table as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    Alternating large-star and small-star rounds: each node links its larger neighbours, then its smaller
    ones, to the smallest node it knows. Both only ever move links towards the smallest node, so the edge
    table shrinks to one star per component. Every round aggregates by node with partial aggregation and is
    cut off with a reliable checkpoint. Self links give a node of its own; null ends are left out.
    """
    whole = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = whole.where("u = v").select(F.col("u").alias("node")).distinct()
    links = cut(whole.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = cut(small.where("u <> v").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)") * 3 + F.col("v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.join(found.select("node").union(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(roots).union(alone)
