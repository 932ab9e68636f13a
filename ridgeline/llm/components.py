"""Connected components as a distributed union-find: hook to the least neighbour, jump pointers, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, merged, save


def _edges(pairs: DataFrame) -> DataFrame:
    """Each undirected edge once, without loops."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of pairs (a, b, of one type that has an order) with another neighbour than itself; root is one node per component.

    Each round gives every node its least neighbour (or itself) as parent, flattens the trees by pointer jumping, and
    replaces edges by those between roots; every root that still has an edge joins another in the next round, so rounds are
    few. Every step is a join or a grouped minimum over tables in the shared folder: nothing is collected or broadcast, a node with very
    many edges is met by partial aggregates and by merge joins of plain scans, which Spark splits where they are skewed.
    """
    edges, flat = save(_edges(pairs), "cc-edges"), []
    first = True
    while first or not edges.isEmpty():
        first = False
        ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = edges.select(F.inline(ends))
        up = save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"), F.lit(True).alias("moved")), "cc-up")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            # two steps up a write, so that paths shrink to a third and few tables are written
            once = merged(up.select("node", "root"), above, "root").select("node", F.col("next").alias("root"))
            jumped = save(merged(once, above, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "cc-up")
            forget(up)
            up = jumped
            if up.where("moved").isEmpty():
                break
        flat.append(up.select("node", "root"))
        flat[-1]._ridgeline_path = up._ridgeline_path
        head = lambda name: up.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))  # noqa: E731, B023
        joined = merged(merged(edges, head("a"), "a"), head("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        contracted = save(_edges(joined), "cc-edges")
        forget(edges)
        edges = contracted
    forget(edges)
    if len(flat) == 1:
        return flat[0]
    found = flat[0]
    for later in flat[1:]:
        found = merged(found, later.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = save(found, "cc-roots")
    forget(*flat)
    return found
