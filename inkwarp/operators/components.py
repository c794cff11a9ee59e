"""Connected components of an edge table by alternating large-star and small-star rounds.

Labels never leave the cluster. Every round is two aggregates with map-side combine and a join on the
node; the round's edges are written to the shared checkpoint folder, so lineage stays short. The number
of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarp.session import cut


def _least(pairs: DataFrame) -> DataFrame:
    """(node, least): the smallest of a node and its neighbours in ``pairs`` (u, v)."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of the component of every node of ``edges`` (a LONG, b LONG).

    Returns node LONG, component LONG; nodes that are their own component's smallest are left out.
    Self-loops and rows with a null end are ignored; an empty table gives an empty result.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs)
    state = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(low.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        pairs = cut(small)
        seen = pairs.agg(F.count(F.lit(1)), F.sum("u"), F.sum("v"), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
