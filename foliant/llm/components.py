"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with a neighbour; root is the smallest node reached.

    ``edges`` has the columns ``a`` and ``b``; order, repeats and loops do not matter, null
    ends are left out. Each round points every neighbour above a node at the node's least
    neighbour, and then every neighbour below it; stars remain when nothing changes. A node
    with very many links is handled by partial minima and by joins that Spark can split.
    The only thing the driver sees is a count and a check sum.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(b.alias("node")).distinct()
    return now.select(a.alias("node"), b.alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
