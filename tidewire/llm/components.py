"""Connected components by alternating large and small stars, as grouped aggregations and joins.

Every round replaces links by links to the smallest known neighbour; a hot centre is a key of a
join whose rows the engine can split, never a list in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import apart, checkpointed, files_for


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = apart(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = apart(down.groupBy("a").agg(F.min("b").alias("m")))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node with a link; root is the smallest node of its component.

    edges has two columns of node numbers; direction and repeats do not matter.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == before or not state[0]:
            break
        before = state
        # Each star reads its input several times, so every one is cut off: plans stay small.
        files = files_for(state[0])
        now = checkpointed(small_star(checkpointed(large_star(now), files)), files)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
