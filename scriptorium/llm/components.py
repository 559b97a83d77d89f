"""Connected components of an edge table by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest neighbour,
small-star links a node's smaller neighbours to the smallest; both keep the
components and converge in few rounds whatever the diameter (Kiveris et al.,
2014).  Each step is one partial aggregate and one equi-join, so a node with a
third of all edges is pre-aggregated before the shuffle and its join is split by
adaptive execution.  Every round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialise


#: edges handled by one task: late rounds are small and need few tasks and files
EDGES_PER_TASK = 100_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .union(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge ``u``, ``v`` (bigint):
    component is the smallest node reachable.  Self-loops and repeated or reversed
    edges are harmless; nodes without an edge to another node do not appear; null
    ends are ignored; no edges give no rows."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # done when a round changes nothing
        r = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if tuple(r) == state or r["n"] == 0:
            break
        state, tasks = tuple(r), -(-r["n"] // EDGES_PER_TASK)
        now = materialise(_small_star(materialise(_large_star(now, tasks)), tasks))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
