"""Connected components of an edge table by alternating large and small stars.

Edges stay a distributed table throughout; every round is written to the shared folder, so
the lineage is one round deep and no labels reach the driver, which sees two sums per round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, renamed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, root for every node of an edge; ``root`` is the smallest node reachable.

    ``edges`` has long columns u and v; loops, nulls and repeated edges do no harm.
    """
    start = edges.filter("u is not null and v is not null and u <> v")
    start = start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(start, "edges"), None
    for _ in range(limit):
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        last, before, now = now, state, materialize(_small_star(_large_star(now)), "edges")
        discard(last)
    else:
        raise RuntimeError("components did not settle")
    return renamed(now, u="node", v="root")
