"""Connected components of an edge table by large-star and small-star rounds.

Nothing but a round's edge count and checksum reaches the driver; every round's
edges are written to the shared folder, so lineage stays short. A hub's edges
meet in joins on the hub that adaptive execution may split, and minima are
aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import materialise

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b), both long; component is the least id reachable."""
    current = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        current = materialise(_small_star(_large_star(current)), "edges")
        total = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(total) == seen:
            break
        seen = tuple(total)
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
