"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the vertex; nothing is collected
to the driver. The minimum pre-aggregates before its shuffle and the join's
other side holds a row a vertex, so that adaptive execution can split a hub.
Edges are written to the shared folder after each round: lineage stays short
and lost executors only cost the round at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import materialize

EDGES_A_FILE = 100_000


def _turn(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    least = least.select("w", F.least("w", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").distinct()
    first = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    small = large.join(first, F.col("u") == F.col("w"))
    small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").where("u > v").distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """(id, component) for every vertex in ``links`` that is not its own
    component's smallest vertex. Vertices are non-null longs; other vertices
    are their own component. Links may repeat and go either way. A round's
    table has a file for each ``EDGES_A_FILE`` edges of the round before."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialize(edges, "edges")
    mark = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not now[0] or now == mark:  # nothing moves any more
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = now
        edges = materialize(_turn(edges).coalesce(-(-now[0] // EDGES_A_FILE)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
