"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import cut

MOST_ROUNDS = 100


def _star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node, or the node itself, on its smallest neighbour.

    ``edges`` (u, v) holds, for each u, the neighbours that count. The smallest one is found by a partial
    aggregate and joined back, so a hub with very many links is no single task.
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), 64-bit numbers. Returns (node, root): the smallest node reachable, for every node in a link.

    Each round is written to the shared checkpoint folder. Null ends and links of a node to itself are left out.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large.where("u <> v"))
        hung = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut(hung.where("u <> v").distinct())
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
