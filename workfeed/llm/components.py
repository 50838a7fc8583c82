"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions


def connected_components(edges: DataFrame, left: str, right: str, each: int = 50_000) -> DataFrame:
    """(node, component): for every node of edges the smallest node it reaches.

    Alternates the large-star and small-star steps, which keep each node's
    neighbours attached to a smaller one and halve the distances, until the edge
    set stands still. A node's smallest neighbour is found by a pre-aggregated
    minimum, which is written and joined back, so that a node with very many
    neighbours is split where it is joined. Null ends and self links are no edges; an
    empty table gives an empty result. Edges are kept in as few partitions as their
    number needs, `each` in one, whatever number the session's shuffles have: a round is a
    dozen of them, and for a small graph their tasks and files would be most of the work.
    """
    now = checkpoint(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    )
    before = None
    while True:
        state = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
        parts = partitions(state.n, each)
        now = checkpoint(_small_star(_large_star(now.coalesce(parts), parts), parts).coalesce(parts))
    ends = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    roots = ends.select(F.col("component").alias("node"), "component")
    return ends.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _with_least(edges: DataFrame, parts: int) -> DataFrame:
    """edges with m, the smallest neighbour of u."""
    return edges.join(checkpoint(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)), "u")


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, parts).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest of them; edges have v < u."""
    ends = F.explode(F.array("u", "v")).alias("u")
    return _with_least(checkpoint(edges.coalesce(parts)), parts).select(ends, F.col("m").alias("v")).where("u <> v").distinct()
