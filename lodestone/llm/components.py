"""Connected components of a link table, by large-star and small-star rounds.

A table of few links is worked through by one task, instead of some twenty
jobs; beyond that size it goes by rounds. Both give the same. Every round sends each node's neighbours to its smallest neighbour; the number
of rounds grows with the logarithm of the largest component's size. All steps
are joins and aggregations of (node, node) rows, and each result is a stored
table, so that hubs are split by skew joins and nothing is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, stored


#: Links (16 bytes each) that one task takes at once, at most.
FEW_LINKS = 100_000


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to (node, component), by union and find with halved paths."""
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(a) for a in nodes], pa.int64())], names=["node", "component"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); component is the smallest node reached.

    Links of a node to itself and repeated links do no harm; nulls are left out.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= FEW_LINKS:
        out = stored(edges.coalesce(1).mapInArrow(_labelled, "node long, component long"))
        discard(edges)
        return out
    while not _is_forest_of_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        discard(edges, low)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(large, low)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots))
    discard(edges)
    return out


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Each larger end has one link only, and is nobody's smaller end."""
    ends = edges.groupBy("u").agg(F.count("*").alias("n"))
    many = ends.where("n > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).distinct().join(ends.select("u"), "u")
    return many.union(inner).isEmpty()
