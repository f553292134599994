"""Connected components by contraction; no vertex's neighbours ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label) of every node that has an edge; label: the component's smallest node.

    Each round, every node points to its smallest neighbour if that is smaller, pointers are followed one step further, and
    edges are drawn between what their ends point to. Tables of a round are written before the next, so a round's joins
    are of two plain tables and a node with many edges is split between tasks.
    """
    edges = common.stash(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v").distinct(), "edges")
    labels = None
    while True:
        old = [edges, labels] if labels is not None else [edges]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = common.stash(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to")), "pointers")
        further = near.join(near.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
        point = common.stash(further.select("node", F.coalesce("next", "to").alias("to")), "pointers")
        if labels is None:
            labels, kept = point.select("node", F.col("to").alias("label")), [near]
        else:
            moved = labels.join(point.select(F.col("node").alias("label"), "to"), "label", "left")
            labels, kept = common.stash(moved.select("node", F.coalesce("to", "label").alias("label")), "labels"), [near, point]
        half = common.stash(edges.join(point.select(F.col("node").alias("u"), F.col("to").alias("x")), "u").select("x", "v"), "edges")
        edges = common.stash(half.join(point.select(F.col("node").alias("v"), F.col("to").alias("y")), "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        common.discard(half, *old, *kept)
        if edges.isEmpty():
            return labels


def extended(found: DataFrame, edges: DataFrame) -> DataFrame:
    """What components() gives for the edges that `found` came from and more edges (a, b)."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    new = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = found.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    out = moved.select("node", F.coalesce("to", "label").alias("label")).unionByName(new.join(found.select("node"), "node", "left_anti"))
    return common.stash(out, "labels")
