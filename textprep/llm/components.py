"""Connected components by alternating large-star and small-star, on DataFrames.

A large-star step links every larger neighbour of a node to the least one around it; a small-star
step links a node and its smaller neighbours to the least of them. Both keep components as they are,
and in the end every node points at the least of its component. The steps use minima, which are
combined before they are shuffled, and joins, whose hot keys Spark can split: a node that is linked
to a third of all others is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textprep.llm.common import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u > v")  # the small star after it removes repeated edges


def small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v, so the neighbours at u are its smaller ones."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def fingerprint(edges: DataFrame) -> tuple:
    """Size and hash sum of an edge set; equal values mean that a step changed nothing."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed)).first())


def components(links: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """``node, component`` for every node of ``links`` (``u, v``), with the least node as component.

    Nodes may be of any ordered type. Each step's edges are written to the shared folder and the
    ones before are deleted, so lineage stays short and disk use bounded.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = scratch.save(edges.where("u > v").distinct(), f"{name}0")
    before, step = fingerprint(edges), 0
    while True:
        # A large star has as many edges as it was given, a small star one for each node more.
        large = scratch.save(large_star(edges), f"{name}{step}large", before[0])
        small = scratch.save(small_star(large), f"{name}{step + 1}", 2 * before[0])
        scratch.drop(f"{name}{step}", f"{name}{step}large")
        edges, step, after = small, step + 1, fingerprint(small)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
