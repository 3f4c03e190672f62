"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.scratch import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the least node of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (u, v); the component is its least node.

    Loops and repeated edges do no harm; rows with a null end are left out; no edges give no rows. Least
    neighbours are pre-aggregated, and each round of two star steps is written to the shared folder. The
    number of rounds grows with the logarithm of the nodes.
    """
    clean = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now, before = staged(clean.distinct()), None
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).alias("mark")
    while True:
        state = now.agg(mark).first().mark
        if state == before or not state[0]:
            break
        before = state
        now = staged(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
