"""Connected components of an edge table, by alternating large and small stars.

Every step joins an edge table with the least neighbour of each node (partly
aggregated before the shuffle, the join left to adaptive skew handling), so a node
with a third of all edges is no single task's work. Edges are written to the
shared folder after each round; nothing but a count and a checksum comes back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm import scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v): the least node it reaches."""
    rows = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    rows = scratch.table(rows, "edges")
    before = None
    while True:
        at = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if at["n"] == 0 or at == before:
            break
        before = at
        rows = scratch.table(_small(_large(rows)), "edges")
    roots = rows.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
