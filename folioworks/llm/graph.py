"""Connected components of a distributed edge list, by alternating large and small stars.

A node with very many neighbours is no task's own: the large star looks for the least neighbour per node and salt, then per
node, and carries it back to the rows by node and salt, so a hub's edges stay spread over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import Scratch

#: Tasks over which a hub's edges are spread.
SALTS = 32


def with_least(rows: DataFrame) -> DataFrame:
    """rows (u, v) with m, the least v of their u."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    partial = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = partial.groupBy("u").agg(F.min("m").alias("m"))
    # A node has SALTS rows here at most.
    carried = partial.select("u", "salt").join(least, "u")
    return salted.join(carried, ["u", "salt"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point at the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point at the least of them. Rows meet at the larger node, and after a large star
    that is no hub: a hub is the least node of its edges."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (the least node) of all nodes of links (u, v) but the least ones themselves.

    Each round is written to the scratch folder, so lineage stays short; the number of rounds grows with the logarithm
    of the longest path.
    """
    edges = scratch.hold(links.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        edges = scratch.hold(_small(_large(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
