"""Connected components of a graph in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raritas.functions.runtime import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Each node tells its larger neighbours (large), or its smaller ones and itself (small), the least node
    that it knows. Nodes with many neighbours are combined before the shuffle; the join back to them may be split."""
    if large:
        pairs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    joined = pairs.join(least, F.col("a") == F.col("c"))
    if large:
        told = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        told = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return told.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (a, m): each node of an edge (columns a, b of one type) with the least node of its component.

    Loops and repeated edges do no harm; a component's least node is a row of its own; no edges give no rows.
    """
    edges = cut_lineage(edges.where("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(rounds):
        edges = cut_lineage(_star(_star(edges, True), False))
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen["n"] == 0 or (before is not None and tuple(seen) == before):
            break
        before = tuple(seen)
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("a")).distinct()
    return edges.select("a", F.col("b").alias("m")).union(roots.select("a", F.col("a").alias("m")))
