"""Ranking rows by how often their values take part in anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raritas.functions.runtime import cut_lineage
from raritas.operators.flags import calm_rows, flagged_cells
from raritas.plans.joins import join_by_counted_key


def value_participation(cells: DataFrame) -> DataFrame:
    """(attr, value, in_anomalies, rows): flags the value takes part in, over all rows that hold it."""
    return cells.groupBy("attr", "value").agg(F.sum("part").alias("in_anomalies"), F.count(F.lit(1)).alias("rows"))


def count_anomalies(
    flagged: DataFrame, key: str, attrs: list[str], method: str, compat: bool = False
) -> DataFrame:
    """(key, Ranking_count): for each flag of the row and each member, the participation of the member's value.

    Summing over flags first, a row's score is the sum over its anomalous attributes of own flags times value
    participation: one aggregation by value, one join back. A value shared by very many rows is a single
    aggregated row. Rows without flags never enter the join; they get their zero where they stand.
    """
    cells = cut_lineage(flagged_cells(flagged, key, attrs, method, compat))
    joined = join_by_counted_key(cells, value_participation(cells), ["attr", "value"], "rows")
    scored = joined.groupBy(key).agg(F.sum(F.col("weight") * F.col("in_anomalies")).cast("bigint").alias("Ranking_count"))
    calm = calm_rows(flagged, key, method).withColumn("Ranking_count", F.lit(0).cast("bigint"))
    return scored.unionByName(calm)


def cutoff(scores: DataFrame, score: str, th: float = 0.1) -> DataFrame:
    """Rows strictly above ``(1 - th) * (max - min) + min``; none if all scores are equal."""
    edge = scores.agg(
        (F.lit(1 - th) * (F.max(score) - F.min(score)) + F.min(score)).alias("edge")
    )
    return scores.where(F.col(score) > edge.scalar())


def cutoff_share(scores: DataFrame, score: str, th: float = 0.1) -> DataFrame:
    """One row: how many rows pass the cutoff, out of how many, and their share."""
    edge = scores.agg((F.lit(1 - th) * (F.max(score) - F.min(score)) + F.min(score)).alias("edge"))
    counted = scores.agg(
        F.count_if(F.col(score) > edge.scalar()).alias("selected"),
        F.count(F.lit(1)).alias("rows"),
    )
    return counted.withColumn("share", F.try_divide("selected", "rows"))
