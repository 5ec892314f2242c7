"""Scoring attributes, and the table as a whole, by the flags they take part in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raritas.operators.flags import members

SUMMARIES = {"mean": F.avg, "median": F.median}


def attribute_score(flagged: DataFrame, attrs: list[str], method: str) -> DataFrame:
    """(attr, name, score): flags of the attribute over ``N * (1 + (d - 1) ** 2)``.

    Members are counted per attribute before anything is shuffled; a mark per row counts the rows beside them.
    """
    d = len(attrs)
    marked = flagged.select(F.explode_outer(F.concat(F.array(F.lit(-1)), members(method))).alias("attr"))
    counts = marked.groupBy("attr").agg(F.count(F.lit(1)).alias("n"))
    # One row of at most d + 1 entries.
    whole = counts.agg(F.map_from_entries(F.collect_list(F.struct("attr", "n"))).alias("n"))
    lines = whole.select("n", F.posexplode(F.array(*map(F.lit, attrs))).alias("attr", "name"))
    rows = F.coalesce(F.try_element_at("n", F.lit(-1)), F.lit(0))
    flags = F.coalesce(F.try_element_at("n", F.col("attr")), F.lit(0))
    return lines.select("attr", "name", F.try_divide(flags, rows * (1 + (d - 1) ** 2)).alias("score"))


def table_score(scores: DataFrame, function: str = "mean", score: str = "score") -> DataFrame:
    """One row (function, table_score): mean or median over the attributes."""
    check_function(function)
    return scores.agg(F.lit(function).alias("function"), SUMMARIES[function](score).alias("table_score"))


def attributes_above(scores: DataFrame, th: float = 0.1, score: str = "score") -> DataFrame:
    return scores.where(F.col(score) > F.lit(1 - th))


def check_function(function: str) -> None:
    if function not in SUMMARIES:
        raise ValueError("the table score is a 'mean' or a 'median'")
