"""Equi-join against a key table whose row counts per key are known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raritas.functions import runtime
from raritas.functions.runtime import cut_lineage

# Keys holding more than 1/HOT_PARTS of the joined rows are handled apart; there can be at most HOT_PARTS of them.
HOT_PARTS = 20_000


def join_by_counted_key(stream: DataFrame, keyed: DataFrame, on: list[str], rows: str, row_bytes: Column | int = 64) -> DataFrame:
    """Left-join ``stream`` to ``keyed``, which has one row per key and a column ``rows``.

    ``rows`` bounds how many rows of ``stream`` carry the key, and every key frequent in ``stream`` must be in
    ``keyed``. A small key table is broadcast after counting its rows and bytes (``row_bytes`` each). Otherwise only
    the few hot keys are broadcast (their number is bounded by HOT_PARTS, whatever the data), and the remaining keys,
    none of which can fill a task, meet in an ordinary shuffled join. Rows with a null key match nothing and stay out
    of that shuffle.
    """
    keyed = cut_lineage(keyed)
    weight = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.sum(rows).alias("total"), F.sum(weight).alias("bytes")).first()
    if size["n"] <= runtime.BROADCAST_ROWS and (size["bytes"] or 0) <= runtime.BROADCAST_BYTES:
        return stream.join(F.broadcast(keyed.drop(rows)), on, "left")
    is_hot = F.col(rows) > size["total"] / HOT_PARTS
    hot = F.broadcast(keyed.where(is_hot).drop(rows))
    cold = keyed.where(~is_hot).drop(rows)
    unkeyed = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    present = stream.where(~unkeyed)
    near = present.join(hot, on, "inner")
    far = present.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.hint("merge"), on, "left")
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in cold.schema if f.name not in on]
    none = stream.where(unkeyed).select("*", *added)
    return near.unionByName(far).unionByName(none)
