"""Exact percentiles of many groups, without sorting and without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this many rows of a group may enter the closing aggregate.
CLOSING_ROWS = 1_000_000
_ACCURACY = 10_000
_MARGIN = 2 / _ACCURACY


def exact_percentiles(df: DataFrame, group: str, value: str, share: float) -> dict[int, float]:
    """Linearly interpolated percentile of ``value`` for each integer ``group``; the groups must be few.

    Large groups are narrowed first: a mergeable sketch bounds the wanted value from both sides and the rows
    outside the bounds are only counted. Each step leaves about 4 in 10000 rows, however the values are spread.
    Equal values are carried on as one row with a count, so they cannot crowd the closing aggregate.
    """
    sizes = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    low = dict.fromkeys(sizes, float("-inf"))
    high = dict.fromkeys(sizes, float("inf"))
    below, left = dict.fromkeys(sizes, 0), dict(sizes)
    position = dict.fromkeys(sizes, share)
    wide = {g for g, n in sizes.items() if n > CLOSING_ROWS}
    while wide:
        # One sketch per group, combined on the map side; each knows all shares asked for and is read at its own two.
        around = {g: _around(position[g], left[g]) for g in wide}
        asked = sorted({share for pair in around.values() for share in pair})
        sketch = F.percentile_approx(value, asked, _ACCURACY).alias("q")
        rows = df.where(_within(group, value, low, high) & F.col(group).isin(list(wide))).groupBy(group).agg(sketch).collect()
        for r in rows:
            low[r[group]], high[r[group]] = (r["q"][asked.index(share)] for share in around[r[group]])
        inside = _within(group, value, low, high)
        under = F.col(value) < _bound(group, low)
        counts = (
            df.where(F.col(group).isin(list(wide)))
            .groupBy(group)
            .agg(F.count_if(under).alias("below"), F.count_if(inside).alias("n"))
            .collect()
        )
        for r in counts:
            g = r[group]
            if r["n"] <= CLOSING_ROWS or r["n"] == left[g] or low[g] == high[g]:
                wide.discard(g)
            below[g], left[g] = r["below"], r["n"]
            position[g] = (share * (sizes[g] - 1) - below[g]) / max(1, left[g] - 1)
    if not sizes:
        return {}
    counted = df.where(_within(group, value, low, high)).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    # One closing aggregate per group; each knows all positions asked for and is read at its own.
    asked = sorted({min(1.0, max(0.0, p)) for p in position.values()})
    places = F.array(*map(F.lit, asked))
    closed = counted.groupBy(group).agg(F.percentile(value, places, F.col("n")).alias("q")).collect()
    return {r[group]: r["q"][asked.index(min(1.0, max(0.0, position[r[group]])))] for r in closed}


def _around(position: float, rows: int) -> list[float]:
    """Shares that enclose the two rows next to ``position``, whatever the sketch's error."""
    margin = max(_MARGIN, 3 / rows)
    return [max(0.0, position - margin), min(1.0, position + margin)]


def _bound(group: str, bounds: dict[int, float]) -> Column:
    by_group = [bounds.get(g) for g in range(max(bounds) + 1)]
    return F.get(F.array(*[F.lit(b).cast("double") for b in by_group]), F.col(group))


def _within(group: str, value: str, low: dict[int, float], high: dict[int, float]) -> Column:
    return (F.col(value) >= _bound(group, low)) & (F.col(value) <= _bound(group, high))
