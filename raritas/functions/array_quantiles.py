"""Exact percentiles of every place of an array column, without a row per element.

Doubles are read as whole numbers that order alike, and counted by their leading bits: a sketch of counters per place, of
a size that depends on the spread of the values and not on the rows, which adds up over batches and tasks. The counters
say in which interval the wanted value lies; an interval that still holds many rows is counted again by its next bits. A
closing pass counts the distinct values of the open intervals. Counters stay in the tasks: the one that holds a wanted rank
is found there, and two lines a place reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raritas.functions.runtime import ship_package

# Bits counted by one pass: sign and exponent with eight bits behind the point, then as many again.
LEVEL_BITS = 20
# Values that the closing pass may count, over all places.
CLOSING_VALUES = 1_000_000
_BITS = 64
_SIGN = np.uint64(1 << 63)


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers without sign that order like the doubles; both zeros are one, NaN is the largest."""
    bits = (values + 0.0).view(np.uint64)
    bits = np.where(np.isnan(values), np.uint64(0x7FF8 << 48), bits)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def unordered(numbers: np.ndarray) -> np.ndarray:
    numbers = np.asarray(numbers, dtype=np.uint64)
    return np.where(numbers & _SIGN, numbers & ~_SIGN, ~numbers).view(np.float64)


@dataclass
class Target:
    """The value of one rank at one place: the leading bits known so far, and how many values lie below these."""

    place: int
    rank: int
    prefix: int = 0
    below: int = 0
    inside: int = 0


@dataclass
class Counters:
    """Counts per (open interval, next bits); intervals are (place, prefix) after ``known`` bits."""

    intervals: Sequence[tuple[int, int]]
    known: int
    taken: int
    counts: list[dict[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.counts = [{} for _ in self.intervals]

    def add(self, numbers: np.ndarray, present: np.ndarray) -> None:
        """Count a batch: one line per row and one column per place."""
        shift = np.uint64(_BITS - self.known - self.taken)
        for (place, prefix), counts in zip(self.intervals, self.counts):
            column = numbers[present[:, place], place]
            if self.known:
                column = column[column >> np.uint64(_BITS - self.known) == np.uint64(prefix)]
            digits, n = np.unique((column >> shift) & np.uint64((1 << self.taken) - 1), return_counts=True)
            for digit, count in zip(digits.tolist(), n.tolist()):
                counts[digit] = counts.get(digit, 0) + count

    def lines(self) -> tuple[list[int], list[int], list[int]]:
        given = [(i, digit, n) for i, counts in enumerate(self.counts) for digit, n in counts.items()]
        return tuple(map(list, zip(*given))) if given else ([], [], [])


def _pass(df: DataFrame, column: str, intervals: list[tuple[int, int]], known: int, taken: int) -> DataFrame:
    """(interval, digit, n) over all rows; tasks add up their batches first."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(intervals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(shared.value, known, taken)
        for batch in batches:
            lists = batch.column(0)
            lists = lists.filter(lists.is_valid())
            if len(lists):
                flat = lists.flatten()
                present = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                counters.add(ordered(flat.fill_null(0.0).to_numpy(zero_copy_only=False)).reshape(len(lists), -1), present)
        interval, digit, n = counters.lines()
        yield pa.RecordBatch.from_arrays([pa.array(interval, pa.int32()), pa.array(digit, pa.int64()), pa.array(n, pa.int64())], names=["interval", "digit", "n"])

    found = df.select(column).mapInArrow(run, "interval int, digit long, n long")
    return found.groupBy("interval", "digit").agg(F.sum("n").alias("n"))


def array_percentiles(df: DataFrame, column: str, places: int, share: float, closing: int = CLOSING_VALUES) -> list[float | None]:
    """Linearly interpolated percentile of each of the ``places`` of the array ``column``; null elements do not count.

    The column is computed anew in each pass, two of them as a rule, and is not stored. A place without values has none.
    """
    targets: list[Target] = []
    sizes, known = [0] * places, 0
    most = max(1, closing // max(1, places))
    while known < _BITS and (targets or not known):
        narrow = not known or max(t.inside for t in targets) > most
        taken = min(LEVEL_BITS, _BITS - known) if narrow else _BITS - known
        intervals = sorted({(t.place, t.prefix) for t in targets}) if known else [(i, 0) for i in range(places)]
        counted = _running(_pass(df, column, intervals, known, taken))
        if not known:
            first = F.floor(F.lit(share) * (F.col("size") - 1))
            for r in _holding(counted, F.array(first, F.least(F.col("size") - 1, first + 1))).collect():
                sizes[r["interval"]] = r["size"]
                targets += [Target(r["interval"], rank, r["digit"], r["below"], r["n"]) for rank in sorted(set(r["held"]))]
        else:
            wanted: dict[tuple[int, int], list[int]] = {interval: [] for interval in intervals}
            for t in targets:
                wanted[t.place, t.prefix].append(t.rank - t.below)
            lines = [(i, wanted[interval]) for i, interval in enumerate(intervals)]
            given = df.sparkSession.createDataFrame(lines, "interval int, ranks array<long>")
            held = _holding(counted.join(F.broadcast(given), "interval"), F.col("ranks")).collect()
            counter_of = {(*intervals[r["interval"]], rank): r for r in held for rank in r["held"]}
            for t in targets:
                r = counter_of[t.place, t.prefix, t.rank - t.below]
                t.prefix, t.below, t.inside = t.prefix << taken | r["digit"], t.below + r["below"], r["n"]
        known += taken
    values = {(t.place, t.rank): float(unordered(np.array([t.prefix], dtype=np.uint64))[0]) for t in targets}
    result: list[float | None] = [None] * places
    for i, size in enumerate(sizes):
        if size:
            low, high = (values[i, k] for k in _ranks(share, size))
            result[i] = low if low == high else low + (high - low) * (share * (size - 1) - math.floor(share * (size - 1)))
    return result


def _ranks(share: float, size: int) -> tuple[int, int]:
    """The two rows around the wanted place."""
    first = math.floor(share * (size - 1))
    return first, min(size - 1, first + 1)


def _running(counted: DataFrame) -> DataFrame:
    """Counters with the number of values ``below`` them in their interval, and its ``size``."""
    own = Window.partitionBy("interval")
    upto = F.sum("n").over(own.orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.select("interval", "digit", "n", (upto - F.col("n")).alias("below"), F.sum("n").over(own).alias("size"))


def _holding(counted: DataFrame, ranks: Column) -> DataFrame:
    """The counters that hold some of the ``ranks`` of their interval, with those they hold."""
    held = F.filter(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    return counted.withColumn("held", held).where(F.size("held") > 0).select("interval", "digit", "n", "below", "size", "held")
