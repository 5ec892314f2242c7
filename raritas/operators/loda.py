"""LODA for one, two and three attributes: equal-width histograms and averaged surprise.

With up to three attributes every sparse random cut carries a single non-zero weight, so a cut is a scaled copy of
one attribute and has that attribute's histogram. A set's score is therefore the mean of its attributes' ``-ln p``.
Each attribute gets one histogram, whatever the number of sets it belongs to.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raritas.operators.featuresets import FeatureSet, feature_sets
from raritas.operators.flags import collate, collate_scores

BINS = 10
EMPTY_BIN = 1e-12
# Scores are discrete and heavily tied: they are compared on a grid of 9 decimals.
_DECIMALS = 9
_GRID = 10**_DECIMALS
# Up to this many sets are written out as single expressions, which compile to fast code; beyond it the plan would
# grow too large, and the sets become a literal array that one expression walks.
WRITTEN_OUT = 64


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal-width bin, values outside the range going to the end bins."""
    if not high > low:
        return F.lit(0)
    place = F.floor((value - F.lit(low)) / F.lit((high - low) / bins))
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), place)).cast("int")


@dataclass
class LodaModel:
    attrs: list[str]
    sets: list[FeatureSet]
    low: list[float]
    high: list[float]
    surprise: list[list[float]]
    thresholds: dict[int, float]
    bins: int = BINS

    def _bin(self, attr: int) -> Column:
        return bin_of(F.col(self.attrs[attr]), self.low[attr], self.high[attr], self.bins)

    def _surprise(self, attr: int, place: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.surprise[attr])), place)

    def _with_surprises(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[self._surprise(a, self._bin(a)).alias(f"_s{a}") for a in range(len(self.attrs))])

    def _score(self, s: FeatureSet) -> Column:
        return _mean([F.col(f"_s{a}") for a in s.features])

    def scores(self, df: DataFrame, key: str) -> DataFrame:
        """(key, set_id, attrs, score, is_outlier) for every row and set; nothing is shuffled."""
        cells = F.array(
            *[
                F.struct(
                    F.lit(s.set_id).alias("set_id"),
                    F.lit(s.label).alias("attrs"),
                    self._score(s).alias("score"),
                    self._hit(s).alias("is_outlier"),
                )
                for s in self.sets
            ]
        )
        return self._with_surprises(df).select(key, F.inline_outer(cells))

    def _cut(self, s: FeatureSet) -> float:
        """The score exceeds this where its rounded value exceeds the threshold, so no score has to be rounded."""
        return (math.floor(self.thresholds[s.set_id] * _GRID + 1e-3) + 0.5) / _GRID

    def _hit(self, s: FeatureSet) -> Column:
        return self._score(s) > F.lit(self._cut(s))

    def flag(self, df: DataFrame) -> DataFrame:
        """The table with ``single_loda``, ``pairs_loda`` and ``triplets_loda``."""
        if len(self.sets) <= WRITTEN_OUT:
            scored = collate(self._with_surprises(df), [(s, self._hit(s)) for s in self.sets], "loda")
            return scored.drop(*[f"_s{a}" for a in range(len(self.attrs))])
        surprises = F.array(*[self._surprise(a, self._bin(a)) for a in range(len(self.attrs))])
        means = _per_set(self.sets, lambda values: _mean(values), "_s")
        scored = df.withColumn("_s", surprises).withColumn("_scores", means)
        return collate_scores(scored, "_scores", self.sets, [self._cut(s) for s in self.sets], "loda").drop("_s", "_scores")


def _per_set(sets: list[FeatureSet], combine, values: str) -> Column:
    """Array with ``combine`` of each set's elements of the array column ``values``, sets in order of size.

    ``values`` is named several times, which keeps the optimizer from moving its computation into the lambda.
    """
    parts = []
    for arity in sorted({s.arity for s in sets}):
        members = F.array(*[F.array(*map(F.lit, s.features)) for s in sets if s.arity == arity])
        parts.append(F.transform(members, _combiner(combine, values, arity)))
    return F.concat(*parts)


def _combiner(combine, values: str, arity: int):
    return lambda members: combine([F.get(F.col(values), members[k]) for k in range(arity)])


def fit_loda(
    sample: DataFrame, attrs: list[str], contamination: float = 0.1, bins: int = BINS, max_arity: int = 3
) -> LodaModel:
    """Fit on ``sample`` in two passes: ranges, then bin counts of all sets.

    The second pass counts bin combinations, at most ``bins ** arity`` per set, so what leaves the map side depends
    on the number of sets and not on the rows. Histograms and thresholds are read off these counts.
    """
    if not attrs:
        raise ValueError("no numeric attribute to work on")
    sets = feature_sets(len(attrs), max_arity)
    edges = sample.agg(
        *[f(a).alias(f"{n}{i}") for i, a in enumerate(attrs) for n, f in (("low", F.min), ("high", F.max))],
        F.count(F.lit(1)).alias("rows"),
    ).first()
    rows = edges["rows"]
    if rows == 0:
        raise ValueError("the training sample is empty")
    low = [float(edges[f"low{i}"]) for i in range(len(attrs))]
    high = [float(edges[f"high{i}"]) for i in range(len(attrs))]
    model = LodaModel(attrs, sets, low, high, [], {}, bins)

    width = bins**max_arity
    places = [model._bin(a).cast("bigint") for a in range(len(attrs))]
    zero = F.lit(0).cast("bigint")
    if len(sets) <= WRITTEN_OUT:
        binned = sample.select(*[place.alias(f"_b{a}") for a, place in enumerate(places)])
        codes = F.array(
            *[F.lit(s.set_id * width) + reduce(lambda code, a: code * bins + F.col(f"_b{a}"), s.features, zero) for s in sets]
        )
    else:
        binned = sample.select(F.array(*places).alias("_b"))
        within = _per_set(sets, lambda digits: reduce(lambda code, b: code * bins + b, digits, zero), "_b")
        starts = F.array(*[F.lit(s.set_id * width).cast("bigint") for s in sets])
        codes = F.zip_with(within, starts, lambda code, start: code + start)
    counts = binned.select(F.explode_outer(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).persist()
    single = {r["code"]: r["n"] for r in counts.where(F.col("code") < len(attrs) * width).collect()}
    for a in range(len(attrs)):
        filled = [single.get(a * width + b, 0) for b in range(bins)]
        model.surprise.append([-math.log(n / rows) if n else -math.log(EMPTY_BIN) for n in filled])

    set_id = F.floor(F.col("code") / width).cast("int")
    digits = [F.floor(F.col("code") / bins**k).cast("bigint") % bins for k in range(max_arity)]
    surprise = F.array(*[F.array(*map(F.lit, line)) for line in model.surprise])

    def score_of(arity: int) -> Column:
        features = F.get(F.array(*[F.array(*map(F.lit, s.features)) for s in sets]), set_id)
        return _mean([F.get(F.get(surprise, features[m]), digits[arity - 1 - m].cast("int")) for m in range(arity)])

    arity_of = F.get(F.array(*[F.lit(s.arity) for s in sets]), set_id)
    score = F.coalesce(*[F.when(arity_of == r, score_of(r)) for r in sorted({s.arity for s in sets})])
    ranked = counts.select(set_id.alias("set_id"), F.round(score, _DECIMALS).alias("score"), "n")
    cut = F.percentile("score", F.lit(1 - contamination), F.col("n"))
    model.thresholds = {r["set_id"]: r["t"] for r in ranked.groupBy("set_id").agg(cut.alias("t")).collect()}
    counts.unpersist()
    return model


def _mean(columns: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, columns)
    return total / F.lit(float(len(columns))) if len(columns) > 1 else total
