"""LODA in its general form: histograms over seeded sparse random projections (Pevny, 2016).

A hundred projections of every row are dense arithmetic, done on Arrow batches. What leaves a batch is one line per
cut or per bin, or one score per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raritas.functions.quantiles import exact_percentiles
from raritas.functions.runtime import ship_package
from raritas.operators.loda import BINS, EMPTY_BIN

CUTS = 100
_DECIMALS = 9
_ROWS_PER_STEP = 4096


def random_cuts(width: int, cuts: int = CUTS, seed: int = 0) -> np.ndarray:
    """One line of weights per cut: ``int(sqrt(width))`` standard normal weights, the others zero."""
    rng = np.random.default_rng(seed)
    weights = rng.standard_normal((cuts, width))
    for line in weights:
        line[rng.permutation(width)[int(math.sqrt(width)) :]] = 0.0
    return weights


def project(columns: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Rows by cuts, added up attribute by attribute."""
    total = np.zeros((len(columns[0]), len(weights)))
    for values, line in zip(columns, weights.T):
        total += values[:, None] * line
    return total


def places(projected: np.ndarray, low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each projected value; outside the range the end bins, in a range of no width bin 0."""
    width = np.where(high > low, (high - low) / bins, np.inf)
    return np.clip(np.floor((projected - low) / width), 0, bins - 1).astype(np.int64)


def _columns(batch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch]


def _steps(columns: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    for start in range(0, len(columns[0]), _ROWS_PER_STEP):
        yield [c[start : start + _ROWS_PER_STEP] for c in columns]


@dataclass
class RandomCutModel:
    attrs: list[str]
    weights: np.ndarray
    low: np.ndarray
    high: np.ndarray
    surprise: np.ndarray
    threshold: float = 0.0
    bins: int = BINS

    def score(self, spark) -> Column:
        """Mean of ``-ln p`` over the cuts, on a grid of 9 decimals."""
        shared = spark.sparkContext.broadcast((self.weights, self.low, self.high, self.surprise, self.bins))

        def mean_surprise(*batch: pa.Array) -> pa.Array:
            weights, low, high, surprise, bins = shared.value
            cuts = np.arange(len(weights))
            columns = _columns(batch)
            result = [np.empty(0)]
            for some in _steps(columns):
                result.append(surprise[cuts, places(project(some, weights), low, high, bins)].mean(axis=1))
            return pa.array(np.concatenate(result))

        found = F.arrow_udf(mean_surprise, "double")(*[F.col(a).cast("double") for a in self.attrs])
        return F.round(found, _DECIMALS)

    def scores(self, df: DataFrame) -> DataFrame:
        """The table with ``score`` and ``is_outlier``; no row leaves its partition."""
        scored = df.withColumn("score", self.score(df.sparkSession))
        return scored.withColumn("is_outlier", F.col("score") > F.lit(self.threshold))


def fit_random_cuts(
    sample: DataFrame, attrs: list[str], cuts: int = CUTS, bins: int = BINS, contamination: float = 0.1, seed: int = 0
) -> RandomCutModel:
    """Ranges of all cuts in one pass, ``cuts * bins`` counters in another, then the threshold."""
    spark = sample.sparkSession
    ship_package(spark)
    weights = random_cuts(len(attrs), cuts, seed)
    numbers = sample.select(*[F.col(a).cast("double").alias(a) for a in attrs])

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _steps(_columns(batch.columns)):
                projected = project(some, weights)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(cuts, dtype=np.int32)), pa.array(projected.min(axis=0)), pa.array(projected.max(axis=0))],
                    names=["cut", "low", "high"],
                )

    edges = (
        numbers.mapInArrow(extremes, "cut int, low double, high double")
        .groupBy("cut")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .orderBy("cut")
        .collect()
    )
    if not edges:
        raise ValueError("the training sample is empty")
    low, high = np.array([r["low"] for r in edges]), np.array([r["high"] for r in edges])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(cuts * bins, dtype=np.int64)
            for some in _steps(_columns(batch.columns)):
                codes = np.arange(cuts) * bins + places(project(some, weights), low, high, bins)
                seen += np.bincount(codes.ravel(), minlength=cuts * bins)
            found = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["code", "n"])

    counted = numbers.mapInArrow(counts, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    filled = np.zeros(cuts * bins)
    for r in counted:
        filled[r["code"]] = r["n"]
    filled = filled.reshape(cuts, bins)
    share = filled / filled[0].sum()
    model = RandomCutModel(attrs, weights, low, high, -np.log(np.where(filled > 0, share, EMPTY_BIN)), 0.0, bins)
    scored = numbers.select(F.lit(0).alias("all"), model.score(spark).alias("score")).persist()
    model.threshold = exact_percentiles(scored, "all", "score", 1 - contamination)[0]
    scored.unpersist()
    return model
