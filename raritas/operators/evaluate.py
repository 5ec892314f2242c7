"""Label metrics and stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row with tp, tn, fp, fn, accuracy, precision and recall; a ratio without cases is null."""
    same, positive = F.col(truth) == F.col(prediction), F.col(truth) == 1
    counted = df.agg(
        F.count_if(same & positive).alias("tp"),
        F.count_if(same & ~positive).alias("tn"),
        F.count_if(~same & ~positive).alias("fp"),
        F.count_if(~same & positive).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counted.select(
        "*",
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
    )


def stratified_folds(df: DataFrame, key: str, label: str, splits: int = 10, repeats: int = 1, seed: int = 0) -> DataFrame:
    """``df`` once per repeat, with ``repeat`` and ``fold``; the folds of a label differ by at most one row.

    The fold is the row's place among the rows of its label, in hash order, modulo ``splits``. A label may hold
    most of the table, so places are counted within 65536 slices of the hash and shifted by the sizes of the
    slices before.
    """
    if splits < 2 or repeats < 1:
        raise ValueError("at least two splits and one repeat are needed")
    repeated = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:"), F.col("repeat").cast("string")))
    repeated = repeated.withColumn("_h", hashed).withColumn("_slice", F.substring("_h", 1, 4))
    group = ["repeat", label, "_slice"]
    sizes = repeated.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("repeat", label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = repeated.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy("_h")) - 1)
    fold = F.pmod(F.col("_start") + F.col("_place"), F.lit(splits)).cast("int")
    return placed.join(starts, group).select(*df.columns, "repeat", fold.alias("fold"))
