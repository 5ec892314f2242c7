"""Reading tables and reducing them to a key and the attributes a detector works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raritas.functions.runtime import cut_lineage
from raritas.sources.workbooks import read_workbooks


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a CSV file with a header, XLSX workbooks, or Parquet; directories and globs work as in Spark.

    Without a schema the CSV types are inferred, which reads the files once more. Any other ending is an error.
    """
    ending = path.rstrip("/").lower()
    if ending.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if ending.endswith(".xlsx"):
        return read_workbooks(spark, path, schema)
    if ending.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    raise ValueError("only .csv, .xlsx and .parquet inputs can be read")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan over more partitions when it has fewer than twice the number of cores.

    For work that is heavy per row on a table in few files. Such a table holds little per core, so moving it once is
    cheap; a table in many partitions is left as it is. ``df`` should be a scan with narrow steps.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in input order.

    The rows are fixed in the checkpoint folder first, so that a re-run task cannot number them differently. Only
    one count per partition reaches the driver.
    """
    mark = F.monotonically_increasing_id()
    fixed = cut_lineage(df.withColumn(name, mark))
    part = F.shiftright(F.col(name), 33)
    counts = sorted((r["part"], r["n"]) for r in fixed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, seen = [], 0
    for number, n in counts:
        starts.append((number, seen))
        seen += n
    offsets = df.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    within = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn(name, F.col("start") + within)
        .drop("part", "start")
    )


def numeric_attributes(df: DataFrame, key: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != key and isinstance(f.dataType, T.NumericType)]


def string_attributes(df: DataFrame, key: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != key and isinstance(f.dataType, T.StringType)]


def numeric_projection(df: DataFrame, key: str, on_null: str = "error") -> DataFrame:
    """Key and all numeric attributes as doubles. Integers beyond 2**53 lose their last digits."""
    names = numeric_attributes(df, key)
    return _complete(df, key, names, [F.col(f"`{c}`").cast("double") for c in names], on_null, nan=True)


def string_projection(df: DataFrame, key: str, on_null: str = "error") -> DataFrame:
    """Key and all string attributes."""
    names = string_attributes(df, key)
    return _complete(df, key, names, [F.col(f"`{c}`") for c in names], on_null, nan=False)


def _complete(df: DataFrame, key: str, names: list[str], columns: list, on_null: str, nan: bool) -> DataFrame:
    """Missing values either end the job, checked while rows pass by, or remove their row."""
    if on_null not in ("error", "drop"):
        raise ValueError("on_null must be 'error' or 'drop'")
    absent = [c.isNull() | F.isnan(c) if nan else c.isNull() for c in columns]
    if on_null == "drop":
        for missing in absent:
            df = df.where(~missing)
        return df.select(key, *[c.alias(n) for c, n in zip(columns, names)])
    checked = [
        F.when(missing, F.raise_error(F.lit(f"attribute {n} has a missing value"))).otherwise(c).alias(n)
        for c, missing, n in zip(columns, absent, names)
    ]
    return df.select(key, *checked)
