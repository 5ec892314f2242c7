"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Each source has a target share of the output and a size (bytes of text). Its repetition rate is
``share * total / size``, where ``total`` is the size of the output. Each document draws a number from a Poisson
distribution with that mean by inverting it at a number hashed from (seed, key), is repeated that many times, and all
copies are dealt to tasks and sorted by a hash of (seed, key, copy), which is a shuffle over the whole output.

A rate above ``PIECE`` is the sum of equal rates of at most ``PIECE``, each drawn with a hash of its own: the sum of
Poisson numbers is one, and no exponential underflows. There is no cap on the copies of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.llm.common import BROADCAST_ROWS, unit_interval

TEMPERATURE = 0.7
PIECE = 16.0
SEED = "mix"
# Terms of the cumulative distribution; beyond it less than 2**-52 is left at a rate of PIECE.
TERMS = 80


def source_rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, temperature: float, total_share: float) -> DataFrame:
    """One row per source: src, size, rate. A null source is one of its own.

    Without ``weights`` the target share of a source is its size to the power ``temperature``, divided by their sum; with
    them, sources not named have share 0. A source without any byte has rate 1.
    """
    sizes = docs.groupBy(F.col(source).alias("src")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weighted = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weighted = sizes.withColumn("w", F.coalesce(named[F.col("src")], F.lit(0.0)).cast("double"))
    sums = weighted.agg(F.sum("w").alias("w"), F.sum("size").alias("size")).first()
    all_w, all_size = F.lit(sums["w"] or 1.0), F.lit(sums["size"] or 0)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.col("w") / all_w * all_size.cast("double") * F.lit(float(total_share)) / F.col("size").cast("double")
    )
    return weighted.select("src", "size", rate.alias("rate"))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1 as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda s: s["c"])


def poisson_count(key: Column, table: Column, pieces: Column, seed: str) -> Column:
    """Draws of ``pieces`` independent numbers by inversion, added up."""

    def draw(i: Column) -> Column:
        u = unit_interval(F.lit(seed), key, i.cast("string"))
        return F.size(F.filter(table, lambda c: c <= u)).cast("long")

    return F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0).cast("long"), lambda total, i: total + draw(i))


def replicate(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    total_share: float = 1.0,
    seed: str = SEED,
    marks: bool = True,
) -> DataFrame:
    """All columns of ``docs``, one row per copy, in random order; with ``marks`` also copy (1, 2, ...), rate, shuffle_key.

    Rows with equal keys draw equal numbers; a null key draws as the empty string. With ``marks``, columns of
    ``docs`` by these names give way to the new ones. An empty table stays empty. The table of rates has a row per source; it is broadcast
    if it has at most BROADCAST_ROWS rows, and joined with adaptive skew handling beyond.
    """
    spark = docs.sparkSession
    plain = docs.drop("copy", "rate", "shuffle_key") if marks else docs
    rates = source_rates(docs, source, text, weights, temperature, total_share)
    drawn = rates.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")).withColumn("cdf", cumulative(F.col("rate") / F.col("pieces")))
    drawn = drawn.select(F.struct("src", "rate", "pieces", "cdf").alias("__mix"))
    few = rates.count() <= BROADCAST_ROWS
    joined = plain.join(F.broadcast(drawn) if few else drawn, plain[source].eqNullSafe(F.col("__mix.src")))
    count = F.when(F.col("__mix.rate") > 0, poisson_count(F.col(key), F.col("__mix.cdf"), F.col("__mix.pieces"), seed)).otherwise(F.lit(0).cast("long"))
    copies = joined.withColumn("__copy", F.explode(F.when(count > 0, F.sequence(F.lit(1).cast("long"), count))))
    name = F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("__copy").cast("string"))
    mixed = copies.withColumn("__order", F.md5(name))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = mixed.repartition(parts, "__order").sortWithinPartitions("__order")
    new = {"__copy": "copy", "__mix.rate": "rate", "__order": "shuffle_key"} if marks else {}
    return dealt.select(*plain.columns, *[F.col(a).alias(b) for a, b in new.items()])


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return replicate(docs).select("doc_id", "source", "copy", F.round("rate", 9).alias("rate"), "shuffle_key", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(CAST(size AS DOUBLE), 0.7) AS w FROM sizes),
rated AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE w / (SELECT sum(w) FROM weighted)
         * CAST((SELECT sum(size) FROM weighted) AS DOUBLE) / CAST(size AS DOUBLE) END AS rate FROM weighted),
pieced AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS pieces FROM rated),
terms AS (
  SELECT source, rate / pieces AS r, 0 AS k, exp(-rate / pieces) AS p, exp(-rate / pieces) AS c FROM pieced
  UNION ALL
  SELECT source, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM terms WHERE k < 79),
cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM terms GROUP BY source),
draws AS (
  SELECT d.doc_id, d.source, d.text, g.rate, f.cs,
         unnest(range(1, g.pieces + 1)) AS i
  FROM documents d JOIN pieced g ON d.source IS NOT DISTINCT FROM g.source JOIN cdf f ON d.source IS NOT DISTINCT FROM f.source),
numbers AS (
  SELECT doc_id, source, text, rate,
         len(list_filter(cs, lambda c: c <= CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS n
  FROM draws),
totals AS (SELECT doc_id, source, text, rate, CAST(sum(n) AS BIGINT) AS n FROM numbers GROUP BY ALL),
copies AS (SELECT doc_id, source, text, rate, unnest(range(1, n + 1)) AS copy FROM totals)
SELECT doc_id, source, copy, round(rate, 9) AS rate,
       md5('mix-order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key,
       octet_length(encode(text)) AS n_bytes, md5(text) AS text_md5
FROM copies
"""
