"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the columns of ``docs``; extra
columns are carried along, whatever their names. Null keys and repeated rows have the results the operators define.
"""

from __future__ import annotations

import pathlib
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from raritas.functions.runtime import cut_lineage  # noqa: E402
from raritas.llm import decontaminate, langid, mixing, near_join, token_files  # noqa: E402
from raritas.llm.common import BROADCAST_ROWS, shared_folder  # noqa: E402
from raritas.llm.components import components  # noqa: E402

# Near duplicates: word 5-grams, similarity 0.8 or more.
NEAR = near_join.Rule(words=5, percent=80)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with __key: the doc_id, or where there are null ones a struct in which each of these rows has a key of
    its own, above all others. Rows without a doc_id are written first, so that their numbers stay."""
    none = docs.where("doc_id IS NULL")
    if none.isEmpty():
        return docs.withColumn("__key", F.col("doc_id"))
    none = cut_lineage(none.withColumns({"__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()}))
    rest = docs.where("doc_id IS NOT NULL").withColumns({c: F.lit(None).cast("long") for c in ("__hash", "__row")})
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "__hash", "__row")
    return rest.unionByName(none).withColumn("__key", key).drop("__hash", "__row")


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose __key is not among ``keys`` (one column, __gone)."""
    keys = cut_lineage(keys.distinct())
    few = keys.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(keys) if few else keys, F.col("__key") == F.col("__gone"), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier names; those it answers with ``und`` (null text, no letter) go.

    Fitted on the labelled documents of the input; the column ``lang`` stays as it is.
    """
    model = langid.fit_languages(docs)
    judged = langid.identify_languages(docs, model, marks=("__lang_pred", "__score"))
    return judged.where(F.col("__lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near duplicates: the one with the least doc_id.

    Documents without a word are linked with nothing and stay. Rows that share a doc_id are one document, whatever their
    texts: their groups are one, and of rows with the doc_id that stays, if any of them is linked, the first by text does.
    Rows without a doc_id are documents of their own, which go before those that have one.
    """
    keyed = _keyed(docs)
    groups = cut_lineage(near_join.near_join(keyed, key="__key", rule=NEAR))
    ends = groups.groupBy("__key").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most"))
    parted = cut_lineage(ends.where("least < most").select("__key", "least"))
    if not parted.isEmpty():
        joined = components(groups.join(parted, "__key").select(F.col("component_id").alias("a"), F.col("least").alias("b")))
        merged = groups.join(joined, F.col("component_id") == F.col("a"), "left")
        groups = cut_lineage(merged.select("__key", "n_links", F.coalesce("m", "component_id").alias("component_id")))
    kept = _without(keyed, groups.where("__key <> component_id").select(F.col("__key").alias("__gone")))
    repeated = cut_lineage(groups.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.max("n_links").alias("links")).where("n > 1 AND links > 0").select(F.col("__key").alias("__gone")))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = kept.join(repeated, F.col("__key") == F.col("__gone"), "left_semi")
    first = again.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return _without(kept, repeated).select(*docs.columns).unionByName(first)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with its values replaced. Rows without a doc_id are judged one
    by one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    leaks = decontaminate.find_leaks(keyed, items, key="__key").select(F.col("__key").alias("__gone"))
    return _without(keyed, leaks).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at the rates of their sources, in random order."""
    return mixing.replicate(docs, marks=False)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all copies, read back: doc_id, start, n_tokens, ids_crc32 per copy."""
    folder = token_files.write_token_files(docs, shared_folder(spark, "token-ids"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_digests(spark, folder)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

# The fitted classifier and the graph of near duplicates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
