import math

import pytest
from pyspark.sql import functions as F

from raritas.llm import mixing


def corpus(spark, sizes):
    rows = [(f"{s}-{i}", s, "x" * 10) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, source string, text string")


def test_weights_give_the_rates(spark):
    docs = corpus(spark, {"a": 3000, "b": 1000})
    out = mixing.replicate(docs, weights={"a": 0.25, "b": 0.75})
    rates = {r.source: r.rate for r in out.select("source", "rate").distinct().collect()}
    assert rates == {"a": pytest.approx(1 / 3), "b": pytest.approx(3.0)}
    counts = {r.source: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["a"] - 1000) < 5 * math.sqrt(1000) and abs(counts["b"] - 3000) < 5 * math.sqrt(3000)


@pytest.mark.parametrize("rate", [0.05, 1.0, 7.5, 40.0, 900.0])
def test_counts_are_poisson(spark, rate):
    n = 4000 if rate < 100 else 400
    docs = corpus(spark, {"a": n})
    counts = mixing.replicate(docs, total_share=rate).groupBy("doc_id").count()
    s = counts.agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q")).first()
    mean = (s["s"] or 0) / n
    variance = (s["q"] or 0) / n - mean**2
    assert abs(mean - rate) < 5 * math.sqrt(rate / n)
    assert abs(variance - rate) < 6 * math.sqrt((rate + 2 * rate**2) / n)


def test_copies_are_numbered_and_repeatable(spark):
    docs = corpus(spark, {"a": 50, "b": 10})
    one, two = (mixing.replicate(docs.repartition(p), total_share=3.0) for p in (2, 7))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    per = one.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n"), F.countDistinct("shuffle_key").alias("k")).collect()
    assert all(r.m == r.n == r.k for r in per)
    assert one.where("source = 'a'").select(F.spark_partition_id()).distinct().count() > 1


def test_odd_rows(spark):
    rows = [(1, None, "abc", 1), (None, None, "abcd", 2), (2, "s", None, 3), (2, "s", None, 3), (3, "t", "", 4), (4, "u", "long " * 100_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, rate int")
    out = mixing.replicate(docs, total_share=4.0)
    assert out.columns == ["doc_id", "source", "text", "copy", "rate", "shuffle_key"]
    assert out.where("doc_id = 2").count() % 2 == 0
    assert mixing.replicate(docs, marks=False).columns == docs.columns
    assert mixing.replicate(docs.limit(0)).isEmpty()


def test_many_sources(spark, monkeypatch):
    docs = corpus(spark, {f"s{i}": 1 + i % 3 for i in range(200)})
    few = mixing.replicate(docs)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert mixing.replicate(docs).exceptAll(few).isEmpty()


def test_runs_without_python(spark):
    plan = mixing.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
