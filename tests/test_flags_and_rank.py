import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from raritas.functions import runtime
from raritas.operators import attributes, flags, graph, rowrank
from raritas.operators.featuresets import feature_sets
from raritas.plans import joins

KINDS = "single_loda array<int>, pairs_loda array<array<int>>, triplets_loda array<array<int>>"


def random_flagged(seed, d, count):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        values = [float(rng.randrange(5)) for _ in range(d)]
        chosen = {s.attrs for s in feature_sets(d) if rng.random() < 0.15}
        by = [[list(s) for s in sorted(chosen) if len(s) == r] for r in (1, 2, 3)]
        rows.append((i, *values, [s[0] for s in by[0]], by[1], by[2]))
    return rows


def table(spark, rows, d):
    names = [f"v{i}" for i in range(d)]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in names) + ", " + KINDS), names


def all_flags(row, d):
    single, pairs, triplets = row[1 + d :]
    return [[a] for a in single] + pairs + triplets


def brute_count(rows, d, compat=False):
    """Straight from the definition: for every flag and member, count the flags its value takes part in."""
    scores = []
    for row in rows:
        total = 0
        for flag in all_flags(row, d):
            for a in flag[:2] if compat and len(flag) == 3 else flag:
                total += sum(a in f for other in rows if other[1 + a] == row[1 + a] for f in all_flags(other, d))
        scores.append(total)
    return scores


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("d,seed", [(3, 1), (4, 2), (2, 3), (12, 4)])
def test_count_anomalies_against_brute_force(spark, d, seed, compat):
    rows = random_flagged(seed, d, 12 if d == 12 else 40)
    df, names = table(spark, rows, d)
    found = {r["id"]: r["Ranking_count"] for r in rowrank.count_anomalies(df, "id", names, "loda", compat).collect()}
    assert [found[i] for i in range(len(rows))] == brute_count(rows, d, compat)


def test_count_anomalies_with_shuffled_join_and_hot_values(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    rows = random_flagged(5, 3, 60)
    df, names = table(spark, rows, 3)
    for parts in (3, 20_000):
        monkeypatch.setattr(joins, "HOT_PARTS", parts)
        found = {r["id"]: r["Ranking_count"] for r in rowrank.count_anomalies(df, "id", names, "loda").collect()}
        assert [found[i] for i in range(60)] == brute_count(rows, 3)


def test_cutoff_is_strict(spark):
    same = spark.createDataFrame([(1, 5), (2, 5)], "id int, score bigint")
    assert rowrank.cutoff(same, "score", 0.1).count() == 0
    scores = spark.createDataFrame([(1, 0), (2, 5), (3, 10)], "id int, score bigint")
    assert sorted(r["id"] for r in rowrank.cutoff(scores, "score", 1.0).collect()) == [2, 3]
    assert [r["id"] for r in rowrank.cutoff(scores, "score", 0.1).collect()] == [3]
    share = rowrank.cutoff_share(scores, "score", 1.0).first()
    assert (share["selected"], share["rows"]) == (2, 3)


def test_collate_long_restores_the_wide_form(spark):
    rows = random_flagged(6, 4, 30)
    df, names = table(spark, rows, 4)
    again = flags.collate_long(df.select("id", *names), flags.long_flags(df, "id", "loda"), "id", "loda")
    assert sorted(map(tuple, again.collect())) == sorted(rows)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        flags.flag_columns("ngram")


def test_graph_against_brute_force(spark):
    rows = random_flagged(7, 4, 40)
    df, names = table(spark, rows, 4)
    nodes, edges = set(), set()
    for row in rows:
        chosen = {a for f in all_flags(row, 4) for a in f}
        nodes |= {row[1 + a] for a in chosen}
        edges |= {tuple(sorted((row[1 + a], row[1 + b]))) for a, b in combinations(sorted(chosen), 2)}
    assert {r["node"] for r in graph.graph_nodes(df, "id", names, "loda").collect()} == nodes
    found = [tuple(r) for r in graph.graph_edges(df, names, "loda").collect()]
    assert set(found) == edges and len(found) == len(edges)


def test_equal_values_make_a_self_loop(spark):
    df, names = table(spark, [(0, 1.0, 1.0, 3.0, [0, 1], [], [])], 3)
    assert [tuple(r) for r in graph.graph_edges(df, names, "loda").collect()] == [(1.0, 1.0)]
    assert graph.graph_nodes(df, "id", names, "loda").count() == 1


def test_pagerank_row_score(spark, monkeypatch):
    rows = [(0, 7.0, 1.0, [], [], []), (1, 1.0, 2.0, [0], [], []), (2, 7.0, 2.0, [], [[0, 1]], [])]
    df = spark.createDataFrame(rows, "id bigint, v0 double, v1 double, " + KINDS)
    for limit in (1_000_000, 0):
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", limit)
        nodes = graph.graph_nodes(df, "id", ["v0", "v1"], "loda")
        found = {r["id"]: r["pagerank_score"] for r in graph.pagerank_score(df, "id", ["v0", "v1"], nodes).collect()}
        # nodes 1, 2, 7: 7 and 1 are first seen in row 0, 2 in row 1; two other nodes each
        assert found == {0: 4, 1: 2, 2: 0}


def test_attribute_scores(spark):
    rows = random_flagged(8, 4, 25)
    df, names = table(spark, rows, 4)
    scores = attributes.attribute_score(df, names, "loda")
    for r in scores.collect():
        taken = sum(r["attr"] in f for row in rows for f in all_flags(row, 4))
        assert r["score"] == pytest.approx(taken / (25 * 10))
    values = sorted(r["score"] for r in scores.collect())
    assert attributes.table_score(scores, "mean").first()["table_score"] == pytest.approx(sum(values) / 4)
    assert attributes.table_score(scores, "median").first()["table_score"] == pytest.approx((values[1] + values[2]) / 2)
    assert attributes.attributes_above(scores.withColumn("score", F.lit(0.95))).count() == 4
    with pytest.raises(ValueError):
        attributes.table_score(scores, "mode")


def test_equal_keys_are_not_parted(spark):
    from raritas.operators.sampling import sample_rows

    with pytest.raises(ValueError):
        sample_rows(spark.createDataFrame([(1,), (1,)], "id long"), "id", lambda n: 1)
    with pytest.raises(ValueError):
        sample_rows(spark.range(20_001).select((F.col("id") * 0).alias("id")), "id", lambda n: 5)
    assert sample_rows(spark.createDataFrame([(1,), (1,), (2,)], "id long"), "id", lambda n: 3)[2] == 3
