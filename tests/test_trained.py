"""Percentiles of score arrays, exact network steps, and searches that share trainings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raritas.functions.array_quantiles import array_percentiles, ordered, unordered
from raritas.operators import tune
from raritas.operators.autoencoder import HashedDraws, NetSpec, fit_autoencoder, gradient, hashed_weights
from raritas.operators.featuresets import feature_sets
from raritas.operators.iforest import fit_iforest
from raritas.operators.tune import NetGrid, search_autoencoder


def score_table(n):
    rng = np.random.default_rng(0)
    columns = [
        rng.normal(size=n),
        rng.integers(0, 3, n) * 1.0,
        np.exp(rng.normal(size=n) * 20) * rng.choice([-1, 1], n),
        np.full(n, 0.25),
        np.where(np.arange(n) % 2, 1e-300, -0.0),
        rng.random(n) * 1e-9 + 1,
        np.where(np.arange(n) % 5, -np.inf, np.inf),
    ]
    return np.column_stack(columns)


def test_ordered_numbers_order_like_doubles():
    values = np.array([-np.inf, -1e300, -1.0, -1e-320, 0.0, 5e-324, 1.0, 1 + 2**-52, np.inf])
    assert np.all(np.diff(ordered(values).astype(object)) > 0) and np.array_equal(unordered(ordered(values)), values)
    assert ordered(np.array([-0.0]))[0] == ordered(np.array([0.0]))[0] and ordered(np.array([np.nan]))[0] > ordered(np.array([np.inf]))[0]


@pytest.mark.parametrize("closing", [10**6, 70, 1])
@pytest.mark.parametrize("share", [0.0, 0.1, 0.9, 0.999, 1.0])
def test_array_percentiles(spark, closing, share):
    table = score_table(3000)[:, :6]
    df = spark.createDataFrame([(row.tolist(),) for row in table], "s array<double>").repartition(5)
    found = array_percentiles(df, "s", 6, share, closing)
    assert np.allclose(found, np.quantile(table, share, axis=0), rtol=1e-14, atol=0)


def test_array_percentiles_of_nulls_ties_and_empty_tables(spark):
    rows = [([float(i), None, 1.0 if i < 5 else None, float("inf")],) for i in range(11)] + [(None,)]
    df = spark.createDataFrame(rows, "s array<double>")
    assert array_percentiles(df, "s", 4, 0.95) == [9.5, None, 1.0, float("inf")]
    assert array_percentiles(df.where("false"), "s", 4, 0.5) == [None] * 4


def cloud_of(spark, n=600):
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, rng.normal(size=3) if i > 5 else rng.normal(size=3) * 8), int(i <= 5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, label int")


def test_no_row_is_written_once_per_set(spark, monkeypatch):
    plans = []
    taken = tune.array_percentiles

    def watched(df, *rest):
        plans.append(df._jdf.queryExecution().toString())
        return taken(df, *rest)

    for module in ("autoencoder", "iforest", "tune"):
        monkeypatch.setattr(f"raritas.operators.{module}.array_percentiles", watched)
    cloud = cloud_of(spark, 200)
    fit_autoencoder(cloud, "id", ["x", "y"], NetSpec((2,), 1), steps=1)
    fit_iforest(cloud, "id", ["x", "y"], feature_sets(2), 3, contamination=0.1)
    search_autoencoder(cloud, "id", ["x", "y"], "label", NetGrid([(2,)], [1], ["relu"], [64]), 2, 1).collect()
    assert len(plans) == 3 and not any("Generate" in p or "InMemoryRelation" in p for p in plans)


def test_forest_share_is_kept(spark):
    model = fit_iforest(cloud_of(spark), "id", ["x", "y", "z"], feature_sets(3), 20, contamination=0.1)
    counts = model.scores(cloud_of(spark), "id").where("is_outlier").groupBy("set_id").count().collect()
    assert len(counts) == 7 and all(r["count"] <= 60 for r in counts)


def test_steps_do_not_depend_on_partitions(spark):
    spec, cloud = NetSpec((4, 2, 4), activation="tanh", learning_rate=0.05), cloud_of(spark)
    one, eight = (fit_autoencoder(cloud.repartition(n), "id", ["x", "y", "z"], spec, steps=5, batches=2) for n in (1, 8))
    for a, b in zip(one.weights, eight.weights):
        assert np.allclose(a, b, rtol=0, atol=1e-9)
    assert all(abs(one.thresholds[i] - eight.thresholds[i]) < 1e-9 for i in one.thresholds)
    moved = fit_autoencoder(cloud, "id", ["x", "y", "z"], spec, steps=6, batches=2)
    assert not np.allclose(one.weights[0], moved.weights[0], atol=1e-6)


def test_one_step_is_the_gradient_of_all_rows(spark):
    spec, cloud = NetSpec((3, 2), activation="relu", learning_rate=0.1), cloud_of(spark, 100)
    model = fit_autoencoder(cloud, "id", ["x"], spec, steps=1)
    rows = cloud.select("id", "x", F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(":4"))), 1, 7), 16, 10).cast("long")).collect()
    x = (np.array([[r[1]] for r in rows]) - model.mean[0]) / model.scale[0]
    start = hashed_weights(spec, 0, 0)
    g = gradient(spec, start, x, HashedDraws(np.array([r[2] for r in rows]), 0, 0))
    # the first step of Adam goes by the learning rate against the sign of the gradient
    assert np.allclose(model.weights[0], start - 0.1 * g / (np.abs(g) + 1e-7 / np.sqrt(0.001)), atol=1e-9)


def test_hashed_draws_are_spread_and_independent():
    draws = HashedDraws(np.arange(0, 2**28, 26843), 3, 2)
    first, second = draws.random((10000, 6)), draws.random((10000, 6))
    both = np.column_stack((first, second)) < 0.1
    assert np.all(np.abs(both.mean(axis=0) - 0.1) < 0.02)
    for i in range(12):
        for j in range(i):
            assert abs((both[:, i] & both[:, j]).mean() - 0.01) < 0.006


def test_weights_on_the_way_are_those_of_separate_trainings(spark):
    cloud = cloud_of(spark)
    at_once = search_autoencoder(cloud, "id", ["x", "y"], "label", NetGrid([(4, 1, 4)], [1, 3, 7], ["relu", "tanh"], [64, 128]), 3, 2)
    found = {(r["epochs"], r["activation"], r["batch"]): (r["accuracy"], r["fits"]) for r in at_once.collect()}
    apart = {}
    for epochs in (1, 3, 7):
        single = search_autoencoder(cloud, "id", ["x", "y"], "label", NetGrid([(4, 1, 4)], [epochs], ["relu", "tanh"], [64, 128]), 3, 2)
        apart |= {(r["epochs"], r["activation"], r["batch"]): (r["accuracy"], r["fits"]) for r in single.collect()}
    assert found == apart and len(found) == 12 and all(n == 6 for _, n in found.values())


def test_shards_give_the_same_weights_on_the_way(spark):
    cloud = cloud_of(spark)
    grids = [NetGrid([(3, 1, 3)], epochs, ["tanh"], [64]) for epochs in ([2, 5], [2], [5])]
    both, two, five = (
        {r["epochs"]: r["accuracy"] for r in search_autoencoder(cloud, "id", ["x", "y"], "label", g, 3, 1, shards=3).collect()} for g in grids
    )
    assert both == two | five


def test_search_judges_by_the_other_folds(spark, monkeypatch):
    """Accuracy against plain numpy, with the weights that the search found."""
    kept = {}
    judge = tune._judge

    def watched(folds, attrs, label, networks, *rest):
        kept["folds"], kept["networks"] = folds.collect(), networks
        return judge(folds, attrs, label, networks, *rest)

    monkeypatch.setattr(tune, "_judge", watched)
    grid = NetGrid([(4, 1, 4)], [2, 4], ["tanh"], [64])
    found = {r["candidate"]: r["accuracy"] for r in search_autoencoder(cloud_of(spark), "id", ["x", "y"], "label", grid, 3, 2).collect()}
    rows = kept["folds"]
    table, truth = np.array([[r["x"], r["y"]] for r in rows]), np.array([r["label"] for r in rows])
    accuracies = {0: [], 1: []}
    for m, (network, weights) in enumerate(kept["networks"]):
        repeat, fold = m // 3 % 2, m % 3
        own = np.array([r["folds"][repeat] == fold for r in rows])
        assert network.skip == (repeat, fold)
        assert np.allclose(network.mean, table[~own].mean(axis=0)) and np.allclose(network.scale, table[~own].std(axis=0))
        error = tune.reconstruction_error(network.spec, weights, network.read(table))
        accuracies[m // 6].append(((error[own] > np.quantile(error[~own], 0.9)) == (truth[own] == 1)).mean())
    assert found == pytest.approx({c: np.mean(a) for c, a in accuracies.items()})
