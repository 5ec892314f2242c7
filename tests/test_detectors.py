import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raritas import detect, rank_attributes, rank_rows
from raritas.functions import quantiles
from raritas.functions.quantiles import exact_percentiles
from raritas.catalog import entries
from raritas.operators import autoencoder, iforest, loda
from raritas.operators.autoencoder import NetSpec, fit_autoencoder, gradient, initial_weights, reconstruction_error
from raritas.operators.evaluate import evaluate, stratified_folds
from raritas.operators.featuresets import feature_sets
from raritas.operators.iforest import PackedTrees, average_path, fit_iforest, grow_tree, hashed_draws
from raritas.operators.loda import fit_loda
from raritas.operators.random_cuts import fit_random_cuts, random_cuts
from raritas.operators.sampling import sample_rows, train_sample
from raritas.operators.tune import NetGrid, best, search_autoencoder, search_iforest
from raritas.plans.settings import Settings, size_profile

PLANTED = 6
SETTINGS = Settings(epochs=3, batch_size=32, activation="relu", layers=(8, 1, 8), estimators=60)


@pytest.fixture(scope="module")
def cloud(spark):
    """A Gaussian cloud and a few points ten standard deviations away."""
    rng = np.random.default_rng(3)
    points = rng.standard_normal((600, 3))
    points[:PLANTED] = rng.choice([-10.0, 10.0], (PLANTED, 3))
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id bigint, x double, y double, z double").persist()


ATTRS = ["x", "y", "z"]


def top_rows(scores, set_id):
    ordered = scores.where(F.col("set_id") == set_id).orderBy(F.desc("score")).limit(PLANTED).collect()
    return {r["id"] for r in ordered}


def test_sample_has_the_exact_size_and_is_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    for split in (0.0, 0.1, 0.333, 0.5, 1.0):
        assert train_sample(df, "key", split).count() == int(split * 5000)
    first = {r["key"] for r in train_sample(df, "key", 0.2).collect()}
    assert first == {r["key"] for r in train_sample(df.repartition(7), "key", 0.2).collect()}
    assert first != {r["key"] for r in train_sample(df, "key", 0.2, seed=1).collect()}
    assert sample_rows(df, "key", lambda n: 17)[1:] == (5000, 17)
    with pytest.raises(ValueError):
        train_sample(df, "key", 1.5)


def test_percentiles_with_and_without_narrowing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = {0: rng.exponential(size=4000), 1: np.repeat([1.0, 2.0, 3.0], [1500, 1400, 1100]), 2: rng.normal(size=37)}
    rows = [(g, float(v)) for g, line in values.items() for v in line]
    df = spark.createDataFrame(rows, "g int, v double")
    for limit in (1_000_000, 300, 10):
        monkeypatch.setattr(quantiles, "CLOSING_ROWS", limit)
        for share in (0.0, 0.5, 0.9, 1.0):
            found = exact_percentiles(df, "g", "v", share)
            for g, line in values.items():
                assert found[g] == pytest.approx(np.percentile(line, 100 * share), abs=1e-9)


def test_loda_finds_planted_points_and_flags_few(cloud):
    model = fit_loda(cloud, ATTRS)
    flagged = model.flag(cloud)
    counts = flagged.select(F.size("single_loda").alias("n"), "id").collect()
    assert all(r["n"] == 3 for r in counts if r["id"] < PLANTED)
    scores = model.scores(cloud, "id")
    shares = scores.groupBy("set_id").agg(F.avg(F.col("is_outlier").cast("int")).alias("s")).collect()
    assert len(shares) == 7 and all(r["s"] <= 0.1 for r in shares)


def test_loda_with_many_sets_gives_the_same_flags(cloud, monkeypatch):
    written = fit_loda(cloud, ATTRS)
    monkeypatch.setattr(loda, "WRITTEN_OUT", 0)
    walked = fit_loda(cloud, ATTRS)
    assert walked.thresholds == written.thresholds and walked.surprise == written.surprise
    compact = sorted(map(tuple, walked.flag(cloud).collect()))
    monkeypatch.undo()
    assert compact == sorted(map(tuple, written.flag(cloud).collect()))


def test_loda_with_a_constant_attribute(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 3)) for i in range(30)], "id int, a double, b double")
    flagged = fit_loda(df, ["a", "b"]).flag(df)
    assert flagged.where("size(triplets_loda) > 0 OR size(single_loda) > 0").count() == 0


def test_random_cuts(cloud):
    assert (np.count_nonzero(random_cuts(9, 50), axis=1) == 3).all()
    model = fit_random_cuts(cloud, ATTRS)
    scored = model.scores(cloud)
    assert {r["id"] for r in scored.orderBy(F.desc("score")).limit(PLANTED).collect()} == set(range(PLANTED))
    assert scored.where("is_outlier").count() <= 60


def test_average_path_and_tree_against_walk():
    assert [average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(64, 2)), 1)
    feature, split, path = grow_tree(points, 6, hashed_draws("a"))
    trees = PackedTrees(feature[None], split[None], path[None])
    for x in points:
        node, depth = 0, 0
        while depth < 6 and np.isfinite(split[node]):
            node, depth = 2 * node + (1 if x[feature[node]] <= split[node] else 2), depth + 1
        while node < len(split):
            node = 2 * node + 1
        assert trees.mean_path(x[None])[0] == path[node - len(split)]
    assert (path[trees_reached(trees, points)] >= 1).all()


def trees_reached(trees, points):
    return [list(trees.path[0]).index(p) for p in trees.mean_path(points)]


def test_step_function_equals_the_trees():
    rng = np.random.default_rng(2)
    grown = [grow_tree(rng.normal(size=(50, 1)), 6, hashed_draws(str(i))) for i in range(7)]
    trees = PackedTrees(*[np.stack(part) for part in zip(*grown)])
    breaks, values = trees.steps()
    x = np.concatenate([rng.normal(size=200), breaks])
    assert values[np.searchsorted(breaks, x, side="left")] == pytest.approx(trees.mean_path(x[:, None]))


def test_forest_ranks_planted_points_first(spark, cloud):
    sets = feature_sets(3)
    model = fit_iforest(cloud, "id", ATTRS, sets, trees=60)
    scores = model.scores(cloud, "id").persist()
    for s in sets:
        assert top_rows(scores, s.set_id) == set(range(PLANTED))
    again = fit_iforest(cloud.repartition(5), "id", ATTRS, sets, trees=60).scores(cloud, "id")
    assert again.exceptAll(scores).count() == 0
    bounded = fit_iforest(cloud, "id", ATTRS, sets, trees=20, contamination=0.05).scores(cloud, "id")
    assert all(r["n"] <= 30 for r in bounded.where("is_outlier").groupBy("set_id").agg(F.count("*").alias("n")).collect())


@pytest.mark.parametrize("block_sets", [1, 2, 7])
def test_forest_of_a_wide_table_stays_a_table(spark, cloud, monkeypatch, block_sets):
    whole = fit_iforest(cloud, "id", ATTRS, feature_sets(3), trees=10, contamination=0.1)
    monkeypatch.setattr(iforest, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(iforest, "BLOCK_BYTES", block_sets * 10 * iforest.tree_bytes(8) + 1)
    monkeypatch.setattr(type(cloud), "toArrow", lambda self: pytest.fail("trees must not come to the driver"))
    stored = fit_iforest(cloud, "id", ATTRS, feature_sets(3), trees=10, contamination=0.1)
    assert stored.trees == {} and stored.block_sets == block_sets and stored.thresholds == whole.thresholds
    assert sorted(stored.scores(cloud, "id").collect()) == sorted(whole.scores(cloud, "id").collect())


def test_many_sets_by_default_rules(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.normal(size=12))) for i in range(300)]
    names = [f"a{j}" for j in range(12)]
    table = spark.createDataFrame(rows, ["id", *names])
    model = fit_iforest(table, "id", names, feature_sets(12), trees=100)
    assert model.folder and model.trees == {}  # 298 sets of 100 trees are above what is broadcast
    flagged = model.flag(table.limit(20)).select("single_IF", "pairs_IF", "triplets_IF").collect()
    assert len(flagged) == 20 and any(r["triplets_IF"] for r in flagged)


def one_node_at_a_time(points, limit, draw):
    """The tree that the SQL of the forests describes, node by node."""
    feature, split, path = np.zeros(2**limit - 1, dtype=np.int32), np.full(2**limit - 1, np.inf), np.zeros(2**limit)
    todo = [(0, 0, np.arange(len(points)))]
    while todo:
        node, depth, rows = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        usable = [f for f in range(points.shape[1]) if high[f] > low[f]] if depth < limit else []
        if not usable:
            path[((node + 1) << (limit - depth)) - 2**limit] = depth + iforest.average_path(len(rows))
            continue
        number, share = draw(node)
        f = usable[number % len(usable)]
        feature[node], split[node] = f, min(low[f] + share * (high[f] - low[f]), np.nextafter(high[f], low[f]))
        left = points[rows, f] <= split[node]
        todo += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]
    return feature, split, path


@pytest.mark.parametrize("rows, features, values", [(256, 3, 10**6), (256, 3, 3), (100, 1, 5), (1, 2, 2), (2, 2, 1), (37, 20, 2)])
def test_trees_grown_by_levels_are_those_grown_by_nodes(rows, features, values):
    rng = np.random.default_rng(rows + features)
    some = [rng.integers(0, values, (n, features)) / 7.0 for n in (rows, 1, rows, 2, rows)]
    draws = [iforest.hashed_draws(f"x:{t}") for t in range(5)]
    grown = iforest.grow_trees(np.concatenate(some), np.array([len(p) for p in some]), 8, draws)
    for t in range(5):
        for found, wanted in zip(grown, one_node_at_a_time(some[t], 8, draws[t])):
            assert np.array_equal(found[t], wanted)


def test_subsamples_hold_distinct_rows(spark):
    df = spark.range(100).select(F.col("id"), F.col("id").cast("double").alias("v"))
    for trees, psi in ((4, 16), (9, 40), (3, 256)):
        drawn, size = iforest.subsamples(df, "id", ["v"], trees, psi, 0)
        assert size == min(psi, 100)
        per_tree = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("v").alias("k")).collect()
        assert sorted(r["tree"] for r in per_tree) == list(range(trees))
        assert all(r["n"] == r["k"] == size for r in per_tree)


@pytest.mark.parametrize("activation,output", [("tanh", "sigmoid"), ("relu", "linear")])
def test_gradient_by_differences(activation, output):
    spec = NetSpec((5, 2, 5), 1, activation, inputs=2, output=output, dropout=0.0)
    rng = np.random.default_rng(0)
    flat, x = initial_weights(spec, rng) + 0.01, rng.normal(size=(7, 2))

    def loss(w):
        total, h = 0.0, x
        layers = autoencoder._unpack(spec, w)
        for k, b in layers[:-1]:
            h = autoencoder._activate(spec, h @ k + b)
            total += spec.activity_l2 * (h**2).sum() / len(x)
        out = autoencoder._finish(spec, h @ layers[-1][0] + layers[-1][1])
        return total + ((out - x) ** 2).mean() + spec.activity_l2 * (out**2).sum() / len(x)

    found = gradient(spec, flat, x, None)
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert found[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-6)


def test_training_lowers_the_error():
    spec = NetSpec((6, 2, 6), 1, "tanh", 16, inputs=2, output="linear", dropout=0.0, activity_l2=0.0)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 1)) * np.array([[1.0, 2.0]])
    start = autoencoder.fresh_state(spec, rng)
    size = (len(start) - 1) // 3
    trained = autoencoder.train_local(spec, start, x, 30, rng)[:size]
    start = start[:size]
    assert reconstruction_error(spec, trained, x).mean() < 0.5 * reconstruction_error(spec, start, x).mean()


@pytest.mark.parametrize("shards", [1, 4])
def test_autoencoder_ranks_planted_points_first(cloud, shards):
    spec = NetSpec((8, 1, 8), 6, "relu", 32)
    model = fit_autoencoder(cloud, "id", ATTRS, spec, shards=shards, local_epochs=3)
    scores = model.scores(cloud, "id").persist()
    for set_id in range(3):
        assert top_rows(scores, set_id) == set(range(PLANTED))
    flagged = scores.where("is_outlier").groupBy("set_id").agg(F.count("*").alias("n")).collect()
    assert all(r["n"] <= 60 for r in flagged)


def test_one_shard_in_rounds_is_one_uninterrupted_training():
    spec = NetSpec((4, 1, 4), 6, "tanh", 16, dropout=0.0)
    x = np.random.default_rng(3).normal(size=(64, 1))
    start = autoencoder.fresh_state(spec, np.random.default_rng(4))

    class InOrder:
        def permutation(self, n):
            return np.arange(n)

        def random(self, shape):
            return np.ones(shape)

    whole = autoencoder.train_local(spec, start, x, 6, InOrder())
    parts = start
    for _ in range(3):
        parts = autoencoder.train_local(spec, parts, x, 2, InOrder())
    assert parts == pytest.approx(whole) and whole[-1] == 24


def test_profiles_are_named(cloud):
    from raritas.plans.settings import PROFILES, choose_settings

    assert choose_settings("by_rows", 10_000) == PROFILES["small"] and choose_settings("by_rows", 10_001) == PROFILES["big"]
    assert choose_settings("big", 5) == PROFILES["big"]
    with pytest.raises(ValueError):
        choose_settings("medium", 5)


def test_trees_split_on_any_of_200_attributes():
    rng = np.random.default_rng(8)
    grown = [grow_tree(rng.normal(size=(256, 200)), 8, hashed_draws(str(i))) for i in range(5)]
    assert max(feature.max() for feature, _, _ in grown) > 127


@pytest.mark.parametrize("method", ["loda", "IF", "AE"])
def test_detect_then_rank(cloud, method):
    flagged = detect(cloud, "id", method, settings=SETTINGS)
    assert flagged.columns == ["id", *ATTRS, f"single_{method}", f"pairs_{method}", f"triplets_{method}"]
    flagged = flagged.persist()
    assert flagged.count() == 600
    for ind in (0, 1):
        rows, summary = rank_rows(flagged, "id", method, ind, 0.5)
        found = summary.first()
        assert rows.count() == found["selected"] and found["rows"] == 600
    above, score = rank_attributes(flagged, "id", method)
    assert above.count() <= 3 and 0 <= score.first()["table_score"] <= 1


def test_detect_ngram_and_rank(spark):
    words = ["abc", "ghi", "jkl"]
    rows = [(i, words[i % 3] if i else "zzz", "def", i) for i in range(31)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, n int")
    scored = detect(df, "id", "ngram")
    assert scored.columns == ["id", "a", "b", "single_ngram", "pairs_ngram", "triplets_ngram"]
    total = {r["id"]: r["single_ngram"] + r["pairs_ngram"] + r["triplets_ngram"] for r in scored.collect()}
    edge = 0.9 * (max(total.values()) - min(total.values())) + min(total.values())
    rows, summary = rank_rows(scored, "id", "ngram")
    assert {r["id"] for r in rows.collect()} == {i for i, x in total.items() if x > edge} == {0}
    assert summary.first()["selected"] == 1
    above, score = rank_attributes(df, "id", "ngram", func="median")
    assert score.first()["function"] == "median"


def test_compat_forest_skips_the_last_two_attributes(cloud):
    flagged = detect(cloud, "id", "IF", settings=SETTINGS, compat=True)
    seen = {a for r in flagged.select(F.explode("single_IF").alias("a")).collect() for a in [r["a"]]}
    assert seen == {0}
    inliers = flagged.where(F.size("single_IF") > 0).count()
    assert inliers > 300


def test_arguments_are_checked(cloud):
    for wrong in ({"method": "lof"}, {"train_split": 1.2}, {"train_split": -0.1}, {"on_null": "skip"}):
        with pytest.raises(ValueError):
            detect(cloud, "id", **wrong)
    with pytest.raises(ValueError):
        rank_rows(cloud, "id", "loda", 3)
    with pytest.raises(ValueError):
        rank_attributes(cloud, "id", "loda", func="sum")
    assert size_profile(10_000).estimators == 400 and size_profile(10_001).estimators == 50


def test_evaluate(spark):
    rows = [(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)]
    found = evaluate(spark.createDataFrame(rows, "t int, p int"), "t", "p").first()
    assert tuple(found)[:4] == (1, 2, 1, 1)
    assert (found["accuracy"], found["precision"], found["recall"]) == (0.6, 0.5, 0.5)
    none = evaluate(spark.createDataFrame([(1, 0)], "t int, p int"), "t", "p").first()
    assert none["precision"] is None and none["recall"] == 0.0


def test_folds_are_balanced(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    folds = stratified_folds(df, "id", "label", 10, 2)
    sizes = folds.groupBy("repeat", "label", "fold").count().collect()
    assert len(sizes) == 40
    for repeat in (0, 1):
        for label in (0, 1):
            counts = [r["count"] for r in sizes if r["repeat"] == repeat and r["label"] == label]
            assert max(counts) - min(counts) <= 1


def test_grid_search(cloud):
    marked = cloud.withColumn("label", (F.col("id") < PLANTED).cast("int"))
    found = search_iforest(marked, "id", ATTRS, "label", trees=(5, 20), splits=3, repeats=2)
    rows = found.collect()
    assert sorted((r["trees"], r["fits"]) for r in rows) == [(5, 6), (20, 6)]
    assert all(0.5 < r["accuracy"] <= 1 for r in rows)
    grid = NetGrid(layers=[(4, 1, 4)], epochs=[2], activations=["relu", "tanh"], batches=[64])
    nets = search_autoencoder(marked, "id", ATTRS, "label", grid, splits=3, repeats=1)
    assert best(nets).first()["accuracy"] > 0.85
    assert len(NetGrid().specs(4)) == 54


def test_bounded_fitting_still_judges_every_labelled_row(spark, cloud):
    """Labels are turned for the rows outside the fitted sample: only an accuracy over all rows can fall to match."""
    small = sample_rows(cloud, "id", lambda n: 60, 1)[0].select("id").withColumn("drawn", F.lit(True))
    outlier = (F.col("id") < PLANTED).cast("int")
    turned = cloud.join(small, "id", "left").withColumn("label", F.when(F.col("drawn"), outlier).otherwise(1 - outlier))
    grid = NetGrid(layers=[(4, 1, 4)], epochs=[2], activations=["relu"], batches=[64])
    found = search_autoencoder(turned, "id", ATTRS, "label", grid, splits=3, repeats=1, fit_rows=60).first()
    assert found["accuracy"] < 0.4


def test_shards_follow_the_table():
    for rows in (0, 1000, 600_000, 10**7, 10**9):
        assert entries.shards_of(rows) >= entries.SHARDS
        assert entries.SPLIT * rows / entries.shards_of(rows) <= entries.SHARD_ROWS
