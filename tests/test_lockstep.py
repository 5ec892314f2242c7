"""Networks trained side by side, and how their rows are dealt out."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raritas.operators import autoencoder
from raritas.operators.autoencoder import NetSpec, Network, adam_step, fresh_state, gradient, reconstruction_error, train_networks
from raritas.operators.lockstep import Lockstep
from raritas.plans.settings import PROFILES


def one_by_one(spec, state, x, epochs, rng):
    """Mini-batch Adam, step by step."""
    state, size = state.copy(), len(state) // 3
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), spec.batch):
            adam_step(spec, state, gradient(spec, state[:size], x[order[start : start + spec.batch]], rng))
    return state


@pytest.mark.parametrize("rows", [5, 32, 75])
@pytest.mark.parametrize("activation,output,dropout", [("tanh", "sigmoid", 0.1), ("relu", "sigmoid", 0.25), ("relu", "linear", 0.0)])
def test_networks_in_step_are_those_trained_alone(activation, output, dropout, rows):
    for inputs, layers in ((1, (8, 3, 1, 3, 8)), (3, (4,)), (2, (1, 2))):
        spec = NetSpec(layers, 3, activation, 32, inputs, dropout, output)
        x = [np.random.default_rng(i).normal(size=(rows, inputs)) for i in range(4)]
        begun = [fresh_state(spec, np.random.default_rng([9, i])) for i in range(4)]
        begun[1] = one_by_one(spec, begun[1], x[0], 2, np.random.default_rng(7))  # on its way already
        together, draws = Lockstep(spec, begun), [np.random.default_rng([8, i]) for i in range(4)]
        for _ in range(3):
            together.epoch(x, draws)
        for i, state in enumerate(together.states()):
            alone = one_by_one(spec, begun[i], x[i], 3, np.random.default_rng([8, i]))
            assert np.allclose(state, alone, rtol=0, atol=1e-12) and state[-1] == alone[-1]


def test_seven_networks_take_far_less_than_seven_times_one():
    chosen = PROFILES["big"]
    spec = NetSpec(chosen.layers, 1, chosen.activation, chosen.batch_size)
    x = [np.random.default_rng(i).normal(size=(3200, 1)) for i in range(7)]
    begun = [fresh_state(spec, np.random.default_rng(i)) for i in range(7)]

    def seconds(work):
        work()
        taken = []
        for _ in range(3):
            start = time.process_time()
            work()
            taken.append(time.process_time() - start)
        return min(taken)

    alone = seconds(lambda: [one_by_one(spec, s, rows, 1, np.random.default_rng(i)) for i, (s, rows) in enumerate(zip(begun, x))])
    together = seconds(lambda: Lockstep(spec, begun).epoch(x, [np.random.default_rng(i) for i in range(7)]))
    assert together < 0.5 * alone


def test_shards_are_dealt_one_to_a_task(spark, monkeypatch):
    """Hashing 12 shards over tasks would leave some without a shard and others with several."""
    kept = {}
    cut = autoencoder.cut_lineage

    def watched(df):
        kept["rows"] = cut(df)
        return kept["rows"]

    monkeypatch.setattr(autoencoder, "cut_lineage", watched)
    values = F.array(F.rand(1), F.rand(2)).alias("v")
    rows = spark.range(600).select((F.col("id") % 12).cast("int").alias("shard"), F.array().cast("array<int>").alias("folds"), F.md5(F.col("id").cast("string")).alias("_order"), values)
    networks = [Network(NetSpec((3,), 2, "tanh", 16), ((a,),), (0.5,), (0.3,), name=(a,)) for a in range(2)]
    weights = train_networks(rows, networks, 12, local_epochs=1, per_task=1)
    tasks = Counter(r[0] for r in kept["rows"].select(F.spark_partition_id()).collect())
    assert sorted(tasks.values()) == [50] * 24
    assert sorted(weights) == [(0, 2), (1, 2)] and all(np.isfinite(w).all() for w in weights.values())


def test_a_task_with_several_groups_keeps_them_apart():
    def batch(block, shard, v):
        return pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int32()), pa.array(shard, pa.int32()), pa.array([[]] * len(v), pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float64()))],
            names=["block", "shard", "folds", "v"],
        )

    given = [batch([0, 0], [1, 1], [[1.0, 2.0], [3.0, 4.0]]), batch([], [], []), batch([0, 0, 2], [1, 2, 2], [[5.0, 6.0], [7.0, 8.0], [9.0, 10.0]])]
    found = [(place, table.tolist(), folds.shape) for place, table, folds in autoencoder._groups(iter(given))]
    assert found == [((0, 1), [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], (3, 0)), ((0, 2), [[7.0, 8.0]], (1, 0)), ((2, 2), [[9.0, 10.0]], (1, 0))]
    assert list(autoencoder._groups(iter([batch([], [], [])]))) == []


@pytest.mark.parametrize("rows", [0, 1, 1023, 1024, 2500])
def test_errors_by_blocks_are_those_of_the_whole(rows):
    spec = NetSpec((6, 2, 6), activation="tanh", inputs=2)
    weights = fresh_state(spec, np.random.default_rng(1))[: autoencoder.weight_count(spec)]
    x = np.random.default_rng(2).normal(size=(rows, 2))
    h = x
    *hidden, (w, b) = autoencoder._unpack(spec, weights)
    for k, c in hidden:
        h = np.tanh(h @ k + c)
    whole = np.sqrt(((x - 1.0 / (1.0 + np.exp(-(h @ w + b)))) ** 2).sum(axis=1))
    assert np.allclose(reconstruction_error(spec, weights, x), whole, rtol=0, atol=1e-12)
