"""Autoencoder detector: small dense networks trained on shards of the sample and averaged.

For every feature set one network reads the product of the set's attributes, standardised. Training is data
parallel: each shard of the sample runs some epochs from the common state, the states (weights and optimizer moments)
are averaged weighted by shard size (McMahan et al., 2017), and the next round starts from there. The number of shards
and the epochs of a round are settings, whatever the size of the table. With one shard the average is that shard's
state, so the rounds add up to ordinary mini-batch training.

The other plan takes exact steps: a step's gradients are summed over the rows of all tasks, and the driver updates the
weights once. Initial weights and dropout are drawn by hashing numbers and keys, so weights depend on the rows and the
settings, and not on shards or partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.functions.array_quantiles import array_percentiles
from raritas.functions.runtime import cut_lineage, ship_package
from raritas.operators.featuresets import FeatureSet, feature_sets
from raritas.operators.flags import collate_scores
from raritas.operators.iforest import as_list_array
from raritas.operators.lockstep import Lockstep, stack_size
from raritas.operators.sampling import key_hash

LOCAL_EPOCHS = 5
# Networks that one task trains on its shard; the rows of a shard are sent once for as many.
NETWORKS_PER_TASK = 64
# Rows whose layers are computed together when scoring.
SCORED_ROWS = 1024
_MERGE_FAN_IN = 64


@dataclass(frozen=True)
class NetSpec:
    """Shape and training settings of one network."""

    layers: tuple[int, ...]
    epochs: int = 100
    activation: str = "relu"
    batch: int = 32
    inputs: int = 1
    dropout: float = 0.1
    output: str = "sigmoid"
    activity_l2: float = 0.1
    learning_rate: float = 0.001

    def __post_init__(self):
        if self.activation not in ("relu", "tanh") or self.output not in ("sigmoid", "linear"):
            raise ValueError("activation is 'relu' or 'tanh', output 'sigmoid' or 'linear'")
        if not self.layers or min(self.layers) < 1 or self.epochs < 1 or self.batch < 1:
            raise ValueError("layers, epochs and batch must be positive")

    @property
    def widths(self) -> list[int]:
        return [self.inputs, *self.layers, self.inputs]


def initial_weights(spec: NetSpec, rng: np.random.Generator) -> np.ndarray:
    parts = []
    for a, b in zip(spec.widths, spec.widths[1:]):
        limit = math.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
    return np.concatenate(parts)


def _unpack(spec: NetSpec, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in zip(spec.widths, spec.widths[1:]):
        layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def _activate(spec: NetSpec, z: np.ndarray) -> np.ndarray:
    """The activations, in the place of ``z``."""
    if spec.activation == "relu":
        return np.maximum(z, 0.0, out=z)
    z *= 2.0
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1.0
    return np.subtract(1.0, np.divide(2.0, z, out=z), out=z)  # tanh; the exponential is the faster of the two


def _finish(spec: NetSpec, z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) if spec.output == "sigmoid" else z


def reconstruction_error(spec: NetSpec, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distance between each row of ``x`` and its reconstruction, by blocks that stay in the processor's cache."""
    layers, found = _unpack(spec, flat), np.empty(len(x))
    for start in range(0, len(x), SCORED_ROWS):
        block = h = x[start : start + SCORED_ROWS]
        for w, b in layers[:-1]:
            z = h @ w
            z += b
            h = _activate(spec, z)
        w, b = layers[-1]
        found[start : start + SCORED_ROWS] = np.sqrt(((block - _finish(spec, h @ w + b)) ** 2).sum(axis=1))
    return found


def gradient(spec: NetSpec, flat: np.ndarray, x: np.ndarray, rng: np.random.Generator | None) -> np.ndarray:
    """Gradient of mean squared error plus activity penalty; ``rng`` switches dropout on."""
    layers = _unpack(spec, flat)
    inputs, slopes, masks = [x], [], []
    h = x
    for w, b in layers[:-1]:
        a = _activate(spec, h @ w + b)
        slopes.append((a > 0).astype(float) if spec.activation == "relu" else 1.0 - a * a)
        mask = (rng.random(a.shape) >= spec.dropout) * (1.0 / (1.0 - spec.dropout)) if rng is not None and spec.dropout else 1.0
        masks.append((a, mask))
        h = a * mask
        inputs.append(h)
    w, b = layers[-1]
    out = _finish(spec, h @ w + b)
    rows = len(x)
    delta = 2.0 * (out - x) / x.size + 2.0 * spec.activity_l2 * out / rows
    if spec.output == "sigmoid":
        delta = delta * out * (1.0 - out)
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts.append((inputs[i].T @ delta, delta.sum(axis=0)))
        if i:
            a, mask = masks[i - 1]
            back = (delta @ layers[i][0].T) * mask + 2.0 * spec.activity_l2 * a / rows
            delta = back * slopes[i - 1]
    return np.concatenate([piece.ravel() for pair in reversed(parts) for piece in pair])


def fresh_state(spec: NetSpec, rng: np.random.Generator) -> np.ndarray:
    """Initial weights, both moments and the number of steps, in one vector."""
    flat = initial_weights(spec, rng)
    return np.concatenate([flat, np.zeros(2 * len(flat) + 1)])


def train_local(spec: NetSpec, state: np.ndarray, x: np.ndarray, epochs: int, rng: np.random.Generator) -> np.ndarray:
    """Mini-batch Adam over the rows of one shard, from a state to a state."""
    alone = Lockstep(spec, [state])
    for _ in range(epochs):
        alone.epoch([x], [rng])
    return alone.states()[0]


def adam_step(spec: NetSpec, state: np.ndarray, g: np.ndarray) -> None:
    """Update the state by the gradient ``g``, in place."""
    flat, first, second = np.split(state[:-1], 3)
    state[-1] += 1
    step = state[-1]
    first *= 0.9
    first += 0.1 * g
    second *= 0.999
    second += 0.001 * g * g
    rate = spec.learning_rate * math.sqrt(1.0 - 0.999**step) / (1.0 - 0.9**step)
    flat -= rate * first / (np.sqrt(second) + 1e-7)


@dataclass(frozen=True)
class Network:
    """A network to train: each input is a product of attributes, standardised.

    Rows whose fold in a repeat is that of ``skip`` (repeat, fold) are left out. Random numbers are drawn by ``name``:
    networks of one name and shape begin alike, and see the same rows and dropout in the same epoch. ``reads`` are epochs
    before the last at which the weights are wanted, too.
    """

    spec: NetSpec
    inputs: tuple[tuple[int, ...], ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    skip: tuple[int, int] | None = None
    name: tuple[int, ...] = (0,)
    reads: tuple[int, ...] = ()

    def read(self, table: np.ndarray) -> np.ndarray:
        columns = [reduce(np.multiply, [table[:, a] for a in attrs]) for attrs in self.inputs]
        return (np.column_stack(columns) - np.array(self.mean)) / np.array(self.scale)


def train_networks(
    rows: DataFrame,
    networks: list[Network],
    shards: int,
    seed: int = 0,
    local_epochs: int = LOCAL_EPOCHS,
    per_task: int = NETWORKS_PER_TASK,
) -> dict[tuple[int, int], np.ndarray]:
    """Weights by (network, epoch) for the last epoch and all ``reads``; ``rows`` are (shard, folds, _order, v).

    ``v`` is the array of attributes and ``folds`` the row's fold in each repeat. A group is one shard for a block of
    ``per_task`` networks, so rows are sent once per block and never once per network. Groups are dealt out and ordered
    once, each in a partition of its own: by hash some tasks would get several and the others would wait for these. From
    then on only states travel: to the tasks by broadcast, from the second round on, and back through a two-level weighted
    mean, so that no task gathers the states of all shards. Weights read at an epoch are those that training for so many
    epochs would end with.
    """
    spark = rows.sparkSession
    ship_package(spark)
    blocks = math.ceil(len(networks) / per_task)
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
    place = (F.col("block") * shards + F.col("shard")).cast("int")
    dealt = rows.withColumn("block", block).repartitionById(shards * blocks, place)
    sent = cut_lineage(dealt.sortWithinPartitions("block", "shard", "_order", "v").select("block", "shard", "folds", "v"))
    states: dict[int, np.ndarray] = {}
    weights: dict[tuple[int, int], np.ndarray] = {}
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
    for number in range(max(math.ceil(n.spec.epochs / local_epochs) for n in networks)):
        shared = spark.sparkContext.broadcast((states, networks))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, settings = shared.value
            for (block, shard), table, folds in _groups(batches):
                own = range(block * per_task, min(len(settings), (block + 1) * per_task))
                lines = _trained(own, settings, known, table, folds, shard, number * local_epochs, local_epochs, seed)
                columns = [pa.array(values, kind) for values, kind in zip(lines, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["model", "epoch", "shard", "size", "w"])

        trained = sent.mapInArrow(local, "model int, epoch int, shard int, size double, w array<double>")
        states = {}
        for (m, epoch), w in _averaged(trained, shards).items():
            length = weight_count(networks[m].spec)
            if len(w) > length:
                states[m] = w
            if epoch == networks[m].spec.epochs or epoch in networks[m].reads:
                weights[m, epoch] = w[:length]
        shared.unpersist()
    for m, network in enumerate(networks):  # a network without rows stays as it began
        for epoch in {*network.reads, network.spec.epochs}:
            if (m, epoch) not in weights:
                weights[m, epoch] = initial_weights(network.spec, np.random.default_rng([seed, *network.name]))
    return weights


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """(block, shard), attributes and folds of the rows of each group in a partition, which has them one after the other."""
    held = [batch for batch in batches if len(batch)]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    block, shard = (rows[c].to_numpy() for c in ("block", "shard"))
    table, folds = (_matrix(rows[c].combine_chunks()) for c in ("v", "folds"))
    ends = [*(np.flatnonzero((np.diff(block) != 0) | (np.diff(shard) != 0)) + 1), len(rows)]
    for start, end in zip([0, *ends], ends):
        yield (int(block[start]), int(shard[start])), table[start:end], folds[start:end]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // len(lists))


def _trained(
    own: range,
    networks: list[Network],
    known: dict[int, np.ndarray],
    table: np.ndarray,
    folds: np.ndarray,
    shard: int,
    start: int,
    local_epochs: int,
    seed: int,
) -> tuple[list, ...]:
    """Columns (model, epoch, shard, size, w) of the ``own`` networks after the epochs from ``start`` on, over the rows of a group.

    Networks of one shape with as many rows are trained together; those without rows have no line.
    """
    kinds: dict[tuple, list[int]] = {}
    for m in own:
        skip = networks[m].skip
        size = len(table) if skip is None else int(np.count_nonzero(folds[:, skip[0]] != skip[1]))
        if size:
            kinds.setdefault((networks[m].spec, networks[m].reads, size), []).append(m)
    lines: list[tuple] = []
    for (spec, reads, size), alike in kinds.items():
        last, most = min(spec.epochs, start + local_epochs), stack_size(spec)
        for at in range(0, len(alike) if start < last else 0, most):
            some = {m: networks[m] for m in alike[at : at + most]}
            x = [n.read(table if n.skip is None else table[folds[:, n.skip[0]] != n.skip[1]]) for n in some.values()]
            begun = [known[m] if start else fresh_state(spec, np.random.default_rng([seed, *n.name])) for m, n in some.items()]
            together = Lockstep(spec, begun)
            for epoch in range(start, last):
                together.epoch(x, [np.random.default_rng([seed, *n.name, shard, epoch]) for n in some.values()])
                if epoch + 1 in reads or epoch + 1 == last:
                    going_on = epoch + 1 == last < spec.epochs
                    for m, state in zip(some, together.states()):
                        lines.append((m, epoch + 1, shard, float(size), state if going_on else state[: len(state) // 3]))
    return tuple(map(list, zip(*lines))) if lines else ([], [], [], [], [])


def weight_count(spec: NetSpec) -> int:
    return sum((a + 1) * b for a, b in zip(spec.widths, spec.widths[1:]))


def _averaged(trained: DataFrame, shards: int) -> dict[tuple[int, int], np.ndarray]:
    """States per model and epoch, averaged over shards by their sizes."""
    merged = trained
    if shards > 1:
        vectors = trained.select("model", "epoch", "shard", "size", array_to_vector("w").alias("w"))
        slot = F.pmod(F.col("shard"), F.lit(max(1, shards // _MERGE_FAN_IN)))
        partial = vectors.groupBy("model", "epoch", slot.alias("slot")).agg(
            Summarizer.mean(F.col("w"), F.col("size")).alias("w"), F.sum("size").alias("size")
        )
        mean = partial.groupBy("model", "epoch").agg(Summarizer.mean(F.col("w"), F.col("size")).alias("w"))
        merged = mean.select("model", "epoch", vector_to_array("w").alias("w"))
    table = merged.select("model", "epoch", "w").toArrow().combine_chunks()
    places = zip(table["model"].to_pylist(), table["epoch"].to_pylist())
    return {place: np.array(w.values.to_numpy(zero_copy_only=False)) for place, w in zip(places, table["w"])}


# Fixed values of the hash that dropout is drawn by: a prime, and a step for each number that is hashed.
DRAW_PRIME = 2_147_483_647
DRAW_STEPS = {"step": 7919, "layer": 104_729, "unit": 1_299_709, "network": 15_485_863}
DRAW_FACTOR = 48_271
DRAW_DIGITS = 7


class HashedDraws:
    """Draws in [0, 1) for rows and units, layer by layer, by hashing the rows' numbers: a generator for ``gradient``."""

    def __init__(self, rows: np.ndarray, step: int, network: int):
        self.rows = rows + DRAW_STEPS["step"] * step + DRAW_STEPS["network"] * network
        self.layer = 0

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        self.layer += 1
        units = DRAW_STEPS["layer"] * self.layer + DRAW_STEPS["unit"] * np.arange(shape[1])
        x = (self.rows[:, None] + units) % DRAW_PRIME
        for _ in range(2):
            x = (x * x + DRAW_FACTOR * x + 11) % DRAW_PRIME
        return x / DRAW_PRIME


def hashed_weights(spec: NetSpec, seed: int, network: int) -> np.ndarray:
    """Initial weights from the MD5 of ``seed:network:layer:from:to``; biases are 0."""
    parts = []
    for layer, (a, b) in enumerate(zip(spec.widths, spec.widths[1:]), start=1):
        names = [f"{seed}:{network}:{layer}:{i}:{j}" for i in range(a) for j in range(b)]
        share = np.array([int(hashlib.md5(n.encode()).hexdigest()[:13], 16) for n in names]) / 2.0**52
        parts += [math.sqrt(6.0 / (a + b)) * (2.0 * share - 1.0), np.zeros(b)]
    return np.concatenate(parts)


def train_by_gradients(rows: DataFrame, networks: list[Network], steps: int, batches: int = 1, seed: int = 0) -> list[np.ndarray]:
    """Weights of each network after exact Adam steps, from (number, v) rows, ``number`` a hash of the row's key.

    Step t reads the rows whose number is t modulo ``batches``. A task sums the gradients of its rows, Arrow batch by
    batch; the sums of all tasks are added up in two levels, and the driver takes one step. Only weights and gradients
    travel, and the result does not depend on how the rows are dealt out, but for the rounding of sums.
    """
    spark = rows.sparkSession
    ship_package(spark)
    states = []
    for m, network in enumerate(networks):
        flat = hashed_weights(network.spec, seed, m)
        states.append(np.concatenate([flat, np.zeros(2 * len(flat) + 1)]))
    table = rows.select("number", "v").persist()
    try:
        for step in range(steps):
            shared = spark.sparkContext.broadcast(([s[: len(s) // 3] for s in states], networks))
            sums = _gradient_sums(table.where(F.col("number") % batches == step % batches), shared, step)
            for m, (size, total) in sums.items():
                adam_step(networks[m].spec, states[m], total / size)
            shared.unpersist()
    finally:
        table.unpersist()
    return [s[: len(s) // 3] for s in states]


def _gradient_sums(rows: DataFrame, shared, step: int) -> dict[int, tuple[float, np.ndarray]]:
    """Rows and summed gradients of each network."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, networks = shared.value
        size, sums = 0, [np.zeros(len(w)) for w in weights]
        for batch in batches:
            lists = batch.column("v")
            if not len(lists):
                continue
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            numbers = batch.column("number").to_numpy(zero_copy_only=False)
            size += len(values)
            for m, network in enumerate(networks):
                sums[m] += gradient(network.spec, weights[m], network.read(values), HashedDraws(numbers, step, m)) * len(values)
        if size:
            columns = [pa.array(range(len(sums)), pa.int32()), pa.array([float(size)] * len(sums)), pa.array([g.tolist() for g in sums])]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "size", "g"])

    partial = rows.mapInArrow(add_up, "model int, size double, g array<double>")
    slot = F.pmod(F.spark_partition_id(), F.lit(_MERGE_FAN_IN))
    vectors = partial.select("model", slot.alias("slot"), "size", array_to_vector("g").alias("g"))
    half = vectors.groupBy("model", "slot").agg(Summarizer.sum(F.col("g")).alias("g"), F.sum("size").alias("size"))
    whole = half.groupBy("model").agg(Summarizer.sum(F.col("g")).alias("g"), F.sum("size").alias("size"))
    return {r["model"]: (r["size"], r["g"].toArray()) for r in whole.collect()}


def product_features(df: DataFrame, key: str | list[str], attrs: list[str], arity: int) -> DataFrame:
    """Key and the product of every set of ``arity`` attributes, one column ``x_<attrs>`` per set."""
    keys = [key] if isinstance(key, str) else key
    return df.select(
        *keys,
        *[product_of(attrs, s).alias("x_" + "_".join(map(str, s.attrs))) for s in feature_sets(len(attrs), arity, arity)],
    )


def product_of(attrs: list[str], s: FeatureSet) -> Column:
    return reduce(lambda a, b: a * b, [F.col(attrs[a]).cast("double") for a in s.features])


@dataclass
class AutoencoderModel:
    attrs: list[str]
    sets: list[FeatureSet]
    spec: NetSpec
    mean: list[float]
    scale: list[float]
    weights: list[np.ndarray]
    thresholds: dict[int, float] = field(default_factory=dict)
    digits: int | None = None

    def scores_column(self, spark: SparkSession) -> Column:
        """Array of reconstruction errors, one per set in the order of ``sets``, rounded if ``digits`` are given."""
        digits = self.digits
        shared = spark.sparkContext.broadcast((self.spec, [s.features for s in self.sets], self.mean, self.scale, self.weights))

        def score(*columns: pa.Array) -> pa.Array:
            spec, features, mean, scale, weights = shared.value
            table = [c.to_numpy(zero_copy_only=False) for c in columns]
            result = np.empty((len(table[0]), len(features)))
            for i, members in enumerate(features):
                x = reduce(np.multiply, [table[a] for a in members])
                result[:, i] = reconstruction_error(spec, weights[i], ((x - mean[i]) / scale[i])[:, None])
            return as_list_array(result if digits is None else result.round(digits))

        return F.arrow_udf(score, "array<double>")(*[F.col(a).cast("double") for a in self.attrs])

    def scores(self, df: DataFrame, key: str) -> DataFrame:
        """(key, set_id, attrs, score, is_outlier)."""
        info = F.array(
            *[
                F.struct(F.lit(s.set_id).alias("set_id"), F.lit(s.label).alias("attrs"), F.lit(self.thresholds[s.set_id]).alias("t"))
                for s in self.sets
            ]
        )
        scored = df.select(key, self.scores_column(df.sparkSession).alias("_scores"))
        cells = scored.select(key, F.posexplode("_scores").alias("_i", "score")).withColumn("_s", F.get(info, F.col("_i")))
        return cells.select(key, "_s.set_id", "_s.attrs", "score", (F.col("score") > F.col("_s.t")).alias("is_outlier"))

    def flag(self, df: DataFrame) -> DataFrame:
        """The table with ``single_AE``, ``pairs_AE`` and ``triplets_AE``."""
        scored = df.withColumn("_scores", self.scores_column(df.sparkSession))
        cuts = [self.thresholds[s.set_id] for s in self.sets]
        return collate_scores(scored, "_scores", self.sets, cuts, "AE").drop("_scores")


def input_statistics(sample: DataFrame, attrs: list[str], sets: list[FeatureSet]) -> tuple[list[float], list[float]]:
    """Mean and deviation of the product of each set's attributes, in one pass; a deviation of 0 counts as 1."""
    products = [product_of(attrs, s) for s in sets]
    stats = sample.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.avg(p) for p in products]).alias("mean"),
        F.array(*[F.stddev_pop(p) for p in products]).alias("std"),
    ).first()
    if stats["rows"] == 0:
        raise ValueError("the training sample is empty")
    return list(stats["mean"]), [std or 1.0 for std in stats["std"]]


def fit_autoencoder(
    sample: DataFrame,
    key: str,
    attrs: list[str],
    spec: NetSpec,
    contamination: float = 0.1,
    seed: int = 0,
    shards: int = 1,
    local_epochs: int = LOCAL_EPOCHS,
    steps: int | None = None,
    batches: int = 1,
    digits: int | None = None,
) -> AutoencoderModel:
    """Train a network per feature set on ``sample`` and take thresholds from the training errors.

    The sample is dealt out to ``shards`` tasks by a hash of its keys; one task holds one shard, so a large sample needs
    a number of shards to match. Training takes ``epochs / local_epochs`` rounds, whatever their number. With ``steps``
    there are no shards and epochs: so many exact steps are taken, each over one of ``batches`` parts of the sample, and a
    task holds one Arrow batch at a time. ``digits`` rounds errors before they are compared.
    """
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be a share up to one half")
    if shards < 1 or local_epochs < 1 or batches < 1 or (steps is not None and steps < 1):
        raise ValueError("shards, local_epochs, steps and batches must be positive")
    sets = feature_sets(len(attrs))
    mean, scale = input_statistics(sample, attrs, sets)
    networks = [Network(spec, (s.features,), (mean[i],), (scale[i],), name=(i,)) for i, s in enumerate(sets)]
    values = F.array(*[F.col(a).cast("double") for a in attrs]).alias("v")
    if steps is None:
        hashed = key_hash(key, seed + 3)
        shard = F.pmod(F.xxhash64(hashed), F.lit(shards)).cast("int").alias("shard")
        rows = sample.select(shard, F.array().cast("array<int>").alias("folds"), hashed.alias("_order"), values)
        trained = train_networks(rows, networks, shards, seed, local_epochs)
        weights = [trained[m, spec.epochs] for m in range(len(networks))]
    else:
        number = F.conv(F.substring(key_hash(key, seed + 4), 1, DRAW_DIGITS), 16, 10).cast("long").alias("number")
        weights = train_by_gradients(sample.select(number, values), networks, steps, batches, seed)
    model = AutoencoderModel(attrs, sets, spec, mean, scale, weights, digits=digits)
    scored = sample.select(model.scores_column(sample.sparkSession).alias("scores"))
    cuts = array_percentiles(scored, "scores", len(sets), 1 - contamination)
    model.thresholds = {s.set_id: cut for s, cut in zip(sets, cuts, strict=True)}
    return model
