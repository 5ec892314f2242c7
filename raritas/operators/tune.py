"""Grid search of forest and autoencoder settings by repeated stratified cross-validation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raritas.functions.array_quantiles import array_percentiles
from raritas.functions.runtime import cut_lineage, task_count
from raritas.operators.autoencoder import NETWORKS_PER_TASK, Network, NetSpec, reconstruction_error, train_networks
from raritas.operators.evaluate import stratified_folds
from raritas.operators.featuresets import FeatureSet
from raritas.operators.iforest import (
    AUTO_THRESHOLD,
    PSI,
    as_list_array,
    average_path,
    deal_out,
    depth_limit,
    grow_forest,
)
from raritas.operators.sampling import key_hash, sample_rows
from raritas.plans.settings import LAYERS

# The searched settings.
FOREST_GRID = (50, 100, 200, 400)
LAYER_GRID = (LAYERS["long"], LAYERS["short"], (4, 1, 4))
EPOCH_GRID = (20, 50, 100)
ACTIVATION_GRID = ("relu", "tanh")
BATCH_GRID = (32, 64, 128)
ACCURACY_DIGITS = 9


def best(results: DataFrame) -> DataFrame:
    """The most accurate candidate; ties go to the one listed first."""
    return results.orderBy(F.desc("accuracy"), "candidate").limit(1)


def _mean_accuracy(fits: DataFrame) -> DataFrame:
    """(candidate, accuracy, fits); rounded, so that equal candidates stay equal whatever order the fits are added in."""
    mean = F.round(F.avg("accuracy"), ACCURACY_DIGITS).alias("accuracy")
    return fits.groupBy("candidate").agg(mean, F.count(F.lit(1)).alias("fits"))


def search_iforest(
    df: DataFrame,
    key: str,
    attrs: list[str],
    label: str,
    trees: Sequence[int] = FOREST_GRID,
    splits: int = 10,
    repeats: int = 10,
    psi: int = PSI,
    seed: int = 1,
) -> DataFrame:
    """(candidate, trees, accuracy, fits): mean accuracy over all folds; ``label`` is 1 for outliers.

    All repeats and folds are one frame: a row has its fold in every repeat, and (repeat, fold) is the number of a
    forest. A forest is grown once at its largest size: its first trees are the smaller candidates. Training reads a
    hash-drawn pool whose size follows from the number of trees; every row is scored by the forests of its folds.
    """
    trees, most = list(trees), max(trees)
    dealt = stratified_folds(df.select(key, *attrs, label), key, label, splits, repeats, seed)
    by_repeat = F.sort_array(F.collect_list(F.struct("repeat", "fold")))
    whole = dealt.groupBy(key, label, *attrs).agg(by_repeat.alias("_f")).select(key, label, *attrs, F.col("_f.fold").alias("folds"))
    folds = cut_lineage(whole.repartition(task_count(df.sparkSession), key))
    pool, _, _ = sample_rows(folds, key, lambda n: min(n, 2 * most * psi), seed)
    # Each pool row trains the forests of all folds but its own.
    others = F.flatten(
        F.transform(
            "folds", lambda own, r: F.transform(F.filter(F.sequence(F.lit(0), F.lit(splits - 1)), lambda f: f != own), lambda f: r * splits + f)
        )
    )
    pool = cut_lineage(pool.withColumn("forest", F.explode(others)).select(key, "forest", *attrs))
    sizes = {r["forest"]: r["n"] for r in pool.groupBy("forest").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn, psi = deal_out(pool, sizes, key, attrs, most, psi, seed)
    whole = FeatureSet(0, tuple(range(len(attrs))), tuple(range(len(attrs))))
    packed = grow_forest(drawn, attrs, [whole], depth_limit(psi), seed)
    norm = average_path(psi) or 1.0
    shared = df.sparkSession.sparkContext.broadcast({f: t for (f, _), t in packed.items()})

    def right(marks: pa.Array, own: pa.Array, *columns: pa.Array) -> pa.Array:
        """Whether each candidate of each repeat judges the row as marked, repeat by repeat."""
        truth, table = marks.to_numpy(zero_copy_only=False), np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        forests = own.flatten().to_numpy(zero_copy_only=False).reshape(len(table), repeats)
        result = np.empty((len(table), repeats * len(trees)))
        for r in range(repeats):
            for f in np.unique(forests[:, r]):
                rows = np.flatnonzero(forests[:, r] == f)
                sums = np.cumsum(shared.value[r * splits + int(f)].paths(table[rows]), axis=1)
                for i, size in enumerate(trees):
                    outlier = 2.0 ** (-sums[:, size - 1] / size / norm) > AUTO_THRESHOLD
                    result[rows, r * len(trees) + i] = outlier == (truth[rows] == 1)
        return as_list_array(result)

    judged = F.arrow_udf(right, "array<double>")(F.col(label), F.col("folds"), *[F.col(a).cast("double") for a in attrs])
    hits = folds.select("folds", F.posexplode(judged).alias("place", "right"))
    repeat = F.floor(F.col("place") / len(trees)).cast("int")
    per_fold = (
        hits.select((F.col("place") % len(trees)).alias("candidate"), repeat.alias("repeat"), F.get("folds", repeat).alias("fold"), "right")
        .groupBy("candidate", "repeat", "fold")
        .agg(F.avg("right").alias("accuracy"))
    )
    sizes_of = F.array(*map(F.lit, trees))
    scored = _mean_accuracy(per_fold)
    return scored.select("candidate", F.get(sizes_of, F.col("candidate")).alias("trees"), "accuracy", "fits")


@dataclass(frozen=True)
class NetGrid:
    layers: Sequence[tuple[int, ...]] = LAYER_GRID
    epochs: Sequence[int] = EPOCH_GRID
    activations: Sequence[str] = ACTIVATION_GRID
    batches: Sequence[int] = BATCH_GRID

    def specs(self, inputs: int) -> list[NetSpec]:
        chosen = product(self.layers, self.epochs, self.activations, self.batches)
        return [NetSpec(tuple(shape), e, a, b, inputs) for shape, e, a, b in chosen]


def search_autoencoder(
    df: DataFrame,
    key: str,
    attrs: list[str],
    label: str,
    grid: NetGrid = NetGrid(),
    splits: int = 10,
    repeats: int = 3,
    contamination: float = 0.1,
    seed: int = 1,
    shards: int = 1,
    fit_rows: int | None = None,
) -> DataFrame:
    """(candidate, layers, epochs, activation, batch, accuracy, fits); ``label`` is 1 for outliers.

    One network per shape, activation, batch size and fold reads all attributes at once and is trained for the most epochs;
    the candidates with fewer are its weights on the way, which are those that training for so many would give. A task
    trains some networks on its shard of the rows, each on those outside its fold. ``fit_rows`` bounds the rows that weights
    are fitted on, drawn by a hash of their keys. Folds, standardisation, cuts and accuracy are those of all labelled
    rows, whatever it is; no row is written once per network.
    """
    specs = grid.specs(len(attrs))
    numbers = [F.col(a).cast("double").alias(a) for a in attrs]
    dealt = stratified_folds(df.select(key, label, *numbers), key, label, splits, repeats, seed)
    by_repeat = F.sort_array(F.collect_list(F.struct("repeat", "fold")))
    whole = dealt.groupBy(key, label, *attrs).agg(by_repeat.alias("_f")).select(key, label, *attrs, F.col("_f.fold").alias("folds"))
    folds = cut_lineage(whole.repartition(task_count(df.sparkSession), key))
    statistics = _outside_statistics(folds, attrs, splits, repeats)
    trained, longest = [], max(grid.epochs)
    reads = tuple(e for e in grid.epochs if e < longest)
    inputs = tuple((i,) for i in range(len(attrs)))
    models: dict[tuple, int] = {}
    for shape in specs:
        kind = (shape.layers, shape.activation, shape.batch)
        if kind not in models:
            models[kind] = len(models)
            for place in product(range(repeats), range(splits)):
                mean, scale = statistics[place]
                trained.append(Network(replace(shape, epochs=longest), inputs, mean, scale, place, (models[kind], *place), reads))
    hashed = key_hash(key, seed)
    fitted = folds if fit_rows is None else sample_rows(folds, key, lambda n: min(n, fit_rows), seed)[0]
    rows = fitted.select(F.pmod(F.xxhash64(hashed), F.lit(shards)).cast("int").alias("shard"), "folds", hashed.alias("_order"), F.array(*attrs).alias("v"))
    # Networks are spread over the tasks that can run at once; few rows are sent to many of them.
    per_task = max(1, min(NETWORKS_PER_TASK, len(trained) * shards // (2 * task_count(df.sparkSession))))
    weights = train_networks(rows, trained, shards, seed, longest, per_task)
    per_fold = repeats * splits
    read_off = []
    for s in specs:
        first = models[s.layers, s.activation, s.batch] * per_fold
        read_off += [(trained[first + place], weights[first + place, s.epochs]) for place in range(per_fold)]
    hits = _judge(folds, attrs, label, read_off, len(specs), splits, repeats, contamination)
    scored = _mean_accuracy(hits.select("candidate", (F.col("right") / F.col("rows")).alias("accuracy")))
    described = F.array(
        *[
            F.struct(
                F.lit("-".join(map(str, s.layers))).alias("layers"),
                F.lit(s.epochs).alias("epochs"),
                F.lit(s.activation).alias("activation"),
                F.lit(s.batch).alias("batch"),
            )
            for s in specs
        ]
    )
    return scored.withColumn("_s", F.get(described, F.col("candidate"))).select("candidate", "_s.*", "accuracy", "fits")


def _outside_statistics(
    folds: DataFrame, attrs: list[str], splits: int, repeats: int
) -> dict[tuple[int, int], tuple[tuple[float, ...], tuple[float, ...]]]:
    """Mean and deviation of the attributes over the rows outside each (repeat, fold), put together from the folds' own.

    Rows are read once per repeat; counts, means and squared deviations of all folds but one are merged on the driver.
    """
    own = folds.select(*attrs, F.posexplode("folds").alias("repeat", "fold")).groupBy("repeat", "fold")
    measures = [f(a).alias(f"{n}{i}") for i, a in enumerate(attrs) for n, f in (("mean", F.avg), ("var", F.var_pop))]
    found = {(r["repeat"], r["fold"]): r for r in own.agg(F.count(F.lit(1)).alias("rows"), *measures).collect()}
    result = {}
    for repeat, fold in product(range(repeats), range(splits)):
        rest = [found[repeat, f] for f in range(splits) if f != fold and (repeat, f) in found]
        size = sum(r["rows"] for r in rest)
        mean = [sum(r["rows"] * r[f"mean{i}"] for r in rest) / max(1, size) for i in range(len(attrs))]
        var = [sum(r["rows"] * (r[f"var{i}"] + (r[f"mean{i}"] - mean[i]) ** 2) for r in rest) / max(1, size) for i in range(len(attrs))]
        result[repeat, fold] = (tuple(mean), tuple(math.sqrt(v) or 1.0 for v in var))
    return result


def _judge(
    folds: DataFrame,
    attrs: list[str],
    label: str,
    networks: list[tuple[Network, np.ndarray]],
    candidates: int,
    splits: int,
    repeats: int,
    contamination: float,
) -> DataFrame:
    """(candidate, repeat, fold, right, rows): rows of a fold that the network trained without it judges as labelled.

    ``networks`` go by candidate, repeat and fold. A network's cut is the percentile of its errors on the other folds' rows.
    """
    spark = folds.sparkSession
    shared = spark.sparkContext.broadcast(networks)

    def errors(own: pa.Array, *columns: pa.Array) -> pa.Array:
        """Errors of all networks; null for the rows that a network is judged by."""
        table, mine = _matrix(columns), _fold_matrix(own, repeats)
        found = np.column_stack([reconstruction_error(n.spec, w, n.read(table)) for n, w in shared.value])
        hidden = np.zeros(found.shape, dtype=bool)
        for m in range(found.shape[1]):
            hidden[:, m] = mine[:, m // splits % repeats] == m % splits
        offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel(), mask=hidden.ravel()))

    outside = folds.select(F.arrow_udf(errors, "array<double>")(F.col("folds"), *map(F.col, attrs)).alias("errors"))
    cuts = array_percentiles(outside, "errors", len(networks), 1 - contamination)
    limits = spark.sparkContext.broadcast([float("inf") if c is None else c for c in cuts])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, rows = np.zeros(len(limits.value), dtype=np.int64), np.zeros(len(limits.value), dtype=np.int64)
        for batch in batches:
            table, mine = _matrix([batch.column(a) for a in attrs]), _fold_matrix(batch.column("folds"), repeats)
            truth = batch.column(label).to_numpy(zero_copy_only=False)
            for m, (network, weights) in enumerate(shared.value):
                own = np.flatnonzero(mine[:, m // splits % repeats] == m % splits)
                outlier = reconstruction_error(network.spec, weights, network.read(table[own])) > limits.value[m]
                right[m] += np.count_nonzero(outlier == (truth[own] == 1))
                rows[m] += len(own)
        seen = np.flatnonzero(rows)
        lines = [seen // (splits * repeats), seen // splits % repeats, seen % splits, right[seen], rows[seen]]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in lines], names=["candidate", "repeat", "fold", "right", "rows"])

    given = folds.select("folds", F.col(label).cast("int").alias(label), *attrs)
    counted = given.mapInArrow(count, "candidate long, repeat long, fold long, right long, rows long")
    summed = counted.groupBy("candidate", "repeat", "fold").agg(F.sum("right").alias("right"), F.sum("rows").alias("rows"))
    return summed.withColumn("candidate", F.col("candidate").cast("int"))


def _matrix(columns: Sequence[pa.Array]) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])


def _fold_matrix(own: pa.Array, repeats: int) -> np.ndarray:
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), repeats)
