"""Isolation forest over feature sets (Liu, Ting and Zhou, 2008).

Each tree grows from a sub-sample of at most ``psi`` rows, so a forest depends on the settings and not on the size
of the table. Sub-samples are drawn by hashing keys, trees are grown in parallel groups, and the packed forest is
broadcast to score all rows in Arrow batches. The forests of a wide table, with its many sets, never reach the driver:
they are written as a table by blocks of sets, and the tasks that score read block after block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raritas.functions.array_quantiles import array_percentiles
from raritas.functions.runtime import new_folder, open_folder, ship_package, task_count
from raritas.operators.featuresets import FeatureSet
from raritas.operators.flags import collate_scores
from raritas.operators.sampling import key_hash, sample_rows

PSI = 256
AUTO_THRESHOLD = 0.5
_SETS_PER_TASK = 64
_TREES_PER_GROUP = 8
_ROWS_PER_STEP = 1024
# Forests up to this size go through the driver and are broadcast; larger ones stay a table, whose blocks have the
# second size. The third bounds the blocks that a worker keeps in memory.
BROADCAST_BYTES = 128 << 20
BLOCK_BYTES = 32 << 20
KEPT_BYTES = 96 << 20


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def depth_limit(psi: int) -> int:
    return max(1, math.ceil(math.log2(max(psi, 2))))


def subsamples(sample: DataFrame, key: str, attrs: list[str], trees: int, psi: int, seed: int) -> tuple[DataFrame, int]:
    """(forest, tree, _order, attributes): ``psi`` distinct rows per tree, from a pool of at most ``trees * psi`` rows."""
    pool, _, size = sample_rows(sample.select(key, *attrs), key, lambda n: min(n, trees * psi), seed + 1)
    return deal_out(pool.withColumn("forest", F.lit(0)), {0: size}, key, attrs, trees, psi, seed)


def deal_out(
    pool: DataFrame, sizes: dict[int, int], key: str, attrs: list[str], trees: int, psi: int, seed: int
) -> tuple[DataFrame, int]:
    """Deal the pool of each forest out to its trees in blocks of ``psi`` rows, in hash order.

    A pool too small for all trees is shuffled anew, by another hash, for each further deal.
    """
    if not sizes or min(sizes.values()) < 1:
        raise ValueError("the training sample is empty")
    psi = min(psi, min(sizes.values()))

    def per_forest(value) -> Column:
        return F.get(F.array(*[F.lit(value(sizes.get(f, psi))) for f in range(max(sizes) + 1)]), F.col("forest"))

    blocks = per_forest(lambda size: size // psi)
    deals = per_forest(lambda size: math.ceil(trees / (size // psi)))
    dealt = pool.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    salt = F.concat_ws(":", F.lit(""), F.col("forest"), F.col("deal"))
    dealt = dealt.withColumn("_order", F.md5(F.concat(key_hash(key, seed + 2), salt)))
    # A window holds one deal of one pool, whose size is set by the number of trees.
    place = F.row_number().over(Window.partitionBy("forest", "deal").orderBy("_order")) - 1
    dealt = dealt.withColumn("_block", F.floor(place / psi).cast("int"))
    tree = F.col("deal") * blocks + F.col("_block")
    dealt = dealt.where(F.col("_block") < blocks).withColumn("tree", tree.cast("int")).where(F.col("tree") < trees)
    return dealt.select("forest", "tree", "_order", *[F.col(a).cast("double").alias(a) for a in attrs]), psi


def hashed_draws(name: str) -> Callable[[int], tuple[int, float]]:
    """For each node of a tree a whole number and a share in [0, 1), from the MD5 of ``name:node``."""

    def draw(node: int) -> tuple[int, float]:
        digits = hashlib.md5(f"{name}:{node}".encode()).hexdigest()
        return int(digits[:8], 16), int(digits[8:21], 16) / 2.0**52

    return draw


def grow_trees(
    points: np.ndarray, sizes: np.ndarray, limit: int, draws: list[Callable[[int], tuple[int, float]]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees as lines of heap-ordered arrays: split feature, split value, and path length per place at the lowest level.

    ``points`` holds the sub-samples one after the other, ``sizes`` (positive) how many rows each has. A node's draw picks
    one of the features that vary in it and a value between their ends. All nodes of a level of all trees are split
    together; rows stand in the order of their nodes. A branch that ends early keeps going left, so that scoring takes the
    same number of steps for every row.
    """
    trees = len(sizes)
    feature = np.zeros((trees, 2**limit - 1), dtype=np.int32)
    split = np.full((trees, 2**limit - 1), np.inf)
    path = np.zeros((trees, 2**limit), dtype=np.float64)
    average = np.array([average_path(n) for n in range(int(max(sizes, default=0)) + 1)])
    rows, owner, nodes = np.arange(len(points)), np.arange(trees), np.zeros(trees, dtype=np.int64)
    for depth in range(limit + 1):
        if not len(rows):
            break
        inside, starts = points[rows], np.cumsum(sizes) - sizes
        low, high = np.minimum.reduceat(inside, starts, axis=0), np.maximum.reduceat(inside, starts, axis=0)
        usable = (high > low) & (depth < limit)
        width = usable.sum(axis=1)
        ended = width == 0
        path[owner[ended], ((nodes[ended] + 1) << (limit - depth)) - 2**limit] = depth + average[sizes[ended]]
        going = np.flatnonzero(~ended)
        drawn = [draws[tree](node) for tree, node in zip(owner[going].tolist(), nodes[going].tolist())]
        number, share = np.array(drawn).reshape(-1, 2).T
        # the place of the chosen one among the features that vary
        chosen = (usable[going].cumsum(axis=1) > (number.astype(np.int64) % width[going])[:, None]).argmax(axis=1)
        least, most = low[going, chosen], high[going, chosen]
        cut = np.minimum(least + share * (most - least), np.nextafter(most, least))
        feature[owner[going], nodes[going]], split[owner[going], nodes[going]] = chosen, cut
        rows, place = rows[np.repeat(~ended, sizes)], np.repeat(np.arange(len(going)), sizes[going])
        side = 2 * place + (points[rows, chosen[place]] > cut[place])
        rows, sizes = rows[np.argsort(side, kind="stable")], np.bincount(side, minlength=2 * len(going))
        owner, nodes = np.repeat(owner[going], 2), (2 * nodes[going, None] + [1, 2]).ravel()
    return feature, split, path


def grow_tree(points: np.ndarray, limit: int, draw: Callable[[int], tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree: split feature and split value per node, and path length per place at the lowest level."""
    feature, split, path = grow_trees(points, np.array([len(points)]), limit, [draw])
    return feature[0], split[0], path[0]


@dataclass
class PackedTrees:
    """All trees of one feature set, as matrices with one line per tree."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray

    def paths(self, points: np.ndarray) -> np.ndarray:
        """Path length for each row of ``points`` and each tree."""
        trees, inner = self.split.shape
        limit = (inner + 1).bit_length() - 1
        base = np.arange(trees) * inner
        feature, split = self.feature.ravel(), self.split.ravel()
        result = np.empty((len(points), trees))
        for start in range(0, len(points), _ROWS_PER_STEP):
            some = points[start : start + _ROWS_PER_STEP]
            line = np.arange(len(some))[:, None]
            place = np.zeros((len(some), trees), dtype=np.int64)
            for _ in range(limit):
                node = base + place
                place = 2 * place + 1 + (some[line, feature[node]] > split[node])
            result[start : start + _ROWS_PER_STEP] = self.path[np.arange(trees), place - inner]
        return result

    def mean_path(self, points: np.ndarray) -> np.ndarray:
        return self.paths(points).mean(axis=1)

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean path of a one-feature forest as a step function: break points and the value up to each."""
        breaks = np.unique(self.split[np.isfinite(self.split)])
        return breaks, self.mean_path(np.append(breaks, np.inf)[:, None])

    @property
    def nbytes(self) -> int:
        return self.feature.nbytes + self.split.nbytes + self.path.nbytes


def tree_bytes(limit: int) -> int:
    """Bytes of a packed tree of ``limit`` levels: feature and cut per node, path length per place below."""
    return (2**limit - 1) * 12 + 2**limit * 8


def packed_trees(lines: pa.Table) -> dict[int, PackedTrees]:
    """Trees by set from (tree, set_id, feature, split, path) lines."""
    lines = lines.sort_by([("set_id", "ascending"), ("tree", "ascending")])
    numbers = lines["set_id"].to_numpy()
    matrices = [
        np.stack([np.frombuffer(b.as_py(), dtype=kind) for b in lines[name]])
        for name, kind in (("feature", np.int32), ("split", np.float64), ("path", np.float64))
    ]
    bounds = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    return {int(numbers[a]): PackedTrees(*(m[a:b] for m in matrices)) for a, b in zip(bounds, [*bounds[1:], len(numbers)])}


_kept: dict[tuple[str, int], dict[int, PackedTrees]] = {}


def stored_block(folder: str, block: int) -> dict[int, PackedTrees]:
    """The trees of a block of sets, read from the model's table; a worker keeps the blocks it used last."""
    if (folder, block) in _kept:
        _kept[folder, block] = _kept.pop((folder, block))
        return _kept[folder, block]
    store, root = open_folder(f"{folder}/block={block}")
    trees = packed_trees(pq.read_table(root, filesystem=store, columns=["tree", "set_id", "feature", "split", "path"], partitioning=None))
    _kept[folder, block] = trees
    while len(_kept) > 1 and sum(t.nbytes for kept in _kept.values() for t in kept.values()) > KEPT_BYTES:
        del _kept[next(iter(_kept))]
    return trees


@dataclass
class ForestModel:
    """Forests of all sets: ``trees`` by set in memory, or a table in ``folder`` in blocks of ``block_sets`` sets."""

    attrs: list[str]
    sets: list[FeatureSet]
    trees: dict[int, PackedTrees]
    psi: int
    thresholds: dict[int, float] = field(default_factory=dict)
    digits: int | None = None
    folder: str | None = None
    block_sets: int = 0

    def scores_column(self, spark: SparkSession) -> Column:
        """Array of anomaly scores, one per set in the order of ``sets``, rounded if ``digits`` are given."""
        norm, digits, folder, width = average_path(self.psi) or 1.0, self.digits, self.folder, self.block_sets
        features = [(s.set_id, s.features) for s in self.sets]
        steps = {s.set_id: self.trees[s.set_id].steps() for s in self.sets if len(s.features) == 1} if folder is None else {}
        shared = spark.sparkContext.broadcast((features, self.trees, steps))

        def score(*columns: pa.Array) -> pa.Array:
            named, trees, known = shared.value
            table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
            result = np.empty((len(table), len(named)))
            for i, (set_id, members) in enumerate(named):
                if set_id in known:
                    mean = known[set_id][1][np.searchsorted(known[set_id][0], table[:, members[0]], side="left")]
                else:
                    own = trees[set_id] if folder is None else stored_block(folder, i // width)[set_id]
                    mean = own.mean_path(table[:, list(members)])
                result[:, i] = 2.0 ** (-mean / norm)
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
        """The table with ``single_IF``, ``pairs_IF`` and ``triplets_IF``."""
        scored = df.withColumn("_scores", self.scores_column(df.sparkSession))
        cuts = [self.thresholds[s.set_id] for s in self.sets]
        return collate_scores(scored, "_scores", self.sets, cuts, "IF").drop("_scores")

    def hits(self, scores: str, invert_singles: bool = False) -> list[tuple[FeatureSet, Column]]:
        hits = []
        for i, s in enumerate(self.sets):
            hit = F.get(F.col(scores), F.lit(i)) > F.lit(self.thresholds[s.set_id])
            hits.append((s, ~hit if invert_singles and s.arity == 1 else hit))
        return hits


def as_list_array(matrix: np.ndarray) -> pa.Array:
    """One list per line of ``matrix``."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def fit_iforest(
    sample: DataFrame,
    key: str,
    attrs: list[str],
    sets: list[FeatureSet],
    trees: int = 100,
    contamination: float | str = "auto",
    psi: int = PSI,
    seed: int = 42,
    digits: int | None = None,
) -> ForestModel:
    """Grow ``trees`` trees for each set. All sets of a tree number share that tree's sub-sample.

    ``contamination`` is 'auto' (score above 0.5) or the share of the training sample to be flagged. ``digits`` rounds
    scores before they are compared.
    """
    if trees < 1:
        raise ValueError("a forest needs at least one tree")
    if contamination != "auto" and not 0 < contamination <= 0.5:
        raise ValueError("contamination is 'auto' or a share up to one half")
    drawn, psi = subsamples(sample, key, attrs, trees, psi, seed)
    limit = depth_limit(psi)
    size = trees * tree_bytes(limit)
    if len(sets) * size <= BROADCAST_BYTES:
        packed = grow_forest(drawn, attrs, sets, limit, seed)
        model = ForestModel(attrs, sets, {i: t for (_, i), t in packed.items()}, psi, digits=digits)
    else:
        width = max(1, BLOCK_BYTES // size)
        model = ForestModel(attrs, sets, {}, psi, digits=digits, folder=store_forest(drawn, attrs, sets, limit, seed, width), block_sets=width)
    if contamination == "auto":
        model.thresholds = {s.set_id: AUTO_THRESHOLD for s in sets}
    else:
        scored = sample.select(model.scores_column(sample.sparkSession).alias("scores"))
        cuts = array_percentiles(scored, "scores", len(sets), 1 - contamination)
        model.thresholds = {s.set_id: cut for s, cut in zip(sets, cuts, strict=True)}
    return model


def grow_forest(
    drawn: DataFrame, attrs: list[str], sets: list[FeatureSet], limit: int, seed: int
) -> dict[tuple[int, int], PackedTrees]:
    """Forests by (forest, set_id), on the driver: their size is set by the settings and must be known to be small."""
    table = grown_trees(drawn, attrs, sets, limit, seed, _SETS_PER_TASK).toArrow()
    forests = pa.compute.unique(table["forest"]).to_pylist()
    found = {f: packed_trees(table.filter(pa.compute.equal(table["forest"], f))) for f in forests}
    return {(f, i): trees for f, by_set in found.items() for i, trees in by_set.items()}


def store_forest(drawn: DataFrame, attrs: list[str], sets: list[FeatureSet], limit: int, seed: int, block_sets: int) -> str:
    """Write a forest per set as a table, by blocks of ``block_sets`` sets in the order given; returns its folder."""
    folder = new_folder(drawn.sparkSession, "forest")
    grown = grown_trees(drawn, attrs, sets, limit, seed, block_sets)
    blocks = math.ceil(len(sets) / block_sets)
    grown.repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    return folder


def grown_trees(drawn: DataFrame, attrs: list[str], sets: list[FeatureSet], limit: int, seed: int, block_sets: int) -> DataFrame:
    """(block, forest, tree, set_id, feature, split, path) from (forest, tree, _order, attributes) rows.

    One group is some sub-samples and a block of sets; trees over as many features are grown together.
    """
    ship_package(drawn.sparkSession)
    share = F.explode(F.sequence(F.lit(0), F.lit((len(sets) - 1) // block_sets)))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tree", "_order"])
        forest, block = int(rows["forest"].iloc[0]), int(rows["block"].iloc[0])
        table = rows[attrs].to_numpy(dtype=np.float64)
        numbers, sizes = np.unique(rows["tree"].to_numpy(), return_counts=True)
        lines = []
        mine = sets[block * block_sets : (block + 1) * block_sets]
        for arity in sorted({len(s.features) for s in mine}):
            alike = [s for s in mine if len(s.features) == arity]
            points = np.concatenate([table[:, list(s.features)] for s in alike])
            names = [(int(tree), s.set_id) for s in alike for tree in numbers]
            draws = [hashed_draws(f"{seed}:{forest}:{tree}:{set_id}") for tree, set_id in names]
            grown = grow_trees(points, np.tile(sizes, len(alike)), limit, draws)
            lines += [(block, forest, *name, *(x.tobytes() for x in parts)) for name, *parts in zip(names, *grown)]
        return pd.DataFrame(lines, columns=["block", "forest", "tree", "set_id", "feature", "split", "path"])

    schema = "block int, forest int, tree int, set_id int, feature binary, split binary, path binary"
    groups = ["forest", "part", "block"]
    spread = drawn.withColumn("block", share).withColumn("part", F.floor(F.col("tree") / _TREES_PER_GROUP).cast("int"))
    spread = spread.repartition(task_count(drawn.sparkSession), *groups)
    return spread.groupBy(*groups).applyInPandas(grow, schema)
