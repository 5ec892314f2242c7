"""Centroid clustering by Shallot search: exact k-means whose vectors keep bounds and the second-nearest centroid.

Vectors are whole numbers, and all comparisons that decide are made on whole squared distances. A vector carries, from
round to round, its centroid, the centroid that was second when it was last searched, an upper bound on its distance to
the first and a lower bound on its distance to any other. Bounds move with the centroids; they are kept a little wider
than rounding can make them wrong. In a round (Borgelt, 2020):

* A vector whose upper bound is below its lower bound, or below half the way from its centroid to the next one, keeps
  its centroid unseen. If the exact distance puts it there, it keeps it too.
* Otherwise the search starts from the closer of its first and second centroid. The others are read in the order of
  their distance from that centroid, as long as this is within the ball of radius (distance to the nearest + distance to
  the second nearest found so far), which shrinks with every better second.

A round is one pass over the vectors in Arrow batches, without a shuffle: a task writes the vectors with their new
states, and one line per centroid with the sums of the vectors that came and left. The lines are added up and move the
centroids. The states of a round are a table in the shared folder, which replaces that of the round before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.functions.runtime import ship_package
from raritas.llm.common import drop_folder, release, shared_folder, tidied
from raritas.llm.whole_vectors import binary_to_matrix, lists_to_matrix, matrix_to_binary, usable, whole_numbers

# Fixed values of the registered query.
DIMENSION = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SALT = 3

# Rows whose distances one step of a task holds.
STEP_ROWS = 8192
# By so much of itself a bound is wider than computed; distances of whole vectors are exact up to their square root.
_SLACK = 1e-9


@dataclass(frozen=True)
class Centroids:
    """Whole centroids with what a round's search needs: neighbours by distance, and how far each has moved."""

    points: np.ndarray
    order: np.ndarray
    apart: np.ndarray
    moved: np.ndarray

    @staticmethod
    def of(points: np.ndarray, before: np.ndarray | None) -> Centroids:
        apart = np.sqrt(squared(points[:, None, :], points[None, :, :]).astype(np.float64))
        order = np.argsort(apart, axis=1, kind="stable")
        # A centroid comes first among its neighbours, also where another stands in the same place.
        for i in range(len(points)):
            order[i] = [i, *(j for j in order[i] if j != i)]
        moved = np.zeros(len(points)) if before is None else np.sqrt(squared(points, before).astype(np.float64))
        return Centroids(points, order, apart, moved)

    @property
    def separation(self) -> np.ndarray:
        """Half the distance from each centroid to the next one."""
        if len(self.points) < 2:
            return np.full(len(self.points), np.inf)
        return self.apart[np.arange(len(self.points)), self.order[:, 1]] / 2

    @property
    def others_moved(self) -> np.ndarray:
        """For each centroid, how far any other has moved at most."""
        moves = np.broadcast_to(self.moved, (len(self.moved), len(self.moved))).copy()
        np.fill_diagonal(moves, 0)
        return moves.max(axis=1)


@dataclass
class States:
    """Per vector: centroid, second centroid, upper bound to the first, lower bound to all others."""

    first: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @staticmethod
    def unknown(rows: int, clusters: int) -> States:
        """States that make the first round search all centroids, beginning with the first two."""
        second = np.full(rows, min(1, clusters - 1), dtype=np.int32)
        return States(np.zeros(rows, dtype=np.int32), second, np.full(rows, np.inf), np.zeros(rows))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors along the last axis."""
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def search(points: np.ndarray, states: States, centroids: Centroids) -> int:
    """Bring the states of one round up to date in place; returns the number of exact distances it took."""
    k, taken = len(centroids.points), 0
    states.upper += centroids.moved[states.first]
    states.lower -= centroids.others_moved[states.first]
    doubtful = np.flatnonzero(states.upper * (1 + _SLACK) >= np.maximum(states.lower, centroids.separation[states.first]) * (1 - _SLACK))
    if k == 1 or not len(doubtful):
        return taken
    near = squared(points[doubtful], centroids.points[states.first[doubtful]])
    taken += len(doubtful)
    states.upper[doubtful] = np.sqrt(near)
    open_ = states.upper[doubtful] * (1 + _SLACK) >= np.maximum(states.lower[doubtful], centroids.separation[states.first[doubtful]]) * (1 - _SLACK)
    rows, near = doubtful[open_], near[open_]
    if not len(rows):
        return taken
    vectors, a, b = points[rows], states.first[rows], states.second[rows]
    far = squared(vectors, centroids.points[b])
    taken += len(rows)
    turn = _before(far, b, near, a)
    centre = np.where(turn, b, a)
    best, second = centre.copy(), np.where(turn, a, b)
    d1, d2 = np.where(turn, far, near), np.where(turn, near, far)
    reach = np.sqrt(d1)  # from the vector to the centre of the search, which stays as it is
    active = np.arange(len(rows))
    for place in range(1, k):
        if not len(active):
            break
        candidate = centroids.order[centre[active], place]
        radius = (reach[active] + np.sqrt(d2[active])) * (1 + _SLACK)
        active_now = centroids.apart[centre[active], candidate] <= radius
        active, candidate = active[active_now], candidate[active_now]
        fresh = (candidate != best[active]) & (candidate != second[active])
        some, found = active[fresh], candidate[fresh]
        if not len(some):
            continue
        d = squared(vectors[some], centroids.points[found])
        taken += len(some)
        wins = _before(d, found, d1[some], best[some])
        runner = ~wins & _before(d, found, d2[some], second[some])
        w, r = some[wins], some[runner]
        second[w], d2[w] = best[w], d1[w]
        best[w], d1[w] = found[wins], d[wins]
        second[r], d2[r] = found[runner], d[runner]
    states.first[rows], states.second[rows] = best, second
    states.upper[rows], states.lower[rows] = np.sqrt(d1), np.sqrt(d2)
    return taken


def _before(d: np.ndarray, number: np.ndarray, other: np.ndarray, other_number: np.ndarray) -> np.ndarray:
    """Closer, or as close under a smaller number."""
    return (d < other) | ((d == other) & (number < other_number))


_STATE = "first int, second int, upper double, lower double, distance long"
_LINE = "centroid int, gained long, sums array<long>, searched long"


def _pass(vectors: DataFrame, centroids: Centroids, started: bool, last: bool) -> DataFrame:
    """The vectors with their states after one more search, and one line per task and centroid.

    ``vectors`` has key, v (whole components as little-endian 32-bit integers) and, if ``started``, the states. Lines have
    a centroid number and say by how many vectors, and by what sums of them, the centroid has grown; vectors that keep
    their centroid are not in them. In the ``last`` pass, which has no lines, vectors get their distances.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(centroids)
    schema = f"key {vectors.schema['key'].dataType.simpleString()}, v binary, {_STATE}, {_LINE}"
    names = ["key", "v", *(field.split()[0] for field in f"{_STATE}, {_LINE}".split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        k, d = known.points.shape
        gained, sums, searched, key_type = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=np.int64), 0, None
        for batch in batches:
            key_type = batch.column("key").type
            for start in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(start, STEP_ROWS)
                points = binary_to_matrix(part.column("v"), d)
                if started:
                    states = States(*(part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("first", "second", "upper", "lower")))
                else:
                    states = States.unknown(len(points), k)
                before = states.first.copy()
                searched += search(points, states, known)
                if last:
                    distance = pa.array(squared(points, known.points[states.first]))
                else:
                    distance = pa.nulls(len(points), pa.int64())
                    left = np.flatnonzero(states.first != before) if started else np.arange(0)
                    come = left if started else np.arange(len(points))
                    for rows, to, sign in ((come, states.first[come], 1), (left, before[left], -1)):
                        gained += sign * np.bincount(to, minlength=k)
                        for c in np.unique(to):
                            sums[c] += sign * points[rows[to == c]].sum(axis=0)
                own = [part.column("key"), part.column("v"), *map(pa.array, (states.first, states.second, states.upper, states.lower)), distance]
                none = [pa.nulls(len(points), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *none], names=names)
        if key_type is not None and not last:
            none = [pa.nulls(k, t) for t in (key_type, pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * d), pa.array(sums.ravel()))
            lines = [pa.array(np.arange(k, dtype=np.int32)), pa.array(gained), lists, pa.array(np.where(np.arange(k) == 0, searched, 0))]
            yield pa.RecordBatch.from_arrays([*none, *lines], names=names)

    return vectors.mapInArrow(tidied(run), schema)


def _gains(lines: DataFrame, clusters: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and sums gained by each centroid: clusters x (dimension + 1) numbers reach the driver."""
    grown = F.concat(F.array("gained"), "sums")
    given = lines.where("centroid is not null").select("centroid", F.posexplode(grown).alias("i", "s"))
    table = np.zeros((clusters, dimension + 1), dtype=np.int64)
    for r in given.groupBy("centroid", "i").agg(F.sum("s").alias("s")).collect():
        table[r["centroid"], r["i"]] = r["s"]
    return table[:, 0], table[:, 1:]


def first_centroids(vectors: DataFrame, clusters: int, salt: int, dimension: int) -> np.ndarray:
    """The vectors with the smallest lowercase-hex SHA-256 of ``salt:key``, in its order; equal keys go by components."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("h"), "whole").orderBy("h", "whole").limit(clusters).collect()
    return np.array([r["whole"] for r in rows], dtype=np.int64).reshape(len(rows), dimension)


def cluster_vectors(
    df: DataFrame, key: str, vector: str, clusters: int, rounds: int, dimension: int, scale: int = SCALE, salt: int = SALT
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of each vector kept, and the final centroids.

    Vectors that are null, have another number of components than ``dimension``, or hold null or non-finite components are
    left out; each component x becomes floor(scale * x). Every row counts for itself, also where keys or whole rows repeat;
    a null key hashes like an empty one. With fewer vectors than ``clusters`` there are as many centroids as vectors, and
    an empty table gives an empty result. Equal distances go to the smaller number. Components beyond 2**27 after
    scaling, whose squared distances a long could not hold, are an error. Other columns are not read.
    """
    spark = df.sparkSession
    given = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    kept = given.where(usable("vector", dimension)).select("key", whole_numbers("vector", scale).alias("whole"))
    points = first_centroids(kept, clusters, salt, dimension)
    if not len(points):
        return given.where("false").select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), points
    current, folder, before = pack(kept), None, None
    members, sums = np.zeros(len(points), dtype=np.int64), np.zeros_like(points)
    for number in range(rounds + 1):
        out = shared_folder(spark, "centroid-states")
        _pass(current, Centroids.of(points, before), folder is not None, number == rounds).write.parquet(out)
        written = spark.read.parquet(out)
        if folder is not None:
            drop_folder(spark, folder)  # this round's table stands by itself
        folder, current, before = out, written.where("centroid is null"), points
        if number < rounds:
            grown = _gains(written, *points.shape)
            members, sums = members + grown[0], sums + grown[1]
            points = np.where(members[:, None] > 0, sums // np.maximum(members, 1)[:, None], points)
    release(spark)
    return current.select("key", F.col("first").alias("cluster"), "distance"), points


def pack(kept: DataFrame) -> DataFrame:
    """(key, v): the whole components as one binary, which passes to and from tasks in one piece."""
    ship_package(kept.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), matrix_to_binary(lists_to_matrix(batch.column("whole")))], names=["key", "v"])

    return kept.mapInArrow(tidied(run), kept.select("key").schema.add("v", "binary"))


def with_inertia(assigned: DataFrame) -> DataFrame:
    """Add cluster_inertia and inertia, the distances summed over each cluster and over all."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a cluster
    per_cluster = {r["cluster"]: int(r["s"]) for r in sums}
    return assigned.withColumn("cluster_inertia", _by_number(per_cluster, "long")).withColumn("inertia", F.lit(sum(per_cluster.values())).cast("long"))


def _by_number(values: dict[int, object], kind: str) -> Column:
    table = F.array(*[F.lit(values.get(c)).cast(kind) for c in range(max(values, default=0) + 1)])
    return F.get(table, F.col("cluster"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    assigned, points = cluster_vectors(table, "vec_id", "embedding", CLUSTERS, ROUNDS, DIMENSION)
    digests = {c: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for c, p in enumerate(points.tolist())}
    rows = with_inertia(assigned).withColumnRenamed("key", "vec_id")
    return rows.withColumn("centroid_sha256", _by_number(digests, "string"))


def _sql() -> str:
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || coalesce(vec_id::VARCHAR, '')), w) - 1 AS rid, vec_id, w
            FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
                WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}))""",
        "part AS MATERIALIZED (SELECT rid, i, w[i] AS x FROM kept, unnest(range(1, " + str(DIMENSION + 1) + ")) AS t(i))",
        f"c0 AS MATERIALIZED (SELECT rid AS c, i, x FROM part WHERE rid < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT p.rid AS rid, c.c AS c, sum((p.x - c.x) * (p.x - c.x)) AS d
                FROM part p JOIN c{r} c ON p.i = c.i GROUP BY p.rid, c.c)
                QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
        )
        if r < ROUNDS:
            ctes.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c AS c, c.i AS i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN
                    (SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT a.c AS c, p.i AS i, sum(p.x) AS s, count(*) AS n
                        FROM part p JOIN a{r} a ON p.rid = a.rid GROUP BY a.c, p.i)) m ON m.c = c.c AND m.i = c.i)"""
            )
    return f"""WITH {', '.join(ctes)},
        digest AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)
        SELECT k.vec_id AS vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
            (sum(a.d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
        FROM kept k JOIN a{ROUNDS} a ON a.rid = k.rid JOIN digest ON digest.c = a.c"""


SQL = _sql()
