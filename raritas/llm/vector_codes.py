"""Vector code compression by member-resident Lloyd: product quantisation whose parts live where their entry lives.

A vector is cut into equal parts, and each part position has a codebook of its own. A row is one part. Rows are dealt by
(position, entry, salt) to files in the shared folder, so the members of an entry are resident with its owner: an owner
sums its members where they are, and only one line of sums per owner travels. A round moves few rows:

* owners' sums are added up over the salts and make the next codebooks (positions x entries lines, broadcast),
* each part is compared with the codebook of its position where it resides, and is written there again,
* of these, the parts that changed their entry alone are shuffled, to the files of their new owner.

The salt is a hash of the row's number and splits the members of an entry, however many rows share it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.functions.runtime import cut_lineage, ship_package
from raritas.llm.common import drop_folder, release, shared_folder, tidied
from raritas.llm.whole_vectors import binary_to_matrix, lists_to_matrix, matrix_to_binary, usable, whole_numbers
from raritas.plans.joins import join_by_counted_key

# Fixed values of the registered query.
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2

# Members of an entry that one salt is to hold, and the least number of salts.
SALT_ROWS = 100_000
LEAST_SALTS = 8
# Distances that one step of a task holds.
_STEP = 1 << 20

_PLACE = ["position", "entry", "salt"]
_COLUMNS = ["rid", *_PLACE, "part"]
_ROW = "rid long, position int, entry int, salt int, part binary"


def nearest_entries(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry for each part; ties go to the lower index."""
    index, error = np.empty(len(parts), dtype=np.int32), np.empty(len(parts), dtype=np.int64)
    step = max(1, _STEP // max(1, codebook.size))
    largest = max(np.abs(parts).max(initial=0), np.abs(codebook).max(initial=0))
    # Below this size products of doubles are exact whole numbers, and a matrix product may be used.
    kind = np.float64 if 4 * int(largest) ** 2 * codebook.shape[1] < 2**52 else np.int64
    entries = codebook.astype(kind)
    lengths = (entries * entries).sum(axis=1)
    for start in range(0, len(parts), step):
        some = parts[start : start + step].astype(kind)
        every = lengths - 2 * (some @ entries.T)  # the part's own square is the same for all entries
        index[start : start + step] = best = every.argmin(axis=1)
        error[start : start + step] = (every[np.arange(len(some)), best] + (some * some).sum(axis=1)).astype(np.int64)
    return index, error


def number_rows(df: DataFrame, key: str, vector: str, label: str | None, scale: int, dimension: int) -> str:
    """The folder of (rid, key, label, v), the vectors kept, written once, so that the numbers hold for good."""
    spark = df.sparkSession
    mark = F.lit(None).cast("int") if label is None else F.col(label)
    given = df.select(F.col(key).alias("key"), mark.alias("label"), F.col(vector).alias("vector"))
    kept = given.where(usable("vector", dimension)).select("key", "label", whole_numbers("vector", scale).alias("whole"))
    ship_package(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix_to_binary(lists_to_matrix(batch.column("whole")))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), v], names=["key", "label", "v"])

    folder = shared_folder(spark, "code-vectors")
    packed = kept.mapInArrow(tidied(pack), kept.drop("whole").schema.add("v", "binary"))
    packed.select(F.monotonically_increasing_id().alias("rid"), "key", "label", "v").write.parquet(folder)
    return folder


def first_codebooks(df: DataFrame, key: str, vector: str, scale: int, parts: int, entries: int, dimension: int) -> np.ndarray:
    """(position, entry, component): the parts of the vectors with the smallest keys, equal keys by components; nulls last."""
    given = df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(usable("vector", dimension))
    whole = given.select("key", whole_numbers("vector", scale).alias("whole"))
    rows = whole.orderBy(F.col("key").asc_nulls_last(), "whole").limit(entries).collect()
    vectors = np.array([r["whole"] for r in rows], dtype=np.int64).reshape(len(rows), parts, dimension // parts)
    return np.ascontiguousarray(vectors.transpose(1, 0, 2))


def vector_dimension(df: DataFrame, key: str, vector: str, parts: int) -> int | None:
    """Components of the usable vector with the smallest key whose number of components the parts divide."""
    given = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    sized = given.where(usable("vector") & (F.size("vector") % parts == 0)).select("key", F.size("vector").alias("n"))
    first = sized.orderBy(F.col("key").asc_nulls_last(), "n").first()
    return first and first["n"]


class Resident:
    """The parts of one round: (rid, position, entry, salt, part), in files by owner."""

    def __init__(self, spark: SparkSession, folders: list[str]):
        self.spark, self.folders = spark, folders

    def read(self) -> DataFrame:
        """Parts that stayed where they were judged, and those that came from elsewhere."""
        stayed, *came = [self.spark.read.parquet(f) for f in self.folders]
        if "nearest" in stayed.columns:
            stayed = stayed.where("nearest = entry")
        tables = [t.select(*_COLUMNS) for t in (stayed, *came)]
        return tables[0].unionAll(tables[1]) if came else tables[0]

    def drop(self) -> None:
        for folder in self.folders:
            drop_folder(self.spark, folder)


def task_number(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def settle(vectors: DataFrame, codebooks: np.ndarray, salts: int) -> Resident:
    """Cut vectors into parts and bring each to the owner of its nearest entry."""
    spark = vectors.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(codebooks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        positions, _, width = books.shape
        for batch in batches:
            whole = binary_to_matrix(batch.column("v"), positions * width)
            for p in range(positions):
                own = whole[:, p * width : (p + 1) * width]
                entry, _ = nearest_entries(own, books[p])
                place = pa.array(np.full(len(own), p, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("rid"), place, pa.array(entry), matrix_to_binary(own)], names=["rid", "position", "entry", "part"])

    rows = vectors.select("rid", "v").mapInArrow(tidied(cut), "rid long, position int, entry int, part binary")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int"))
    folder = shared_folder(spark, "code-parts")
    salted.repartition(task_number(spark), *_PLACE).select(*_COLUMNS).write.parquet(folder)
    return Resident(spark, [folder])


def owners_sums(home: Resident, width: int) -> DataFrame:
    """(position, entry, members, s0, s1, ...): summed over the residents where they are, then over tasks and salts."""
    names = ["members", *(f"s{i}" for i in range(width))]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("position", "entry")]
            owner = (place[0] << 32) + place[1]
            order = np.argsort(owner, kind="stable")
            owners, heads, counts = np.unique(owner[order], return_index=True, return_counts=True)
            if len(owners):
                sums = np.add.reduceat(binary_to_matrix(batch.column("part"), width)[order], heads, axis=0)
                lines = [(owners >> 32).astype(np.int32), (owners & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int64), *sums.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in lines], names=["position", "entry", *names])

    schema = ", ".join(["position int, entry int", *(f"{n} long" for n in names)])
    partial = home.read().select("position", "entry", "part").mapInArrow(tidied(add_up), schema)
    return partial.groupBy("position", "entry").agg(*[F.sum(n).alias(n) for n in names])


def next_codebooks(home: Resident, codebooks: np.ndarray) -> np.ndarray:
    """Each entry as the componentwise floor of its members' mean; entries without members stay."""
    after = codebooks.copy()
    for position, entry, members, *sums in owners_sums(home, codebooks.shape[2]).collect():  # positions x entries lines
        after[position, entry] = [s // members for s in sums]
    return after


def compare(home: Resident, codebooks: np.ndarray) -> DataFrame:
    """The residents with the entry that is nearest now (``nearest``) and their error."""
    shared = home.spark.sparkContext.broadcast(codebooks)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            parts = binary_to_matrix(batch.column("part"), books.shape[2])
            position = batch.column("position").to_numpy(zero_copy_only=False)
            entry, error = np.empty(len(parts), dtype=np.int32), np.empty(len(parts), dtype=np.int64)
            for p in np.unique(position):
                rows = np.flatnonzero(position == p)
                entry[rows], error[rows] = nearest_entries(parts[rows], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(error)], names=[*batch.schema.names, "nearest", "error"])

    return home.read().mapInArrow(tidied(judge), f"{_ROW}, nearest int, error long")


def migrate(home: Resident, codebooks: np.ndarray) -> Resident:
    """The next round's parts: all are judged where they reside, and only those that change their entry are shuffled."""
    spark = home.spark
    judged, moves = shared_folder(spark, "code-parts"), shared_folder(spark, "code-moves")
    compare(home, codebooks).drop("error").write.parquet(judged)
    moved = spark.read.parquet(judged).where("nearest <> entry").withColumn("entry", F.col("nearest")).select(*_COLUMNS)
    moved.repartition(task_number(spark), *_PLACE).write.parquet(moves)
    home.drop()
    return Resident(spark, [judged, moves])


def gather(home: Resident, codebooks: np.ndarray, vectors: DataFrame) -> DataFrame:
    """(key, label, code, error) per vector, from the final comparison of its parts; a code is two hex digits a part."""
    positions = len(codebooks)
    words = [range(start, min(start + 8, positions)) for start in range(0, positions, 8)]

    def word(places: range) -> Column:
        """The indexes of up to eight positions as the bytes of a long, the first one leading."""
        shifted = [F.when(F.col("position") == p, F.shiftleft(F.col("nearest").cast("long"), 8 * (places[-1] - p))) for p in places]
        return F.bit_or(F.coalesce(*shifted, F.lit(0).cast("long")))

    parts = compare(home, codebooks).select("rid", "position", "nearest", "error").groupBy("rid")
    whole = parts.agg(F.sum("error").alias("error"), *[word(w).alias(f"w{i}") for i, w in enumerate(words)])
    digits = [F.lower(F.lpad(F.hex(f"w{i}"), 2 * len(w), "0")) for i, w in enumerate(words)]
    return vectors.select("rid", "key", "label").join(whole, "rid").select("key", "label", F.concat(*digits).alias("code"), "error")


def encode_vectors(
    df: DataFrame, key: str, vector: str, label: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of each vector kept, and the codebooks as (position, entry, component).

    Left out are vectors that are null or empty, hold null or non-finite components, or have another number of components
    than the usable vector with the smallest key whose number ``parts`` divides. Every row counts for itself, also where
    keys or rows repeat. Null keys come last in the order that the codebooks begin with; equal keys go by components. With
    fewer vectors than ``entries`` a codebook has as many entries as there are vectors; an empty table gives an empty
    result. Components beyond 2**27 after scaling, whose squared distances a long could not hold, are an error. Other
    columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = df.sparkSession
    dimension = vector_dimension(df, key, vector, parts)
    if dimension is None:
        nothing = df.select(F.col(key).alias("key"), (F.lit(None).cast("int") if label is None else F.col(label)).alias("label")).where("false")
        return nothing.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), dtype=np.int64)
    numbered = number_rows(df, key, vector, label, scale, dimension)
    vectors = spark.read.parquet(numbered)
    codebooks = first_codebooks(df, key, vector, scale, parts, entries, dimension)
    salts = max(LEAST_SALTS, math.ceil(vectors.count() / SALT_ROWS))
    home = settle(vectors, codebooks, salts)
    for number in range(rounds):
        if number:
            home = migrate(home, codebooks)
        codebooks = next_codebooks(home, codebooks)
        release(spark)
    coded = cut_lineage(gather(home, codebooks, vectors))
    home.drop()
    drop_folder(spark, numbered)
    release(spark)
    return coded, codebooks


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add label_error, the errors summed over equal labels; nulls are equal to each other."""
    marked = coded.withColumn("_mark", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = marked.groupBy("_mark").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return join_by_counted_key(marked, sums, ["_mark"], "_n").drop("_mark")


def query(spark: SparkSession, folder: str) -> DataFrame:
    coded, codebooks = encode_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", "label")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    rows = with_label_error(coded).select(F.col("key").alias("vec_id"), "code", "error", "label_error")
    return rows.withColumn("codebooks_sha256", F.lit(digest))


def _sql() -> str:
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS rid, vec_id, label, w FROM
            (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
                WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)))""",
        f"""part AS MATERIALIZED (SELECT rid, (i - 1) // (len(w) // {PARTS}) AS p, (i - 1) % (len(w) // {PARTS}) AS j, w[i] AS x
            FROM kept, unnest(range(1, len(w) + 1)) AS t(i))""",
        f"b0 AS MATERIALIZED (SELECT rid AS e, p, j, x FROM part WHERE rid < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, p, e, d FROM (SELECT v.rid AS rid, v.p AS p, b.e AS e, sum((v.x - b.x) * (v.x - b.x)) AS d
                FROM part v JOIN b{r} b ON v.p = b.p AND v.j = b.j GROUP BY v.rid, v.p, b.e)
                QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1)"""
        )
        if r < ROUNDS:
            ctes.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT b.e AS e, b.p AS p, b.j AS j, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN
                    (SELECT e, p, j, (s - ((s % n) + n) % n) // n AS x FROM (SELECT a.e AS e, v.p AS p, v.j AS j, sum(v.x) AS s, count(*) AS n
                        FROM part v JOIN a{r} a ON v.rid = a.rid AND v.p = a.p GROUP BY a.e, v.p, v.j)) m ON m.e = b.e AND m.p = b.p AND m.j = b.j)"""
            )
    return f"""WITH {', '.join(ctes)},
        digest AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM b{ROUNDS}),
        coded AS (SELECT rid, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
        SELECT k.vec_id AS vec_id, code, error, (sum(error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256
        FROM kept k JOIN coded c ON c.rid = k.rid, digest"""


SQL = _sql()
