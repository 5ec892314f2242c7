"""Token-ID files: Parquet with a list column of ids, ordered by document, and reads of chosen columns and documents.

Layout: rows ascend by key within a file and from file to file. Columns are key, n_tokens, ids. Row groups and pages are
small and of set sizes; ids are dictionary-encoded (a vocabulary of 49k makes indexes of 16 bits); keys and counts are
delta-encoded (format version 2 without a dictionary); page indexes are written, so a filter on the key reads only the
pages that can hold it, and counts are read without touching ids.

Words are encoded once per batch: texts are cut at ASCII white space, and before ASCII punctuation that follows a Latin or
Cyrillic letter, where the tokenizer's own pattern always ends a piece; the parts are encoded and put together again.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from raritas.functions.runtime import ship_package
from raritas.llm.common import SPACES, gather, keyed_text, shared_folder, slices, strings_at, text_bytes, tidied

END_ID = 1
SLICE_BYTES = 8 << 20
# What a worker remembers between batches and tasks: distinct parts, and the bytes of their letters and ids. Beyond
# either, the half met in fewer batches is forgotten; such parts are encoded again when they return.
MEMORY_PARTS = 250_000
MEMORY_BYTES = 16 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000

LETTER = np.zeros(256, dtype=bool)
LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
CLOSING = np.zeros(256, dtype=bool)
CLOSING[list(b".,;:!?#%&$*()")] = True
# Letters of two bytes, by their first and second: U+00C0 to U+027F and U+0400 to U+047F without the signs of multiplication
# and division, and without U+0130, which the lower case ends in a mark.
LETTER_OF_TWO = np.zeros((256, 256), dtype=bool)
LETTER_OF_TWO[[*range(0xC3, 0xCA), 0xD0, 0xD1], 0x80:0xC0] = True
LETTER_OF_TWO[[0xC3, 0xC3, 0xC4], [0x97, 0xB7, 0xB0]] = False
_coders: dict[str, PartCoder] = {}


class PartCoder:
    """Ids of parts by a tokenizer file, remembered from batch to batch.

    Parts of letters alone are one piece of the tokenizer's pattern and end in one id that carries the end-of-word mark, so
    many of them are encoded as one text and told apart by these ids; other parts are encoded one by one. The memory is
    arrays, not objects: a part's letters, where its ids stand, and in how many batches it was met.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        own = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        self.tokenizer = Tokenizer.from_file(own)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.parts = pa.array([], pa.large_string())
        self.flat = np.zeros(0, dtype=np.int32)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int32)

    def forget_rarer(self) -> None:
        """Keep the half of the parts that was met in more batches, of equal ones the younger; older meetings count half."""
        kept = np.sort(np.argsort(self.met, kind="stable")[(len(self.met) + 1) // 2 :])
        self.parts, self.met = self.parts.take(pa.array(kept)), self.met[kept] // 2
        self.flat, bounds = gather(self.flat, self.first[kept], self.size[kept])
        self.first, self.size = bounds[:-1], np.diff(bounds)

    def encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in one array, where in it those of each of the distinct parts begin, and how many they are."""
        places = pa.compute.index_in(parts, value_set=self.parts).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = places < 0
        places[unknown] = np.arange(len(self.parts), len(self.parts) + np.count_nonzero(unknown))
        new = parts.filter(pa.array(unknown))
        ids, first, size = self._encode_new(new.to_pylist())
        self.parts = pa.concat_arrays([self.parts, new])
        self.first = np.concatenate((self.first, len(self.flat) + first))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, ids))
        self.met = np.concatenate((self.met, np.zeros(len(new), dtype=np.int32)))
        self.met[places] += 1
        coded = self.flat, self.first[places], self.size[places]
        while len(self.parts) > MEMORY_PARTS or len(self.parts) and text_bytes(self.parts)[1][-1] + self.flat.nbytes > MEMORY_BYTES:
            self.forget_rarer()
        return coded

    def _encode_new(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, rest = [], []
        for i, part in enumerate(parts):
            (words if part.isalpha() else rest).append(i)
        chunks, sizes = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        runs = [[parts[i] for i in words[start : start + 512]] for start in range(0, len(words), 512)]
        for start in range(0, len(runs), 8):
            some = runs[start : start + 8]
            for run, coded in zip(some, self.tokenizer.encode_batch_fast([" ".join(r) for r in some], add_special_tokens=False), strict=True):
                ids = np.array(coded.ids, dtype=np.int32)
                ends = np.flatnonzero(self.ends_word[ids])
                # Each part has a piece at least, so that as many pieces as parts are one of each.
                if len(ends) == len(run) and ends[-1] == len(ids) - 1:
                    chunks.append(ids)
                    sizes.append(np.diff(ends, prepend=-1))
                else:
                    self._singly(run, chunks, sizes)
        self._singly([parts[i] for i in rest], chunks, sizes)
        added = np.concatenate(sizes)
        first, size = np.empty_like(added), np.empty_like(added)
        order = np.array(words + rest, dtype=np.int64)
        first[order], size[order] = np.cumsum(added) - added, added
        return np.concatenate(chunks), first, size

    def _singly(self, parts: list[str], chunks: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        for start in range(0, len(parts), 4096):
            lists = [x.ids for x in self.tokenizer.encode_batch_fast(parts[start : start + 4096], add_special_tokens=False)]
            chunks.append(np.fromiter((i for ids in lists for i in ids), dtype=np.int32))
            sizes.append(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))


def coder(path: str) -> PartCoder:
    if path not in _coders:
        _coders[path] = PartCoder(path)
    return _coders[path]


def word_parts(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of all rows without the white space between them, and the bounds of each row among the parts."""
    blank = SPACES[data]
    if len(data) and not np.any((data[:-1] == 0x3C) & (data[1:] == 0x7C)):  # no "<|": no special token can arise
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[:-1] &= data[1:] < 0x80  # a combining mark may follow and make one letter of both
        data = data + (upper.view(np.uint8) << 5)
    shown = ~blank
    starts = shown.copy()
    if len(data) > 1:
        closing = CLOSING[data[1:]]
        starts[1:] &= blank[:-1] | (closing & LETTER[data[:-1]])
        after = np.flatnonzero(closing & (data[:-1] >= 0x80)) + 1
        after = after[after > 1]
        starts[after[LETTER_OF_TWO[data[after - 2], data[after - 1]]]] = True
    heads = bounds[:-1][bounds[:-1] < len(data)]
    starts[heads] |= shown[heads]
    edges = np.flatnonzero(starts[shown])  # parts begin at no blank, so these are their places without the blanks
    begin = np.flatnonzero(starts)
    data = data[shown]
    return strings_at(data, np.append(edges, len(data))), np.searchsorted(begin, bounds)


def token_ids(code: PartCoder, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column in one array, and the bounds of each text in it."""
    parts, rows = word_parts(*text_bytes(column))
    coded = parts.dictionary_encode()
    flat, first, sizes = code.encode(coded.dictionary)
    which = coded.indices.to_numpy(zero_copy_only=False)
    ids, ends = gather(flat, first[which], sizes[which])
    return ids, ends[rows]


def encode_texts(docs: DataFrame, tokenizer_path: str, key: str, text: str, end_id: int | None) -> DataFrame:
    """Columns key, ids (array<int>): the whole text's ids, then ``end_id`` if given. A null text is empty."""
    ship_package(docs.sparkSession)
    given = keyed_text(docs, key, text)
    schema = given.drop("text").schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, bounds = token_ids(code, part.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "ids"])

    return given.mapInArrow(tidied(run), schema)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID
) -> str:
    """Write one row per document to Parquet files below ``folder`` and return it.

    Documents are dealt by ranges of the key and sorted, null keys first, then by text, so repeated keys and rows have a
    fixed order. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = docs.select(key, text).repartitionByRange(parts, F.col(key)).sortWithinPartitions(key, text)
    coded = encode_texts(ordered, tokenizer_path, key, text, end_id)
    rows = coded.select("key", F.size("ids").cast("long").alias("n_tokens"), "ids")
    (
        rows.write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("compression", "zstd")
        .parquet(folder)
    )
    return folder


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``start`` to rows with file, row and n_tokens: the ids of all documents before it in the files.

    It comes from the counts alone: sums per file, a running sum over the files (as many rows as files), and running
    sums within each file in the order of its rows. Files are in the order of their part numbers, which Spark writes with
    five digits at least, and of their names where one task wrote several.
    """
    totals = files.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("in_file"))
    number = F.regexp_extract("file", r"part-(\d+)", 1)
    earlier = Window.orderBy(F.length(number), number, "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("in_file").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    return rows.withColumn("inside", inside).join(F.broadcast(bases), "file").withColumn("start", F.col("base") + F.col("inside"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Columns key, n_tokens, ids, and file and row that say where each stands; only those selected are read."""
    files = spark.read.parquet(folder)
    return files.select("key", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def ids_checksum(files: DataFrame) -> DataFrame:
    """Add n_read (length) and ids_crc32 (unsigned CRC-32 of the ids as little-endian 32-bit integers); drop ids."""
    ship_package(files.sparkSession)
    rest = [c for c in files.columns if c != "ids"]
    schema = files.select(*rest).schema.add("n_read", "long").add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8)
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
                names=[*rest, "n_read", "ids_crc32"],
            )

    return files.mapInArrow(tidied(run), schema)


def token_digests(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Read the files back: key, start, n_tokens, ids_crc32 per document, the last two from the ids themselves."""
    summed = ids_checksum(read_token_files(spark, folder).drop("n_tokens")).withColumnRenamed("n_read", "n_tokens")
    placed = with_starts(summed, spark.read.parquet(folder))  # narrow rows are shuffled, ids never
    return placed.select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = shared_folder(spark, "token-ids")
    write_token_files(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, out)
