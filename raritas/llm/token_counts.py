"""Token counts: texts are encoded in batches inside Arrow functions, and only lengths come back.

Batches hold about ``slice_bytes`` of text whatever the rows are. Texts, long ones included, are split at safe
boundaries: a single blank between two characters that are neither blanks nor the library's blank mark. No piece of the
vocabulary holds the mark after another character (checked when the model is loaded), so no merge crosses such a blank,
and the mark that the library puts before a text is the one the blank stands for. Each distinct part is encoded once
per batch.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raritas.functions.runtime import ship_package
from raritas.llm.common import SLICE_BYTES, keyed_text, slices, strings_at, sums_by_row, text_bytes, tidied

MARK = "▁"
LIMIT = 4096
_models: dict[str, tuple] = {}


def piece_model(path: str):
    """The model at ``path`` (or shipped with the job under its name), and whether texts may be split for it."""
    if path not in _models:
        import sentencepiece

        own = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        model = sentencepiece.SentencePieceProcessor(model_file=own)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        plain = all(MARK not in piece.lstrip(MARK) for piece in pieces)
        probe = "a b  c\td e Ａ x"  # a model that rewrites blanks or adds none in front is not split
        whole = model.encode(probe, out_type=str)
        parts = [*model.encode("a", out_type=str), *model.encode("b  c\td e", out_type=str), *model.encode("Ａ", out_type=str), *model.encode("x", out_type=str)]
        _models[path] = model, plain and whole == parts
    return _models[path]


def safe_cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the blanks that texts may be split at."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    at = at[(before > 0x20) & (after > 0x20)]
    mark = MARK.encode()
    tail = np.maximum(at - 2, 0)
    marked = (data[np.maximum(at - 3, 0)] == mark[0]) & (data[tail] == mark[1]) & (data[at - 1] == mark[2])
    ahead = np.minimum(at[:, None] + np.arange(1, 4), len(data) - 1)
    marked |= (data[ahead] == np.frombuffer(mark, dtype=np.uint8)).all(axis=1)
    at = at[~marked]
    first, last = bounds[:-1], bounds[1:] - 1  # blanks at the ends of a row stay
    return at[~(np.isin(at, first) | np.isin(at, last))]


def split_parts(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All parts of all rows, and the bounds of each row among the parts."""
    cuts = safe_cuts(data, bounds)
    edges = np.sort(np.concatenate((bounds, cuts)), kind="stable")
    dropped = np.searchsorted(cuts, edges)  # blanks taken out before each edge
    parts = strings_at(np.delete(data, cuts), edges - dropped)
    row_bounds = np.arange(len(bounds)) + np.searchsorted(cuts, bounds)
    return parts, row_bounds


def lengths(model, splittable: bool, column: pa.Array) -> np.ndarray:
    """Tokens of each text of a column."""
    data, bounds = text_bytes(column)
    if splittable:
        parts, rows = split_parts(data, bounds)
    else:
        parts, rows = strings_at(data, bounds), np.arange(len(bounds))
    coded = parts.dictionary_encode()
    words = coded.dictionary.to_pylist()
    sizes = np.fromiter((len(ids) for ids in model.encode(words, num_threads=1)), dtype=np.int64, count=len(words))
    per_part = sizes[coded.indices.to_numpy(zero_copy_only=False)] if len(parts) else np.zeros(0, dtype=np.int64)
    return sums_by_row(per_part, rows)


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Return key, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) for every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null keys are kept as they are.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, splittable = piece_model(model_path)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                tokens = lengths(model, splittable, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), pa.array(tokens)], names=["key", "n_bytes", "n_tokens"])

    given = keyed_text(docs, key, text).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = given.drop("text").schema.add("n_tokens", "long")
    counted = given.mapInArrow(tidied(run), schema)
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, folder: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
