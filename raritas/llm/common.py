"""What several operators share: key projection, sized joins, byte-balanced slices of Arrow batches, shared folders."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.functions.runtime import ensure_checkpoint_dir

# A key table is broadcast only after its rows were counted and found to be at most this many narrow rows.
BROADCAST_ROWS = 500_000
SLICE_BYTES = 8 << 20
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def keyed_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text alone, under fixed names, with a null text as the empty one. Other columns cannot clash."""
    return df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder of its own below the checkpoint folder, which all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results were written: its cleaner acts on what the driver's
    garbage collections find, and these may be far apart."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own whose table a later one has replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(run: Callable) -> Callable:
    """``run`` over a task's batches, after which the worker, which Spark keeps, gives unused memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.util.find_library("c")
            if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
                trim.malloc_trim(0)

    return whole


def keep_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (distinct values, counted; broadcast only when few)."""
    few = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), on, "left_semi")


def unit_interval(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts joined by colons (null: the empty string)."""
    named = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in named])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def slices(table: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of ``text``; a longer row stands alone."""
    column = table.column(text)
    ends = np.cumsum(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < table.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield table.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the bounds of its rows in it (one more than rows)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[first:last], offsets - first


def strings_at(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A string column over ``data`` cut at ``bounds``."""
    return pa.Array.from_buffers(
        pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[first:first + size]`` one after the other, and their bounds."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    take = np.arange(ends[-1]) - np.repeat(ends[:-1] - first, sizes)
    return flat[take], ends


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each row."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
