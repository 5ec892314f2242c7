"""Session helpers: where intermediate tables go, and when a table may be broadcast."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# A table is broadcast only after its rows and bytes were counted and found to be at most this many.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for checkpoints, taking the one the session names.

    A machine-local folder is chosen only for a local master, where driver and executors share one disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="raritas-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Used where a result feeds several jobs: it is computed once and a lost executor costs a re-read, not a re-run.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="raritas-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(root.rglob("*.py")):
            target.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder of its own below the checkpoint folder, which all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path in it, for tasks that read files themselves."""
    for name in ("s3a://", "s3n://"):  # Spark's names of what others call s3
        if uri.startswith(name):
            uri = "s3://" + uri.removeprefix(name)
    return fs.FileSystem.from_uri(uri)


def task_count(spark: SparkSession) -> int:
    """Partitions for few but costly rows, which adaptive execution would otherwise merge into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
