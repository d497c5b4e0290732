"""What the operators of this subpackage share: intermediate tables, row keys and word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a worker turns into Python objects at a time.
SLICE_BYTES = 5_000_000

#: Bytes of rows that cross to Python in one Arrow batch of the pipeline, a longer row alone.
BATCH_BYTES = 2_000_000
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, or fewer if it has fewer.

    By default a batch has up to 10,000 rows whatever their size, some 25 MB of documents, which the executor
    holds outside its heap and each worker in its own memory, for every task at once.
    """
    now = spark.conf.get(BATCHES, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset a temporary folder serves, in local mode only: executors on other machines
    could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="textwarden-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage, runs costly stages once where several consumers follow, and survives
    lost executors. Shuffle files go as soon as the table is written; the tables go by ``discard`` or
    when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textwarden-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and nothing reads any more."""
    for table in tables:
        _written.remove((table.sparkSession, table._written_to))
        _delete(table.sparkSession, table._written_to)


def temporary(spark: SparkSession, name: str) -> str:
    """A folder's name in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/textwarden-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; its folder is then the caller's to clear
            return


def _trim() -> None:
    """Gives memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidied(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves little behind: workers live on for later tasks and stages.

    Collections pause while it runs, as millions of small strings and arrays hold no cycles; what tasks
    do leave in cycles, their functions above all, goes at the end.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from batches(it)
        finally:
            gc.enable()
            _trim()

    return run


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes of text, a longer text alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(size):
        yield start, len(size)
