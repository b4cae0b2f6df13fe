"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the code points 9 to 13.
SPACES = "\t\n\x0b\x0c\r "
#: Bytes of text that one task handles at a time.
CHUNK_BYTES = 4 << 20
#: Rows of a file of a checkpoint of small rows, about.
FILE_ROWS = 50_000
#: Bytes of text that are turned into Python objects or arrays of words at a time.
SLICE_BYTES = 2 << 20


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's shared checkpoint folder; one is made up only where none is set on a single machine, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage through the shared folder, so that lost executors lose nothing.

    `rows`: about how many there are at most, if they are few and cheap to make: they are then written in few files. Each
    file costs time, and on local disks without Hadoop's native library a process.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    return df.checkpoint(eager=True)


#: Scratch folders written so far, for clear_scratch.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear_scratch deletes."""
    ensure_checkpoint_dir(spark)
    _SCRATCH.append(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def scratch(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: for whole texts, where it is smaller than a checkpoint."""
    path = scratch_path(df.sparkSession, "scratch")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How many paths scratch_path has given out and clear_scratch has not deleted."""
    return len(_SCRATCH)


def clear_scratch(spark: SparkSession, since: int, but: str) -> None:
    """Delete what scratch_path has given out since a mark, `but` excepted. Only for callers whose results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in [x for x in _SCRATCH[since:] if x != but]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _SCRATCH.remove(name)


def quoted(name: str) -> Column:
    """A top-level column by its name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column: one aggregate, one number to the driver."""
    return df.agg(F.sum(F.octet_length(quoted(column)).cast("long"))).first()[0] or 0


def parts_for(spark: SparkSession, total_bytes: int, each: int = CHUNK_BYTES) -> int:
    """Enough parts that none exceeds `each` bytes on average, and at least the shuffle's partitions."""
    return max(shuffle_partitions(spark), -(-total_bytes // each), 1)


def grid_parts(spark: SparkSession, total_bytes: int, block: int = 16 << 10, most: int = 256 << 20) -> int:
    """Parts for an exchange in which every part sends a block to every part.

    A part grows with the square root of the input, so that blocks stay near `block` bytes and their number in
    proportion to the input, until a part holds `most` bytes, which a task must be able to hold.
    """
    return parts_for(spark, total_bytes, min(max(CHUNK_BYTES, isqrt(total_bytes * block)), most))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """The batch in slices of about `most` bytes of text; a row is never cut, and no slice is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give a Python worker's free memory back to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def trimmed(function):
    """The function of a group's table, or of two groups' tables, which gives memory back after each group."""
    def one(key, part):
        try:
            return function(key, part)
        finally:
            release_memory()

    def two(key, part, other):
        try:
            return function(key, part, other)
        finally:
            release_memory()

    # Spark counts the parameters
    return one if function.__code__.co_argcount == 2 else two


def fresh(prefix: str = "c") -> str:
    """A column name that clashes with none of the caller's."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"
