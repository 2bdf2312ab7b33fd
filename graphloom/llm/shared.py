"""What the operators of this subpackage have in common: durable intermediate tables and word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word: a maximal run of characters other than the six ASCII spaces. bytes.split() without arguments splits at
#: exactly those six, so Python code uses that on UTF-8 bytes and Spark code uses this pattern.
WORD = r"[^\x20\x09-\x0D]+"


def _lean_allocator() -> None:
    """Has arrays of a megabyte or more go back to the system when they are freed.

    By default the C library raises that threshold with each large array, and a worker that Spark uses again for other
    stages keeps what the largest of them took. Elsewhere than on glibc nothing is set.
    """
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 2)  # M_ARENA_MAX
    except (OSError, AttributeError):
        pass


_lean_allocator()

#: What operators remember in this process from task to task, and how it is emptied.
_memos: dict[str, Callable[[], object]] = {}


def memo(name: str, empty: Callable[[], object]) -> None:
    """Has ``makes_room`` empty this memo."""
    _memos[name] = empty


def makes_room(but: str = "") -> None:
    """Empties all memos of this process but one and gives what is unused back to the system.

    Spark uses a worker again for the tasks of other operators; each begins with this, so that what the ones before
    remembered doesn't add up.
    """
    for name, empty in _memos.items():
        if name != but:
            empty()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a
    temporary folder, and a cluster, whose machines share none, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, survives lost executors.

    The files go when the application ends, or earlier by ``discard``. The shuffles that led to the table are garbage
    once it stands; collecting it lets Spark's cleaner remove their files now and not when the driver next runs short.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _fs(spark, path, "deleteOnExit")
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(path)
    back._graphloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by ``written`` that no later plan reads."""
    if path := getattr(df, "_graphloom_path", None):
        _fs(df.sparkSession, path, "delete")


def _fs(spark: SparkSession, path: str, method: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at, True) if method == "delete" else fs.deleteOnExit(at)


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batch, in order, in slices of about ``most`` bytes of ``column`` (a longer row goes alone)."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
