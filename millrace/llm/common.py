"""Helpers shared by the operators: Arrow slices, text as bytes, lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.partitions import spread

#: Bytes of text that a Python worker takes at a time out of an Arrow batch.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def byte_slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The values of a string array as UTF-8 bytes (null: empty), in runs of about ``most`` bytes."""
    if isinstance(arr, pa.ChunkedArray):
        for chunk in arr.chunks:
            yield from byte_slices(chunk, most)
        return
    arr = arr.cast(pa.large_binary())
    start, size = 0, 0
    lengths = [x or 0 for x in pa.compute.binary_length(arr).to_pylist()]
    for i, n in enumerate(lengths):
        size += n
        if size >= most or i + 1 == len(lengths):
            yield [x or b"" for x in arr.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over batches, after which the worker, which lives on for other tasks, gives its free memory back."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return run


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_BYTES at most, so that a worker's memory does not follow its rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sql(f"SET {key}").first()["value"].rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, the context's own, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared folder, compressed."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(key: Column, buckets: int) -> Column:
    """crc32 of the decimal text of an integer key, modulo ``buckets``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(buckets)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table; small ones of texts are dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "pages") else df


#: A key is hot if it has more than 1 / HOT_KEYS of all rows, so there are fewer than HOT_KEYS; below HOT_ROWS rows a task takes any.
HOT_KEYS, HOT_ROWS = 1000, 1000


def met(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Inner join of stored ``rows`` with ``values``, one row for each key: hot keys' values are broadcast, so that their rows
    stay where they are and no task gets all of them; other keys are shuffled."""
    sizes = rows.groupBy(key).count()
    least = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = [r[0] for r in sizes.filter(F.col("count") > least).select(key).collect()]
    if not hot:
        return rows.join(values, key)
    some = F.col(key).isin(hot)
    return rows.filter(some).join(F.broadcast(values.filter(some)), key).unionByName(rows.filter(~some).join(values, key))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
