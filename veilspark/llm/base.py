"""Shared helpers: tables, shared folders, and Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspark import prepare

#: Rows and bytes of text that one step of a Python operator works on.
BATCH_ROWS = 4096
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> None:
    """Use the shared checkpoint folder that the cluster names. Only a session in one process may make a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilspark-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, for tables that one query writes and reads again.

    The result reads from it when it is run, so it stays until ``clear`` or the end of the driver's process.
    """
    with_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(clear, spark)
    _folders.append(folder)
    return folder


_folders: list[str] = []


def clear(spark: SparkSession) -> None:
    """Removes the folders made so far. Frames that read from them can't be run any more."""
    sc = spark.sparkContext
    while _folders and sc._jsc is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame, written to a shared folder and read again."""
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since single texts may be very long; let workers find the package.

    All operators set the same values, so it does not matter in which order their frames are made and run.
    """
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(text).cast(pa.large_string() if pa.types.is_string(batch.schema.field(text).type) else batch.schema.field(text).type)
        sizes = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Returns memory that a task has freed to the system: workers are used again by later tasks of other operators."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
