"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch that goes to or comes from a Python worker; a row is never cut.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the context.

    Where none is set, a session in one process makes its own.  On a cluster there is then no
    place that every executor reads, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def place(spark: SparkSession, path: str):
    """path for the file system that holds it, and that file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Tables that are written between two collections of the driver's garbage.
SWEEP_EVERY = 8
_count = itertools.count(1)


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans, and the files of shuffles that nothing refers to.

    Spark drops those files only when the driver happens to collect, which a driver with
    little garbage of its own does late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH_BYTES`` or one row, not 10,000 rows of any length.

    It is a setting of the session, since no operator takes one; a smaller one stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(name)))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs no recomputation of what came
    before, and later passes read only the columns they need.  The files go when
    ``released`` or when the application ends.
    """
    spark = df.sparkSession
    if next(_count) % SWEEP_EVERY == 0:
        swept(spark)
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete what ``written`` has written for frames that nothing reads any more."""
    for df in frames:
        at, files = place(df.sparkSession, df._quarry_path)
        files.delete(at, True)


class RunLock:
    """An exclusive lock file in a shared folder: one run at a time; an old lock has expired.

    with RunLock(spark, path): ...
    """

    def __init__(self, spark: SparkSession, path: str, ttl: float = 3600.0):
        self.spark, self.path, self.ttl = spark, path, ttl
        self.at, self.files = place(spark, path)

    def acquire(self) -> bool:
        """Whether the lock is ours now."""
        if self.files.exists(self.at):
            age = time.time() - self.files.getFileStatus(self.at).getModificationTime() / 1000
            if age < self.ttl:
                return False
            self.files.delete(self.at, False)
        try:
            self.files.create(self.at, False).close()  # fails where another run was first
        except Py4JJavaError:
            return False
        return True

    def release(self) -> None:
        self.files.delete(self.at, False)

    def __enter__(self) -> RunLock:
        if not self.acquire():
            raise RuntimeError(f"another run holds {self.path}")
        return self

    def __exit__(self, *_) -> None:
        self.release()
