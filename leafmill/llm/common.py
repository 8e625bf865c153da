"""Shared helpers of the training-data operators: staged tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tokens import forget_encoders

#: ASCII white space that separates words in every contract of this package.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Java and RE2 class of the same characters, negated: one word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets one of its own; a cluster has to name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            at = set_before.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="leafmill-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch in operators that hold whole texts of a batch as Python objects, beside what the JVM holds of it.
BATCH_ROWS = 2000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> None:
    """Lower this session's Arrow batches to BATCH_ROWS rows, if they are larger: workers' memory is bounded by them."""
    now = int(df.sparkSession.conf.get(_BATCH_SETTING))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(_BATCH_SETTING, BATCH_ROWS)


def give_back() -> None:
    """Return this process's free memory to the system: Arrow's pool and the C heap both keep what they freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(kernel, encodes: bool = False):
    """The mapInArrow function kernel, giving back free memory before each batch and at its end.

    Python workers outlive their tasks and go from operator to operator, so what one keeps counts beside the next one's.
    Only a kernel that encodes finds the encoder of the task before; others drop it.
    """

    @functools.wraps(kernel)
    def run(batches):
        def fed():
            for batch in batches:
                give_back()
                yield batch

        if not encodes:
            forget_encoders()
        try:
            yield from kernel(fed())
        finally:
            give_back()

    return run


def require(df: DataFrame, *names: str) -> None:
    """Fail early, with the names, if df lacks a column that an operator needs."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
