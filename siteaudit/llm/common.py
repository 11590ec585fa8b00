"""Shared helpers: the cluster's checkpoint folder, written tables, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset and all of Spark is one local
    process, a temporary one is made and set, once a session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siteaudit-ck-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: its lineage is
    cut there, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/siteaudit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again."""
    spark, path = table.sparkSession, getattr(table, "_written", None)
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: What goes to a Python worker at a time. The default of Spark is eight times as much, and its
#: buffers would stay in every executor beside the heap.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Have texts go to Python in batches of ``BATCH_BYTES`` at most; a smaller setting stays."""
    now = spark.conf.get(_BATCH_SETTING, None)
    digits = "".join(c for c in now or "" if c.isdigit())
    if not digits or not now.rstrip("bB").isdigit() or not 0 < int(digits) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_size(col):
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def trim() -> None:
    """Give memory that is free back to the system. Spark keeps Python workers for later tasks, and
    what a large batch has left in one would add to what the executor needs then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that trims its worker when a task is over."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return tidied
