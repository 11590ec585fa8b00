"""Written tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siteaudit-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{shared_folder(spark)}/siteaudit-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back, so that its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_written", None):
            remove(t.sparkSession, path)


#: What of pages goes to a Python worker at a time: rows of Arrow batches are counted, and pages have any length.
PAGE_BATCH = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have pages go to Python in batches of ``PAGE_BATCH`` bytes at most; a smaller setting stays. It holds for the
    session, as plans that are run later read it then."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key, None) or "").lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= PAGE_BATCH:
        spark.conf.set(key, str(PAGE_BATCH))


#: Joins by size: a table below the threshold passes the driver whole.
_BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def without_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside shuffle both sides, unless a broadcast is asked for. A plan of many joins over
    tables that are still small would send each of them through the driver, and hold them there together."""
    was = {k: spark.conf.get(k, None) for k in _BROADCASTS}
    for k in _BROADCASTS:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def numbered(df: DataFrame, by: str, name: str, start: int = 1, column: str = "id") -> DataFrame:
    """The rows with numbers from ``start`` in order of ``by``, without gathering them in one task: range
    partitions are written, counted, and each is numbered from the sum of those before it."""
    parts = written(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id()), name)
    bases, n = [], start
    for r in parts.groupBy("__part").count().orderBy("__part").collect():
        bases.append((r["__part"], n))
        n += r["count"]
    base = F.broadcast(df.sparkSession.createDataFrame(bases, "__part int, __base long"))
    return parts.join(base, "__part").withColumn(column, F.col("__base") - 1 + F.row_number().over(Window.partitionBy("__part").orderBy(by))).drop("__part", "__base")
