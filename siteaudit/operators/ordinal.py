"""Rows of a sorted table by their place.

``build`` sorts rows into range partitions and writes each with the places of its rows; one small table
says where each partition begins. A page, from whatever place, then reads the one or two partitions that
hold it and nothing before them, and a row's place is found by its partition's start. The order must
be whole: end it with a key, or rows that tie have no place of their own.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.sources.tables import discard, written

_ROW = (1 << 33) - 1  # what monotonically_increasing_id() counts within a partition


@dataclass(frozen=True)
class Ordinals:
    """A written order. ``starts`` has (partition, place of its first row) and no row more than partitions."""

    spark: SparkSession
    path: str
    starts: tuple[tuple[int, int], ...]
    total: int

    def _rows(self) -> DataFrame:
        # an order without rows has files without a schema
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/shape").schema).parquet(f"{self.path}/rows")

    def page(self, offset: int, size: int = 200) -> DataFrame:
        """The rows at places ``offset`` to ``offset + size - 1`` (from 0), with their ``ordinal``, in order. Places
        beyond the last row give fewer rows, or none."""
        first, last = max(0, offset), min(self.total, offset + size)
        begins = [s for _, s in self.starts]
        held = self.starts[max(0, bisect_right(begins, first) - 1) : bisect_right(begins, last - 1)] if first < last else ()
        rows = self._rows()
        wanted = F.lit(False)
        for part, start in held:
            wanted = wanted | ((F.col("part") == part) & F.col("nth").between(first - start, last - 1 - start))
        return self._placed(rows.where(wanted), held).orderBy("ordinal")

    def find(self, condition: Column) -> DataFrame:
        """The rows that fit, with their places."""
        return self._placed(self._rows().where(condition), self.starts)

    def _placed(self, rows: DataFrame, starts) -> DataFrame:
        known = self.spark.createDataFrame(list(starts), "part int, start long")
        columns = [c for c in rows.columns if c not in ("part", "nth")]
        return rows.join(F.broadcast(known), "part").select((F.col("start") + F.col("nth")).alias("ordinal"), *columns)


def build(rows: DataFrame, order: list[Column], path: str, partitions: int | None = None) -> Ordinals:
    """Write the rows in this order and open them. They are written as they come first: range partitions look
    at their rows once more, and what gives them may be costly."""
    spark = rows.sparkSession
    rows = written(rows, "unordered")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    numbered = numbered.select(*rows.columns, F.shiftright("__at", 33).cast("int").alias("part"), F.col("__at").bitwiseAND(F.lit(_ROW)).alias("nth"))
    numbered.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    spark.createDataFrame([], numbered.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    placed = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    placed.groupBy("part").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    discard(rows)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Ordinals:
    """Open an order that was written before."""
    starts, at = [], 0
    for r in spark.read.parquet(f"{path}/counts").orderBy("part").collect():
        starts.append((r["part"], at))
        at += r["n"]
    return Ordinals(spark, path, tuple(starts), at)
