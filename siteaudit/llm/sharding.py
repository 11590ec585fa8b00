"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``replicas`` points of a 64-bit ring; a row belongs to the first point at or
after its own hash. Shard loads are bounded to their share (floor or ceiling of rows / shards),
and rows that overflow a full shard continue clockwise to the next shard with room. Capacities
add up to the number of rows, so counts differ by at most one.

The rows are numbered once in ring order (a range sort of narrow rows; equal hashes are cut by
a row number, so that one hot key never meets in one task). Only the count of each arc, at most
shards x replicas numbers, comes to the driver; it plans which stretch of each arc stays and
where the rest goes, and the plan (a few stretches an arc) is joined back.

Null text has no bytes. Rows with null or repeated doc_id are placed like any others, each row
by itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import materialize, utf8_size

SHARDS = 40
REPLICAS = 128
OVERHEAD = 16


def ring(shards: int = SHARDS, replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in ascending order (signed 64 bits) and their shards."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}#{r}", 42) - (1 << 63), s) for s in range(shards) for r in range(replicas))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Stretches (arc, from, to, shard, first slot) that place every row of every arc: each
    shard takes the rows of its own arcs while it has room, then the overflow moves clockwise."""
    room, used, stretches = list(room), [0] * len(room), []

    def take(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard])
        if n:
            stretches.append((arc, low, low + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return low + n

    over: list[tuple[int, int, int]] = []
    left = {}
    for arc, n in enumerate(counts):
        low = take(arc, 0, n, owners[arc])
        if low < n:
            left[arc] = (low, n)
    for turn in range(2):
        for arc, owner in enumerate(owners):
            if turn == 0 and arc in left:
                over.append((arc, *left[arc]))
            while over and room[owner]:
                src, low, high = over.pop(0)
                if (low := take(src, low, high, owner)) < high:
                    over.insert(0, (src, low, high))
    if over:
        raise ValueError("the shards have no room for all rows")
    return stretches


def assign_shards(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and home (the shard that owns the row's arc)."""
    points, owners = ring(shards, replicas)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(points, b.column(b.schema.get_field_index("pos")).to_numpy(), "left") % len(points)
            yield b.append_column("arc", pa.array(at.astype(np.int32)))

    narrow = docs.select("doc_id", (utf8_size(F.col("text")) + OVERHEAD).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.col("doc_id").cast("string")).alias("pos"))
    narrow = narrow.mapInArrow(arcs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, pos long, arc int")
    narrow = materialize(narrow.withColumn("row", F.monotonically_increasing_id()), "ring")
    rows = narrow.count()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the first arc continues past the highest point, so ring order begins with its upper end
    turned = F.when((F.col("arc") == 0) & (F.col("pos") > int(points[-1])), 0).otherwise(1)
    ordered = narrow.withColumn("turn", turned).repartitionByRange(parts, "turn", "pos", "doc_id", "row").sortWithinPartitions("turn", "pos", "doc_id", "row")
    ordered = ordered.select("doc_id", "size", "text_crc32", "arc", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    ordered = materialize(ordered, "ring-order")
    # bounded by arcs + partitions: partitions hold consecutive arcs
    tally = sorted((r.part, r.arc, r.low, r.n) for r in ordered.groupBy("part", "arc").agg(F.min("at").alias("low"), F.count("*").alias("n")).collect())
    counts, before = [0] * len(points), []
    for part, arc, low, n in tally:
        before.append((part, arc, counts[arc] - low))
        counts[arc] += n
    spark = docs.sparkSession
    stretches = plan(counts, owners.tolist(), capacities(rows, shards))
    # a stretch is cut where a partition ends, so that a row finds it by partition and arc
    first = spark.createDataFrame(before, "part int, arc int, shift long")
    placed = spark.createDataFrame([(a, lo, hi, s, slot, int(owners[a])) for a, lo, hi, s, slot in stretches], "arc int, low long, high long, shard int, first_slot long, home int")
    numbered = ordered.join(F.broadcast(first), ["part", "arc"]).withColumn("rank", F.col("at") + F.col("shift"))
    near = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    joined = numbered.join(F.broadcast(placed), (numbered.arc == placed.arc) & near)
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"), "home")
