"""The web as a data source: ``spark.read.format("siteaudit_web")`` and ``spark.readStream``.

``deal`` writes the urls of a round as a table of buckets. All urls of one slot of a host are in one bucket,
and a host has as many slots as it may be asked at once (one, if there is a delay between requests);
a partition of the source is a bucket and asks for one url after the other, so the limits of a
host hold without talk between tasks. Within a bucket hosts take turns: while one has to wait, the others are
asked. As a stream, a round is an offset: a query that is started again goes on with the first round
that it has not finished, and what a finished round asked for is not asked again.

    from siteaudit.sources import web
    web.register(spark)
    web.deal(urls, "/shared/frontier", round=1, per_host=2)
    spark.read.format("siteaudit_web").option("round", 1).option("timeout", 20).load("/shared/frontier")
    spark.readStream.format("siteaudit_web").option("header.User-Agent", "me/1.0").load("/shared/frontier")

The planner lists buckets, never urls; tasks read their own bucket through ``pyarrow.fs``, which
knows local and shared paths, hdfs, s3 and gs.
"""

from __future__ import annotations

import heapq
import re
import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siteaudit.sources import http

FORMAT = "siteaudit_web"
#: Answers that go to Spark at a time, by number and by size of their bodies.
ROWS, BYTES = 256, 8 << 20


def deal(urls: DataFrame, path: str, round: int = 1, per_host: int = 2, delay: float = 0, buckets: int | None = None) -> None:
    """Write the urls (url, host, and check_only where known) that a round asks for."""
    n = buckets or max(1, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    only = F.coalesce(F.col("check_only").cast("int"), F.lit(0)) if "check_only" in urls.columns else F.lit(0)
    slot = F.pmod(F.xxhash64("url"), F.lit(1 if delay else max(1, per_host)))
    rows = urls.where("url IS NOT NULL").select("url", "host", only.alias("check_only"), F.pmod(F.xxhash64("host", slot), F.lit(n)).cast("int").alias("bucket"))
    # a bucket may be one file or several; they are read by one partition, in order
    rows.repartition(n, "bucket").sortWithinPartitions("bucket", "host", "url").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/round={round}")


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/(?!//)", path):
        path = path.replace("file:", "file://", 1)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _listed(path: str, pattern: str) -> list[tuple[int, str]]:
    """Numbers and places of the entries of a folder whose names fit."""
    fs, at = _at(path)
    names = [(re.fullmatch(pattern, f.base_name), f.path) for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))]
    return sorted((int(m[1]), p) for m, p in names if m)


def rounds(path: str) -> list[int]:
    """Rounds that are written whole."""
    fs = _at(path)[0]
    return [n for n, p in _listed(path, r"round=(\d+)") if fs.get_file_info(f"{p}/_SUCCESS").type != pafs.FileType.NotFound]


class Bucket(InputPartition):
    def __init__(self, round: int, bucket: int) -> None:
        self.round, self.bucket = round, bucket


def in_turns(urls: Iterator[tuple[str, str, int]], delay: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, int]]:
    """(url, check_only), hosts by turns; between two urls of a host at least ``delay`` seconds pass."""
    queues: dict[str, deque] = {}
    for url, host, only in urls:
        queues.setdefault(host, deque()).append((url, only))
    due = [(0.0, n, host) for n, host in enumerate(queues)]
    turn = len(due)
    while due:
        at, _, host = heapq.heappop(due)
        if (wait := at - clock()) > 0:
            sleep(wait)
        yield queues[host].popleft()
        if queues[host]:
            # from the answer on, not from the question
            heapq.heappush(due, (clock() + delay if delay else 0.0, turn, host))
            turn += 1


class _Asker:
    """What batch and stream readers share: options, and how a bucket is asked for."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.path = (options.get("path") or "").rstrip("/")
        if not self.path:
            raise ValueError("load() needs the folder that deal() wrote")
        self.delay, self.timeout = float(options.get("delay", 0)), float(options.get("timeout", 20))
        self.rounds_at_once = max(1, int(options.get("roundspertrigger", options.get("roundsPerTrigger", 1))))
        self.round = options.get("round")
        self.headers = {k.partition(".")[2]: v for k, v in options.items() if k.lower().startswith("header.")}

    def buckets(self, wanted: list[int]) -> list[Bucket]:
        return [Bucket(n, b) for n in wanted for b, _ in _listed(f"{self.path}/round={n}", r"bucket=(\d+)")]

    def urls(self, part: Bucket) -> Iterator[tuple[str, str, int]]:
        folder = f"{self.path}/round={part.round}/bucket={part.bucket}"
        fs, at = _at(folder)
        for f in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda f: f.path):
            if f.base_name.endswith(".parquet"):
                for batch in pq.ParquetFile(f.path, filesystem=fs).iter_batches(columns=["url", "host", "check_only"]):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        rows, size = [], 0
        ask = lambda url, method: http.request(url, method, self.headers, self.timeout)
        for url, only in in_turns(self.urls(partition), self.delay):
            got = http.check_status(url, ask) if only else ask(url, "GET")
            got["round"] = partition.round
            rows.append({k: got.get(k) for k in shape.names})
            size += len(got.get("html") or "") + len(got.get("pdf") or b"")
            if len(rows) >= ROWS or size >= BYTES:
                yield pa.RecordBatch.from_pylist(rows, shape)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)


class BatchReader(_Asker, DataSourceReader):
    def partitions(self) -> list[Bucket]:
        return self.buckets([int(self.round)] if self.round else rounds(self.path)) or [Bucket(-1, -1)]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.round >= 0 else iter(())


class StreamReader(_Asker, DataSourceStreamReader):
    """An offset is the last round that is done."""

    #: The end that the last trigger was planned to; the next one goes on from there.
    planned = 0

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        later = [n for n in rounds(self.path) if n > self.planned]
        if later:
            self.planned = later[: self.rounds_at_once][-1]
        return {"round": self.planned}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        self.planned = max(self.planned, end["round"])
        return self.buckets([n for n in rounds(self.path) if start["round"] < n <= end["round"]])

    def commit(self, end: dict) -> None:
        self.planned = max(self.planned, end["round"])


class WebSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"round int, {http.SHAPE}"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSource)


__all__ = ["FORMAT", "WebSource", "deal", "in_turns", "register", "rounds"]
