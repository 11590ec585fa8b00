"""A crawl as it comes in: files of fetched pages are parsed, de-duplicated by url and appended; the
rate at which they come is smoothed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siteaudit.sources.pages import PARSED, parse_pages

PAGE = "url string, html string, fetched_at timestamp"
ALPHA = 0.3


def page_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Parsed pages of the files that appear in a folder, each url once within the watermark."""
    raw = spark.readStream.schema(PAGE).parquet(folder)
    return raw.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url"])


def append_parsed(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parse what arrives and append it to a table. A batch that runs again replaces its own part, so
    nothing is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        parse_pages(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = page_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def compact(spark: SparkSession, out: str, into: str, files: int = 8) -> None:
    """The parts of all batches as a few files elsewhere; of a url the last batch counts."""
    rows = spark.read.option("basePath", out).parquet(out)
    last = rows.groupBy("url_hash").agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*").drop("batch")
    last.coalesce(files).write.mode("overwrite").parquet(into)


def parsed_so_far(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(PARSED).parquet(out)


def pages_per_window(stream: DataFrame, window: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Tumbling counts of fetched pages (``fetched_at``)."""
    return stream.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window)).count().select(F.col("window.start").alias("at"), "count")


def rates(ticks: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(crawl, at, per_second) of a stream of (crawl string, at timestamp, crawled long): the smoothed rate
    of each crawl as its count goes up. Ticks of one moment, and counts that fall, give no rate of their own;
    a tick older than the last one seen is left out."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, count, rate = state.get if state.exists else (None, None, None)
        out = []
        for r in pd.concat(list(parts)).sort_values("at").itertuples():
            now = r.at.timestamp()
            if at is None or now > at:
                if at is not None:
                    instant = max(r.crawled - count, 0) / (now - at)
                    rate = instant if rate is None else alpha * instant + (1 - alpha) * rate
                    out.append((key[0], r.at, rate))
                at, count = now, int(r.crawled)
        state.update((at, count, rate))
        yield pd.DataFrame(out, columns=["crawl", "at", "per_second"])

    shape = "crawl string, at timestamp, per_second double"
    return ticks.groupBy("crawl").applyInPandasWithState(run, shape, "at double, count long, rate double", "append", GroupStateTimeout.NoTimeout)


def smoothed(rates: list[float], alpha: float = ALPHA) -> float | None:
    """Exponentially weighted mean; the first value stands for itself."""
    out = None
    for r in rates:
        out = r if out is None else alpha * r + (1 - alpha) * out
    return out
