"""Counts of all filters that are kept up to date, in place of a scan of the whole view after each batch.

A folder holds, for each batch, the positions of the filters that each changed url is in (``flags``) and
the counts after it (``counts``). A batch names the urls whose own rows changed. From these follow the
urls whose place in some filter can change; only their rows of the wide view are computed, and the counts
move by the difference to what was noted for them before. What is scanned whole are narrow columns (ids,
keys, fingerprints); what is shuffled, aggregated and written grows with the batch.

A batch counts once its counts are written, the last step; what a broken-off batch left is written over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.plans.catalogue import condition, reports
from siteaudit.plans.wide import asked_keys, base_rows, held_keys, near_fingerprints, print_groups, wide_view
from siteaudit.sources.crawl import Crawl
from siteaudit.sources.tables import discard, without_broadcasts, written

#: What of one url others depend on: table, column of the url, column of those that depend on it.
_EDGES = (("links", "from_url_id", "to_url_id"), ("images", "url_id", "src_url_id"), ("resources", "url_id", "src_url_id"), ("hreflang", "href_url_id", "url_id"))
_FLAGS, _COUNTS = "id long, held array<int>, batch int", "position int, n long, batch int"


def _keys() -> list[tuple[str, Column]]:
    return [(f"{r.id}.{f.id}", condition(r.base) & condition(f.predicate)) for r in reports() for f in r.filters]


def _flags(pv: DataFrame) -> DataFrame:
    return pv.select("id", F.array_compact(F.array(*[F.when(p, F.lit(i)) for i, (_, p) in enumerate(_keys())])).alias("held"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last whole batch."""
    return _read(spark, f"{path}/counts", _COUNTS).agg(F.max("batch")).first()[0]


def counts(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """(key, n) for every filter, after the last batch or an earlier one."""
    batch = last_batch(spark, path) if batch is None else batch
    names = F.array(*[F.lit(k) for k, _ in _keys()])
    return _read(spark, f"{path}/counts", _COUNTS).where(F.col("batch") == batch).select(names[F.col("position")].alias("key"), "n")


def _commit(changes: DataFrame, path: str, batch: int) -> None:
    """``changes``: (position, n) by which the counts move."""
    spark = changes.sparkSession
    all_positions = spark.range(len(_keys())).select(F.col("id").cast("int").alias("position"), F.lit(0).cast("long").alias("n"))
    parts = [all_positions, changes]
    if batch:
        parts.append(_read(spark, f"{path}/counts", _COUNTS).where(F.col("batch") == batch - 1).select("position", "n"))
    total = reduce(DataFrame.unionByName, parts).groupBy("position").agg(F.sum("n").alias("n"))
    total.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")  # 163 rows


def start(pv: DataFrame, path: str) -> DataFrame:
    """Batch 0 from a whole view, best a written one. The counts after it."""
    _flags(pv).write.mode("overwrite").parquet(f"{path}/flags/batch=0")
    held = _read(pv.sparkSession, f"{path}/flags", _FLAGS).where("batch = 0")
    _commit(held.select(F.explode("held").alias("position")).groupBy("position").agg(F.count("*").alias("n")), path, 0)
    return counts(pv.sparkSession, path)


def _crossed(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """(kind, key) that the touched urls hold more or less often, where that makes a difference: between
    none, one and several. A title of a million pages that one more page takes changes nothing for them."""
    own = lambda base, sign: held_keys(base.join(touched, "id", "left_semi")).select("kind", "key", F.lit(sign).alias("d"))
    moved = own(old, -1).union(own(new, 1)).where("kind <> 'same'").groupBy("kind", "key").agg(F.sum("d").alias("d")).where("d <> 0")
    before = held_keys(old).join(moved, ["kind", "key"], "left_semi").groupBy("kind", "key").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return moved.join(before, ["kind", "key"], "left").where(F.least(n, F.lit(2)) != F.least(n + F.col("d"), F.lit(2))).select("kind", "key")


def _turned(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Fingerprints whose pages have other contents than before, as far as near pages look at them."""
    prints = old.join(touched, "id", "left_semi").select("simhash").union(new.join(touched, "id", "left_semi").select("simhash")).where("simhash IS NOT NULL").distinct()
    of = lambda base: print_groups(base.join(prints, "simhash", "left_semi"))
    a, b = of(old).alias("a"), of(new).alias("b")
    same = F.col("a.low").eqNullSafe(F.col("b.low")) & F.col("a.high").eqNullSafe(F.col("b.high"))
    return a.join(b, F.col("a.c") == F.col("b.c"), "full").where(~same).select(F.coalesce("a.c", "b.c").alias("simhash"))


def affected(before: Crawl, after: Crawl, old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """(id) of all urls whose place in a filter can change: the touched ones, what they link, show or load,
    who names them as canonical, redirect or alternate, who shares a value with them that becomes or ceases
    to be shared, and whose near pages they are. ``old`` and ``new`` are the crawls' ``base_rows``."""
    parts = [touched]
    for crawl, base in ((before, old), (after, new)):
        edges = [(crawl.tables[t], at, out) for t, at, out in _EDGES] + [(base, c, "id") for c in ("canonical_id", "redirect_target_id")]
        parts += [df.select(F.col(at).alias("at"), F.col(out).alias("id")).join(touched.withColumnRenamed("id", "at"), "at", "left_semi").select("id") for df, at, out in edges]
    # each written by itself: the driver holds a plan as often as it has exchanges
    crossed, turned = written(_crossed(old, new, touched), "crossed"), written(_turned(old, new, touched), "turned")
    parts.append(asked_keys(new).join(crossed, ["kind", "key"], "left_semi").select("id"))
    around = written(near_fingerprints(new, of=turned).select(F.col("c").alias("simhash")).distinct(), "around")
    parts.append(new.join(around, "simhash", "left_semi").select("id"))
    return reduce(DataFrame.union, parts).where("id IS NOT NULL").distinct()


def advance(before: Crawl, after: Crawl, touched: DataFrame, path: str, old: DataFrame | None = None) -> DataFrame:
    """The counts after a batch. ``touched`` (id): urls that came, went, or whose own rows in any table are
    other than before (links, images and resources belong to the page they are on); one that is named without
    need costs time only. ``old`` are ``base_rows(before)``, if they are there. The seed must stay."""
    spark = after.spark
    if before.seed_url != after.seed_url:
        raise ValueError("another seed is another crawl")
    with without_broadcasts(spark):
        batch = last_batch(spark, path) + 1
        mine = old is None
        old, new = base_rows(before) if mine else old, base_rows(after)
        touched = written(touched.select("id").where("id IS NOT NULL").distinct(), "touched")
        ids = written(affected(before, after, old, new, touched), "affected")
        # urls that are gone have no row of the view: they are in no filter
        view = written(wide_view(after, ids, new), "view")
        now = ids.join(_flags(view), "id", "left").select("id", F.coalesce("held", F.array().cast("array<int>")).alias("held"))
        now.write.mode("overwrite").parquet(f"{path}/flags/batch={batch}")
        notes = _read(spark, f"{path}/flags", _FLAGS).where(F.col("batch") <= batch).join(ids, "id", "left_semi")
        was = notes.where(F.col("batch") < batch).groupBy("id").agg(F.max_by("held", "batch").alias("held"))
        side = lambda df, sign: df.select(F.explode("held").alias("position"), F.lit(sign).cast("long").alias("n"))
        _commit(side(was, -1).union(side(notes.where(F.col("batch") == batch), 1)).groupBy("position").agg(F.sum("n").alias("n")), path, batch)
        discard(touched, ids, view, new, *([old] if mine else []))
    return counts(spark, path, batch)
