"""The queue of a crawl as rounds of DataFrame steps: admit what was found, claim the next urls,
mark them done or skipped. A round's tables are its checkpoint: what was in flight when a round
was lost goes back to the queue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteaudit.schema import DONE, IN_FLIGHT, QUEUED, SKIPPED
from siteaudit.sources.tables import written

#: Why a url is not fetched.
NOT_FOLLOWED, EXTERNAL, TOO_DEEP, FILTERED = "not followed", "external", "beyond max depth", "excluded by URL filters"
TOO_MANY_REDIRECTS, OVER_CAP, BLOCKED = "redirect chain too long", "URL cap reached", "blocked by robots.txt"


@dataclass(frozen=True)
class Rules:
    """What a crawl admits."""

    seed_host: str
    crawl_subdomains: bool = False
    max_depth: int | None = None
    max_redirects: int = 10
    url_cap: int = 500_000
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    follow_internal_nofollow: bool = False
    check_external_links: bool = True
    check_images: bool = True
    check_resources: bool = False
    list_mode: bool = False
    extra: dict = field(default_factory=dict)


def is_internal(host: Column, rules: Rules) -> Column:
    seed = rules.seed_host.lower()
    same = F.lower(host) == seed
    if not rules.crawl_subdomains:
        return same
    base = seed.removeprefix("www.")
    return same | (F.lower(host) == base) | F.lower(host).endswith("." + base)


def passes_filters(url: Column, rules: Rules) -> Column:
    """Not excluded, and included if anything is asked for; patterns match anywhere."""
    out = F.lit(True)
    for p in rules.exclude:
        out = out & ~url.rlike(p)
    if rules.include:
        any_of = F.lit(False)
        for p in rules.include:
            any_of = any_of | url.rlike(p)
        out = out & any_of
    return out


def claim(urls: DataFrame, limit: int, per_host: int) -> DataFrame:
    """The next urls to fetch: the first ``per_host`` of each host by depth and id, then the first
    ``limit`` of all."""
    nth = F.row_number().over(Window.partitionBy("host").orderBy("depth", "id"))
    return urls.where(F.col("state") == QUEUED).withColumn("nth", nth).where(F.col("nth") <= per_host).drop("nth").orderBy("depth", "id").limit(limit)


def mark(urls: DataFrame, ids: DataFrame, state: int, reason: Column | None = None) -> DataFrame:
    """The queue with the state of these ids changed."""
    hit = ids.select("id", *([reason.alias("__reason")] if reason is not None else [])).withColumn("__hit", F.lit(True))
    joined = urls.join(hit, "id", "left")
    cols = {"state": F.when(F.col("__hit"), F.lit(state)).otherwise(F.col("state"))}
    if reason is not None:
        cols["skip_reason"] = F.when(F.col("__hit"), F.col("__reason")).otherwise(F.col("skip_reason"))
    return joined.withColumns(cols).drop("__hit", "__reason").select(*urls.columns)


def reset_in_flight(urls: DataFrame) -> DataFrame:
    return urls.withColumn("state", F.when(F.col("state") == IN_FLIGHT, F.lit(QUEUED)).otherwise(F.col("state")))


def follow(found: DataFrame, rules: Rules) -> DataFrame:
    """Decide for each found reference (kind, nofollow, is_internal, parent_depth, parent_hops) at
    which depth it enters, whether it is fetched, and whether only its status is checked."""
    kind, internal = F.col("kind"), F.col("is_internal") == 1
    depth = F.when(kind == "redirect", F.col("parent_depth")).when(kind == "seed", F.lit(0)).otherwise(F.col("parent_depth") + 1)
    hops = F.when(kind == "redirect", F.col("parent_hops") + 1).otherwise(F.lit(0))
    follows = internal & (~F.coalesce("nofollow", F.lit(False)) | F.lit(rules.follow_internal_nofollow)) & F.lit(not rules.list_mode)
    check_external = ~internal & F.lit(rules.check_external_links)
    enqueue = (
        F.when(kind == "link", follows | check_external)
        .when(kind == "image", F.lit(rules.check_images))
        .when(kind == "resource", F.lit(rules.check_resources))
        .when(kind == "seed", F.lit(True))
        .otherwise(internal)
    )
    only_status = F.when(kind == "link", ~internal).otherwise(kind.isin("image", "resource")).cast("int")
    return found.withColumns({"depth": depth.cast("int"), "redirect_hops": hops.cast("int"), "enqueue": enqueue, "check_only": only_status})


def admit(urls: DataFrame, found: DataFrame, rules: Rules, now: float) -> DataFrame:
    """New rows for the queue from decided references (see ``follow``), ordered by ``order``: who
    finds a url first decides its depth and flags. The first rule that fails gives the reason; links
    that the filters exclude are not recorded at all. The cap counts rows that are not skipped."""
    first = found.groupBy("url_hash").agg(F.min_by(F.struct(*[c for c in found.columns if c != "url_hash"]), "order").alias("f")).select("url_hash", "f.*")
    fresh = first.join(urls.select("url_hash"), "url_hash", "left_anti")
    fits = passes_filters(F.col("url"), rules)
    fresh = fresh.where(~((F.col("kind") == "link") & F.col("enqueue") & ~fits))
    deep = F.col("depth") > rules.max_depth if rules.max_depth is not None else F.lit(False)
    reason = (
        F.when(~F.col("enqueue"), F.when(F.col("is_internal") == 1, NOT_FOLLOWED).otherwise(EXTERNAL))
        .when(deep, TOO_DEEP)
        .when(~fits, FILTERED)
        .when(F.col("redirect_hops") > rules.max_redirects, TOO_MANY_REDIRECTS)
    )
    fresh = fresh.withColumn("reason", reason)
    # positions in order of discovery without gathering all rows in one task: counts of partitions first
    ranked = written(fresh.repartitionByRange("order").sortWithinPartitions("order").withColumn("part", F.spark_partition_id()), "admitted")
    per = ranked.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("m")).orderBy("part").collect()
    bases, n, m = [], 0, 0
    for r in per:
        bases.append((r.part, n, m))
        n, m = n + r.n, m + r.m
    state = urls.agg(F.coalesce(F.max("id"), F.lit(0)), F.count_if(F.col("state") != SKIPPED)).first()
    if not bases:
        return urls.limit(0)
    inside = Window.partitionBy("part").orderBy("order")
    base = urls.sparkSession.createDataFrame(bases, "part int, n0 long, m0 long")
    placed = ranked.join(F.broadcast(base), "part").withColumns({"id": F.lit(state[0]) + F.col("n0") + F.row_number().over(inside), "live": F.col("m0") + F.sum(F.col("reason").isNull().cast("int")).over(inside)})
    capped = F.when(F.col("reason").isNull() & (F.lit(state[1]) + F.col("live") > rules.url_cap), F.lit(OVER_CAP)).otherwise(F.col("reason"))
    out = placed.withColumn("skip_reason", capped).withColumns({"state": F.when(F.col("skip_reason").isNull(), QUEUED).otherwise(SKIPPED), "discovered_at": F.lit(now), "in_sitemap": F.lit(0)})
    return out.select(*[F.col(c).cast(urls.schema[c].dataType).alias(c) for c in urls.columns])


def seed_sitemap(urls: DataFrame, listed: DataFrame, rules: Rules, now: float) -> DataFrame:
    """The queue after reading sitemaps (url, url_hash, host, path): known urls are flagged; others
    come in at depth 0, queued if they are internal and pass the filters, else skipped without a
    reason. Depth and cap are not asked."""
    listed = listed.dropDuplicates(["url_hash"])
    flagged = urls.join(listed.select("url_hash", F.lit(1).alias("__listed")), "url_hash", "left").withColumn("in_sitemap", F.coalesce("__listed", "in_sitemap")).select(*urls.columns)
    top = urls.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = listed.join(urls.select("url_hash"), "url_hash", "left_anti")
    inside = is_internal(F.col("host"), rules)
    queued = inside & passes_filters(F.col("url"), rules)
    rows = fresh.withColumns({"id": F.lit(top) + 1 + F.monotonically_increasing_id(), "depth": F.lit(0), "is_internal": inside.cast("int"), "discovered_at": F.lit(now), "state": F.when(queued, QUEUED).otherwise(SKIPPED), "redirect_hops": F.lit(0), "check_only": F.lit(0), "in_sitemap": F.lit(1), "skip_reason": F.lit(None).cast("string")})
    return flagged.unionByName(rows.select(*[F.col(c).cast(urls.schema[c].dataType).alias(c) for c in urls.columns]))


def latest(df: DataFrame, keys: list[str], at: str = "fetched_at") -> DataFrame:
    """One row a key: the one written last. Replaces an update in place."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last())
    return df.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str = "url_id") -> DataFrame:
    """Child rows after their pages were parsed anew: the old ones of those pages go."""
    return old.join(parents.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


__all__ = ["BLOCKED", "DONE", "Rules", "admit", "claim", "follow", "is_internal", "latest", "mark", "passes_filters", "replace_children", "reset_in_flight", "seed_sitemap"]
