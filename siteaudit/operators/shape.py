"""The crawl as a tree of paths and as a graph of links, and chains of redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteaudit.sources.crawl import Crawl
from siteaudit.sources.tables import written

MAX_STEPS = 20
TOP_PAGES = 300


def site_tree(pv: DataFrame) -> DataFrame:
    """One row a path prefix of internal pages: prefix, parent, label, page_count and issue_count
    at or below it, and the url that stands there (the last by path and id), if there is one."""
    pages = pv.where("is_internal = 1 AND page_row AND status IS NOT NULL")
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    issue = F.when(F.expr("status = 0 OR status >= 400 OR non_indexable"), 1).otherwise(0)
    at = pages.select("id", "path", "status", issue.alias("issue"), parts.alias("parts"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, n), "/")))
    nodes = at.select(F.explode(prefixes).alias("prefix"), "issue").groupBy("prefix").agg(F.count("*").alias("page_count"), F.sum("issue").alias("issue_count"))
    here = at.groupBy(F.concat(F.lit("/"), F.array_join("parts", "/")).alias("prefix")).agg(F.max(F.struct("path", "id", "status")).alias("page"))
    split = F.filter(F.split("prefix", "/"), lambda p: p != "")
    depth = F.size(split)
    return nodes.join(here, "prefix", "left").select(
        "prefix", F.when(depth > 0, F.concat(F.lit("/"), F.array_join(F.slice(split, 1, F.greatest(depth - 1, F.lit(0))), "/"))).alias("parent"), F.when(depth > 0, F.element_at(split, -1)).otherwise(F.lit("/")).alias("label"),
        depth.alias("level"), "page_count", "issue_count", F.col("page.id").alias("url_id"), F.col("page.status").alias("status"))


def natural_order(label: Column) -> Column:
    """A key that sorts names as people do: without regard to case, and numbers in them by their value.
    Runs of digits get their length before them, so that longer numbers follow shorter ones."""
    low = F.lower(label)
    pieces = F.regexp_extract_all(low, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits(p)).cast("string"), 4, "0"), digits(p))).otherwise(F.concat(F.lit("1"), p)))


def children(tree: DataFrame, prefix: str) -> DataFrame:
    """The nodes right below a prefix, in natural order of their labels."""
    return tree.where(F.col("parent") == prefix).orderBy(natural_order(F.col("label")), "label")


def graph_nodes(pv: DataFrame, limit: int = TOP_PAGES) -> DataFrame:
    """The pages with most inlinks; ties to the smaller depth, then id."""
    return pv.where("is_internal = 1 AND page_row AND status IS NOT NULL").orderBy(F.desc("inlinks"), "depth", "id").limit(limit).select("id", "url", "depth", "inlinks", "status", "indexability")


def graph_edges(crawl: Crawl, nodes: DataFrame) -> DataFrame:
    """Links among the nodes, each once, none to itself."""
    ends = nodes.select("id")
    e = crawl.links.select(F.col("from_url_id").alias("source"), F.col("to_url_id").alias("target")).where("source <> target")
    return e.join(F.broadcast(ends.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ends.withColumnRenamed("id", "target")), "target", "left_semi").distinct()


def graph_layout(nodes: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """A column a depth, evenly spaced; at most as many rows as the graph has nodes."""
    column = Window.partitionBy("depth").orderBy(F.desc("inlinks"), "id")
    whole = nodes.agg(F.max("depth").alias("deepest"))
    placed = nodes.withColumn("row", F.row_number().over(column)).withColumn("rows", F.count("*").over(Window.partitionBy("depth")))
    return placed.join(F.broadcast(whole), F.lit(True)).select("id", (F.lit(width) * (F.col("depth") + 0.5) / (F.col("deepest") + 1)).alias("x"), (F.lit(height) * (F.col("row") - 0.5) / F.col("rows")).alias("y"))


def redirect_chains(crawl: Crawl, starts: DataFrame | None = None, max_steps: int = MAX_STEPS) -> DataFrame:
    """(start_id, step, url_id, url, status, is_loop): each chain from its start, a url met again is
    the last row and marked. ``starts`` holds ids; by default all redirecting urls start a chain.

    One equi-join a step on the chains that still go on, so a round costs what is left of them."""
    hop = crawl.urls.select(F.col("id").alias("url_id"), "url").join(crawl.responses.select("url_id", "status", "redirect_target_id"), "url_id", "left")
    first = starts.select(F.col("id").alias("start_id")) if starts is not None else crawl.responses.where("redirect_target_id IS NOT NULL").select(F.col("url_id").alias("start_id"))
    now = first.distinct().select("start_id", F.lit(0).alias("step"), F.col("start_id").alias("url_id"), F.array().cast("array<bigint>").alias("seen")).join(hop, "url_id")
    shown = ["start_id", "step", "url_id", "url", "status"]
    out = now.select(*shown, F.lit(False).alias("is_loop"))
    for step in range(1, max_steps):
        ahead = now.where("redirect_target_id IS NOT NULL").select("start_id", F.lit(step).alias("step"), F.col("redirect_target_id").alias("target"), F.array_append("seen", F.col("url_id")).alias("seen"))
        ahead = ahead.withColumn("is_loop", F.array_contains("seen", F.col("target"))).withColumnRenamed("target", "url_id").join(hop, "url_id")
        if ahead.isEmpty():
            break
        ahead = written(ahead, "chain")
        out = out.unionByName(ahead.select(*shown, "is_loop"))
        now = ahead.where("NOT is_loop")
    return out

