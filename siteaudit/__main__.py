"""python -m siteaudit crawl|export|compare|counts|enrich|schedule ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from siteaudit.config import CrawlConfig, ExtractionRule, Schedule
from siteaudit.functions.urls import normalise
from siteaudit.operators import compare, reports, rounds, summary
from siteaudit.plans.catalogue import COLUMNS
from siteaudit.plans.catalogue import reports as all_reports
from siteaudit.plans.wide import wide_view
from siteaudit.sources import providers, services, sinks
from siteaudit.sources.crawl import Crawl
from siteaudit.sources.tables import written


def _pair(text: str, sep: str) -> tuple[str, str]:
    """Name and value around the first ``sep``; values may hold more of them."""
    name, found, value = text.partition(sep)
    if not found or not name.strip() or not value.strip():
        raise argparse.ArgumentTypeError(f"must be Name{sep}value, not {text!r}")
    return name.strip(), value.strip()


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siteaudit")
    sub = p.add_subparsers(dest="do", required=True)
    w = sub.add_parser("crawl", help="crawl a site, or go on with a crawl that was broken off")
    w.add_argument("url")
    w.add_argument("--out", help="the crawl's folder; named after the host if not given")
    w.add_argument("--replace", action="store_true", help="begin anew where a crawl is there already")
    w.add_argument("--workers", type=int, default=5)
    w.add_argument("--limit", type=int, default=500_000)
    w.add_argument("--max-depth", type=int)
    w.add_argument("--round-size", type=int, default=10_000)
    w.add_argument("--max-rounds", type=int)
    for flag in ("--ignore-robots", "--no-sitemap-discovery", "--list-mode", "--check-resources", "--mobile"):
        w.add_argument(flag, action="store_true")
    w.add_argument("--sitemap", action="append", default=[])
    w.add_argument("--user")
    w.add_argument("--password")
    w.add_argument("--extract-header", action="append", default=[])
    w.add_argument("--header", action="append", default=[], type=lambda t: _pair(t, ":"))
    for flag in ("--css", "--xpath"):
        w.add_argument(flag, action="append", default=[], type=lambda t: _pair(t, "="))
    e = sub.add_parser("export")
    e.add_argument("crawl")
    e.add_argument("--out", required=True)
    e.add_argument("--format", choices=("csv", "xlsx"), default="csv")
    e.add_argument("--report", action="append")
    e.add_argument("--limit", type=int, help="rows of each report at most")
    c = sub.add_parser("compare")
    c.add_argument("crawl")
    c.add_argument("before")
    c.add_argument("--limit", type=int, default=500)
    n = sub.add_parser("counts")
    n.add_argument("crawl")
    r = sub.add_parser("enrich", help="add a service's metrics; credentials come from a JSON file or SITEAUDIT_*")
    r.add_argument("crawl")
    r.add_argument("--source", required=True, choices=sorted(services.NEEDED))
    r.add_argument("--credentials")
    r.add_argument("--limit", type=int, default=100)
    r.add_argument("--days", type=int, default=services.WINDOW_DAYS)
    s = sub.add_parser("schedule", help="the cron line of a crawl")
    s.add_argument("url")
    s.add_argument("--hour", type=int, required=True)
    s.add_argument("--minute", type=int, default=0)
    s.add_argument("--weekday", type=int)
    return p


def config_of(got: argparse.Namespace) -> CrawlConfig:
    rules = tuple(ExtractionRule(n, x, engine=k) for k in ("css", "xpath") for n, x in getattr(got, k))
    return CrawlConfig(
        got.url, workers=got.workers, url_cap=got.limit, max_depth=got.max_depth, respect_robots=not got.ignore_robots, sitemap_urls=tuple(got.sitemap), discover_sitemaps=not got.no_sitemap_discovery, list_mode_only=got.list_mode,
        check_resources=got.check_resources, mobile=got.mobile, header_extractions=tuple(got.extract_header), extractions=rules, extra_headers=dict(got.header), basic_auth_user=got.user, basic_auth_password=got.password)


def credentials(path: str | None) -> services.Credentials:
    names = services.Credentials.__dataclass_fields__
    said = {n: os.environ[f"SITEAUDIT_{n.upper()}"] for n in names if f"SITEAUDIT_{n.upper()}" in os.environ}
    if path:
        with open(path, encoding="utf-8") as f:
            said |= {k: v for k, v in json.load(f).items() if k in names}
    return services.Credentials(**said)


def load(spark: SparkSession, path: str) -> Crawl:
    """A snapshot, or the folder of a crawl in rounds."""
    folder = rounds.Folder(spark, path)
    return folder.crawl() if folder.last() else Crawl.load(spark, path)


def run_crawl(spark: SparkSession, got: argparse.Namespace, ask=None) -> int:
    config = config_of(got)
    if normalise(got.url) is None:
        print(f"not a url that can be crawled: {got.url}", file=sys.stderr)
        return 2
    path = got.out or f"{rounds.host_of(config)}.crawl"
    if rounds.Folder(spark, path).last() and got.replace:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    began = time.time()
    crawl = rounds.crawl(spark, config, path, ask, got.round_size, got.max_rounds, lambda p: print(f"round {p.round}: crawled {p.crawled}, queued {p.queued}, discovered {p.discovered}", file=sys.stderr))
    for r in summary.summary(wide_view(crawl), crawl).collect():
        print(f"{r.metric}\t{r.value}")
    print(f"{path}: {time.time() - began:.0f} s", file=sys.stderr)
    return 0


def main(args: list[str]) -> int:
    got = arguments().parse_args(args)
    if got.do == "schedule":
        plan = Schedule(got.url, got.hour, got.minute, got.weekday)
        if found := plan.problems():
            print("; ".join(found), file=sys.stderr)
            return 2
        print(plan.line(sys.executable))
        return 0
    spark = SparkSession.builder.appName("siteaudit").getOrCreate()
    if got.do == "crawl":
        return run_crawl(spark, got)
    crawl = load(spark, got.crawl)
    if got.do == "compare":
        found = compare.compare(crawl, load(spark, got.before), got.limit)
        rows = [[r.url, r.field, r.before, r.after] for r in found["changes"].collect()]
        rows += [[r.url, "Added" if k == "added" else "Removed", None, None] for k in ("added", "removed") for r in found[k].collect()]
        sys.stdout.buffer.writelines(sinks.csv_bytes(["URL", "Field", "Before", "After"], rows, bom=False))
        return 0
    if got.do == "enrich":
        ask = services.asker(got.source, credentials(got.credentials), days=got.days)
        rows = providers.enrich(providers.urls_to_enrich(crawl, got.limit), got.source, ask).persist()
        for r in rows.where("metric IS NULL").collect():
            print(f"{r.url}: {r.text}", file=sys.stderr)
        # written beside the old table first: the new one is made from it
        metrics = written(providers.upsert_metrics(crawl, rows), "metrics")
        metrics.write.mode("overwrite").parquet(f"{got.crawl}/external_metrics.parquet")
        return 0
    pv = wide_view(crawl).persist()
    if got.do == "counts":
        for r in reports.findings(reports.counts(pv)).collect():
            print(f"{r.n}\t{r.severity}\t{r.report}: {r.filter}")
        return 0
    wanted = [r for r in all_reports() if not got.report or r.id in got.report]
    tables = [(r.name, [COLUMNS[i].header for i in r.columns], reports.table(pv, r, limit=got.limit).drop("id")) for r in wanted]
    for path in sinks.export(tables, got.out, got.format):
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
