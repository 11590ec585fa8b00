"""A crawl as rounds: claim, ask robots, fetch, parse, admit, mark, write.

A round is a few DataFrame steps over the queue; its tables are written to the crawl's folder, and
a last small table commits it. A crawl that was broken off goes on after its last committed round:
what the lost round had claimed is still in the queue there, and its tables are written anew.

The queue is kept as a base and the rows that each round changed or added; reading merges them. So a
round writes in proportion to itself. Once the changes since a base are more rows than the base, the
next commit names a new one; bases and changes that two newer bases have replaced are deleted. A base
counts from the commit that names it, so a crash while it is written costs nothing. Pages and references
are only added.
"""

from __future__ import annotations

import gzip
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from siteaudit.config import CrawlConfig
from siteaudit.functions import expressions as X
from siteaudit.functions import pdf, robots
from siteaudit.functions.html_facts import Facts
from siteaudit.functions.html_facts import parse as parse_html
from siteaudit.functions.urls import host_and_path, normalise, url_hash
from siteaudit.operators import extractions, frontier
from siteaudit.schema import DONE, SCHEMAS, SKIPPED
from siteaudit.sources import http, sitemaps
from siteaudit.sources.crawl import Crawl, conform
from siteaudit.sources.pages import parse_pages
from siteaudit.sources.tables import discard, remove, written

Ask = Callable[[str, str], dict]
Render = Callable[[str], dict | None]
ROBOTS_HOPS = 3
#: Tables to which each round adds.
ADDED = ("responses", "page_facts", "links", "images", "hreflang", "structured_data", "extractions", "resources", "simhash_bands")


#: A whole round: what was fetched and found, rows of the queue that changed, urls still queued, and the base
#: under its changes.
COMMIT = "round int, crawled long, discovered long, changed long, queued long, base int, at double, config_json string"


@dataclass(frozen=True)
class Progress:
    round: int
    crawled: int
    queued: int
    discovered: int


def site_rules(config: CrawlConfig, ask: Ask) -> tuple[robots.Policy, str]:
    """The seed host's robots rules and how they came: parsed, absent or unreachable. Redirects are
    followed ``ROBOTS_HOPS`` times."""
    at = normalise("/robots.txt", config.seed_url)
    if not config.respect_robots or at is None:
        return robots.ALLOW_ALL, "absent"
    for _ in range(ROBOTS_HOPS + 1):
        got = ask(at, "GET")
        if 300 <= got["status"] < 400:
            if not got.get("location"):
                break
            at = got["location"]
            continue
        policy = robots.from_response(got["status"], (got.get("body") or b"").decode("utf-8", "replace"))
        return policy, "parsed" if got["status"] == 200 else "unreachable" if policy is robots.DISALLOW_ALL else "absent"
    return robots.DISALLOW_ALL, "unreachable"


def _queue_rows(listed: DataFrame) -> DataFrame:
    """url, url_hash, host, path and order of (url, order); what is no url is left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known = [(u, url_hash(u), *host_and_path(u), n) for u, n in zip(map(normalise, part["url"]), part["order"], strict=True) if u]
            yield pd.DataFrame(known, columns=["url", "url_hash", "host", "path", "order"])

    return listed.select("url", "order").mapInPandas(run, "url string, url_hash binary, host string, path string, order long")


def seeded(spark: SparkSession, config: CrawlConfig, listed: DataFrame | None, now: float) -> DataFrame:
    """The queue before the first round: the seed and the seed list at depth 0, then what sitemaps list
    (url, ordinal)."""
    rules = config.rules()
    seeds = _queue_rows(spark.createDataFrame([(u, n) for n, u in enumerate((config.seed_url, *config.seed_list))], "url string, order long"))
    found = seeds.withColumns({"kind": F.lit("seed"), "nofollow": F.lit(False), "is_internal": frontier.is_internal(F.col("host"), rules).cast("int"), "parent_depth": F.lit(0), "parent_hops": F.lit(0)})
    urls = frontier.admit(spark.createDataFrame([], SCHEMAS["urls"]), frontier.follow(found, rules), rules, now)
    if listed is not None:
        urls = frontier.seed_sitemap(written(urls, "seeds"), _queue_rows(listed.withColumnRenamed("ordinal", "order")), rules, now)
    return urls


def _pdf_facts(answers: DataFrame) -> DataFrame:
    """Facts of fetched PDFs (url_id, pdf): what their metadata say."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said = [pdf.info(bytes(b)) for b in part["pdf"]]
            yield pd.DataFrame({"url_id": part["url_id"], **{k: [s[k] for s in said] for k in ("title", "meta_description", "lang")}})

    facts = answers.where("pdf IS NOT NULL").select("url_id", "pdf").mapInPandas(run, "url_id long, title string, meta_description string, lang string")
    return facts.withColumns({"title_count": F.col("title").isNotNull().cast("int"), "meta_description_count": F.col("meta_description").isNotNull().cast("int"), "title_length": F.length("title"), "meta_description_length": F.length("meta_description")})


@F.pandas_udf(BinaryType())
def _zipped(html: pd.Series) -> pd.Series:
    return html.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8", "surrogatepass"), mtime=0))


@dataclass
class Folder:
    """A crawl's folder: the queue as base and changes, what each round added, and which rounds are whole."""

    spark: SparkSession
    path: str

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits")

    def newest(self) -> Row | None:
        """The last whole round's commit."""
        try:
            return self.commits().orderBy(F.desc("round"), F.desc("at")).first()
        except AnalysisException:
            return None

    def last(self) -> int:
        newest = self.newest()
        return newest["round"] if newest else 0

    def counts(self) -> tuple[int, int]:
        """Urls crawled and discovered in all whole rounds."""
        row = self.commits().agg(F.sum("crawled"), F.sum("discovered")).first()
        return row[0] or 0, row[1] or 0

    def write(self, name: str, n: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/round={n}")

    def commit(self, n: int, crawled: int, discovered: int, changed: int, queued: int, base: int, config: CrawlConfig) -> None:
        row = self.spark.createDataFrame([(n, crawled, discovered, changed, queued, base, time.time(), config.to_json())], COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def start(self, urls: DataFrame, config: CrawlConfig) -> None:
        """The first round: the queue that a crawl begins with."""
        self.write("base", 1, urls)
        whole = self.spark.read.schema(SCHEMAS["urls"]).parquet(f"{self.path}/base/round=1")
        n, queued = whole.agg(F.count("*"), F.count_if(F.col("state") == 0)).first()
        self.commit(1, 0, n, 0, queued, 1, config)

    def queue(self, at: Row | None = None) -> DataFrame:
        """The queue after a commit (the last one): the base that it names, under the changes since."""
        at = at or self.newest()
        read = self.spark.read.schema(SCHEMAS["urls"])
        base = read.parquet(f"{self.path}/base/round={at['base']}")
        if at["round"] == at["base"]:
            return base
        rounds = [f"{self.path}/urls/round={n}" for n in range(at["base"] + 1, at["round"] + 1)]
        changes = self.spark.read.schema(SCHEMAS["urls"]).option("basePath", f"{self.path}/urls").parquet(*rounds)
        newest = changes.groupBy("id").agg(F.max_by(F.struct(*changes.columns), "round").alias("r")).select("r.*").drop("round")
        return base.join(changes.select("id"), "id", "left_anti").select(*base.columns).unionByName(newest.select(*base.columns))

    def finish(self, n: int, crawled: int, discovered: int, changed: int, queued: int, config: CrawlConfig) -> None:
        """Commit round ``n`` after its tables are written, on a new base if the changes have outgrown the old one."""
        before = self.newest()
        since = self.commits().where(F.col("round") > before["base"]).agg(F.sum("changed")).first()[0] or 0
        rows = self.commits().where(F.col("round") <= before["base"]).agg(F.sum("discovered")).first()[0] or 0
        base = before["base"]
        if since + changed > rows:
            self.write("base", n, self.queue(Row(round=n, base=base)))
            base = n
        self.commit(n, crawled, discovered, changed, queued, base, config)
        if base == n:
            bases = [r[0] for r in self.commits().select("base").distinct().orderBy(F.desc("base")).limit(3).collect()]
            if len(bases) == 3:
                remove(self.spark, f"{self.path}/base/round={bases[2]}")
                for old in range(bases[2] + 1, bases[1] + 1):
                    remove(self.spark, f"{self.path}/urls/round={old}")

    def crawl(self) -> Crawl:
        """The snapshot after the last whole round. A url that was fetched again has its last answer, and
        the references of its last page."""
        last, found = self.last(), {"urls": self.queue()}
        for name in ADDED:
            try:
                found[name] = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").where((F.col("round") >= 1) & (F.col("round") <= last))
            except AnalysisException:
                continue
        for name in ("responses", "page_facts"):
            if name in found:
                found[name] = frontier.latest(found[name], ["url_id"], "round")
        if "responses" in found:
            newest = found["responses"].select("url_id", F.col("round").alias("__newest"))
            for name in set(found) - {"urls", "responses", "page_facts"}:
                key = "from_url_id" if name == "links" else "url_id"
                found[name] = found[name].join(newest.withColumnRenamed("url_id", key), key).where("round = __newest")
        said = self.newest()
        first = self.commits().agg(F.min("at")).first()[0]
        config = CrawlConfig.from_json(said["config_json"])
        try:
            found["external_metrics"] = self.spark.read.parquet(f"{self.path}/external_metrics.parquet")
        except AnalysisException:
            pass
        found["crawl_meta"] = self.spark.createDataFrame([(1, normalise(config.seed_url), first, said["at"] if not said["queued"] else None, said["config_json"])], "id int, seed_url string, started_at double, finished_at double, config_json string")
        return Crawl.of(self.spark, **found)


RENDERED = "url_id long, dom string, render_ms int, js_errors string, rendered_words int, static_words int, perf_ttfb_ms int, perf_fcp_ms int, perf_lcp_ms int, perf_dcl_ms int, perf_load_ms int, perf_resources int, scripts map<string,string>"
MAX_ERRORS = 50


def rendered(pages: DataFrame, render: Render, parse: Callable[[str | None], Facts] = parse_html) -> DataFrame:
    """What a browser makes of (url_id, url, html). ``render(url)`` runs on the executors and gives html,
    elapsed_ms, errors, metrics (ttfb_ms, fcp_ms, lcp_ms, dcl_ms, load_ms, resources) and the results of
    the scripts; a page that it does not render keeps what was fetched."""
    names = [c.split(" ")[0] for c in RENDERED.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, url, html in zip(part["url_id"], part["url"], part["html"], strict=True):
                try:
                    got = render(url)
                except Exception:  # noqa: BLE001  a page that breaks the browser is still a page
                    continue
                if not got or got.get("html") is None:
                    continue
                errors = "\n".join(got.get("errors", [])[:MAX_ERRORS]) or None
                metrics = got.get("metrics", {})
                perf = [metrics.get(k) for k in ("ttfb_ms", "fcp_ms", "lcp_ms", "dcl_ms", "load_ms", "resources")]
                rows.append((i, got["html"], got.get("elapsed_ms"), errors, parse(got["html"]).word_count, parse(html).word_count, *perf, got.get("scripts") or {}))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return pages.select("url_id", "url", "html").mapInPandas(run, RENDERED)


def one_round(folder: Folder, n: int, urls: DataFrame, config: CrawlConfig, policy: robots.Policy, ask: Ask, limit: int, keep_bodies: bool, render: Render | None = None, parse: Callable[[str | None], Facts] = parse_html) -> tuple[int, int]:
    """Fetch the next urls of the queue and write what follows; how many were fetched and discovered.
    (-1, 0) if the queue is empty."""
    rules, now, agent = config.rules(), time.time(), config.headers()["User-Agent"]
    delay = policy.delay(agent) or 0
    # with a delay one task asks for one url after the other; a round then takes about ten minutes at most
    limit = max(1, min(limit, int(600 / delay))) if delay else limit
    claimed = written(frontier.claim(urls, limit, host_share(limit, config)), "claimed")
    queued = folder.newest()["queued"] - claimed.count()
    if claimed.isEmpty():
        discard(claimed)
        return -1, 0
    blocked = written(extractions.keep_out(claimed, policy, agent), "blocked") if config.respect_robots else claimed.select("id").limit(0)
    asked = claimed.join(blocked, "id", "left_anti")
    answers = http.fetch(asked, config.headers(), config.timeout, delay, ask, config.max_per_host)
    answers = written(answers.join(asked.select("url", F.col("id").alias("url_id"), "depth", "redirect_hops", "check_only"), "url"), "answers")
    pages, shown = answers.where("check_only = 0 AND html IS NOT NULL"), None
    if render is not None and config.render_javascript:
        shown = written(rendered(pages, render, parse), "rendered")
        dom = F.coalesce("dom", "html")
        pages = written(pages.join(shown.select("url_id", "dom"), "url_id", "left").withColumn("html", dom).drop("dom"), "pages")
        answers = written(answers.drop("html").join(pages.select("url_id", "html"), "url_id", "left").join(shown.drop("dom", "scripts").withColumn("rendered", F.lit(1)), "url_id", "left"), "answers")
    parsed = written(parse_pages(pages, parse).join(pages.select("url", "url_id", "depth", "redirect_hops"), "url"), "parsed")
    place = F.col("url_id") * (1 << 20)
    refs = parsed.select("url_id", "depth", "redirect_hops", F.posexplode("refs").alias("nth", "r")).select("url_id", "depth", "redirect_hops", (place + F.col("nth") + 1).alias("order"), "r.*")
    moved = answers.where("location IS NOT NULL").select("url_id", "depth", "redirect_hops", place.alias("order"), "location")
    parts = _split(moved)
    found = refs.select(F.col("hash").alias("url_hash"), "url", "host", "path", F.when(F.col("kind").isin("canonical", "hreflang"), F.lit("link")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "link", F.coalesce(F.array_contains(F.split(F.lower("rel"), r"\s+"), "nofollow"), F.lit(False))).otherwise(F.lit(False)).alias("nofollow"), F.col("depth").alias("parent_depth"), F.col("redirect_hops").alias("parent_hops"), "order")
    found = found.unionByName(parts.select("url_hash", "url", "host", "path", F.lit("redirect").alias("kind"), F.lit(False).alias("nofollow"), F.col("depth").alias("parent_depth"), F.col("redirect_hops").alias("parent_hops"), "order"))
    found = found.withColumn("is_internal", frontier.is_internal(F.col("host"), rules).cast("int"))
    fresh = written(frontier.admit(urls, frontier.follow(found, rules), rules, now), "fresh")
    marked = frontier.mark(claimed, asked, DONE)
    marked = frontier.mark(marked, blocked, SKIPPED, F.lit(frontier.BLOCKED))
    changes = written(marked.unionByName(fresh), "changes")

    known = ["url_hash", "id", "is_internal"]
    ids = urls.select(*known).unionByName(fresh.select(*known)).select(F.col("url_hash").alias("hash"), F.col("id").alias("to_id"), F.col("is_internal").alias("inside"))
    edges = written(refs.join(ids, "hash").select("url_id", "to_id", "kind", "text", "rel", "position", "width", "height", "inside"), "edges")
    of = lambda kind: edges.where(F.col("kind") == kind)
    target = parts.join(ids, parts.url_hash == ids.hash).select("url_id", F.col("to_id").alias("redirect_target_id"))
    canonical = of("canonical").groupBy("url_id").agg(F.min("to_id").alias("canonical_id"))
    robot = F.map_values(F.map_filter(F.from_json("headers_json", "map<string,string>"), lambda k, v: F.lower(k) == "x-robots-tag"))
    body = _zipped(F.col("html")) if keep_bodies else F.lit(None).cast("binary")
    responses = answers.join(target, "url_id", "left").withColumns({"fetched_at": F.lit(now), "body_gz": F.when(F.col("check_only") == 0, body)})
    facts = parsed.join(canonical, "url_id", "left").join(X.simhashes(parsed, "url_id", "visible_text"), "url_id", "left").join(answers.select("url_id", F.try_element_at(robot, F.lit(1)).alias("x_robots_tag")), "url_id", "left")
    facts = written(conform(facts, "page_facts").unionByName(conform(_pdf_facts(answers), "page_facts")), "facts")
    tables = {
        "responses": conform(responses, "responses"),
        "page_facts": facts,
        "links": of("link").select(F.col("url_id").alias("from_url_id"), F.col("to_id").alias("to_url_id"), F.col("text").alias("anchor_text"), "rel", F.col("inside").alias("is_internal"), "position"),
        "images": of("image").select("url_id", F.col("to_id").alias("src_url_id"), F.col("text").alias("alt"), "width", "height"),
        "hreflang": of("hreflang").select("url_id", F.col("text").alias("lang"), F.col("to_id").alias("href_url_id")),
        "resources": of("resource").select("url_id", F.col("to_id").alias("src_url_id"), F.col("text").alias("kind")),
        "structured_data": parsed.select("url_id", F.explode("structured").alias("s")).select("url_id", "s.format", "s.type"),
        "extractions": extractions.from_pages(pages, config.extractions).unionByName(extractions.from_headers(Crawl.of(folder.spark, responses=responses, page_facts=facts), config.header_extractions)),
        "simhash_bands": facts.where("simhash IS NOT NULL").select("url_id", F.explode(X.bands(F.col("simhash"))).alias("b")).select("url_id", "b.band", "b.value"),
    }
    if shown is not None:
        said = shown.select("url_id", F.explode(F.array_sort(F.map_entries("scripts"))).alias("e")).select("url_id", F.col("e.key").alias("name"), F.col("e.value").alias("value"), F.lit(0).alias("position"))
        tables["extractions"] = tables["extractions"].unionByName(said)
    for name, df in tables.items():
        folder.write(name, n, df)
    folder.write("urls", n, changes)
    crawled = answers.count()
    discovered, more = fresh.agg(F.count("*"), F.count_if(F.col("state") == 0)).first()
    folder.finish(n, crawled, discovered, changes.count(), queued + more, config)
    discard(claimed, blocked, answers, pages, parsed, fresh, changes, edges, facts, *([shown] if shown is not None else []))
    return crawled, discovered


def host_share(limit: int, config: CrawlConfig) -> int:
    """How many urls of a host a round may hold: as a host may have ``max_per_host`` of the ``workers``
    requests under way, so it has that share of a round."""
    return max(config.max_per_host, -(-limit * config.max_per_host // config.workers))


def _split(moved: DataFrame) -> DataFrame:
    """Redirect targets with the parts of their urls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            at = [host_and_path(u) for u in part["location"]]
            yield part.rename(columns={"location": "url"}).assign(url_hash=[url_hash(u) for u in part["location"]], host=[h for h, _ in at], path=[p for _, p in at])

    return moved.mapInPandas(run, "url_id long, depth int, redirect_hops int, order long, url string, url_hash binary, host string, path string")


def crawl(spark: SparkSession, config: CrawlConfig, path: str, ask: Ask | None = None, round_size: int = 10_000, max_rounds: int | None = None, on_progress: Callable[[Progress], None] | None = None, stop: Callable[[], bool] | None = None, render: Render | None = None, parse: Callable[[str | None], Facts] = parse_html) -> Crawl:
    """Crawl until the queue is empty, ``max_rounds`` are done or ``stop`` says so (between rounds, as a
    pause); called again with the same folder it goes on. ``ask(url, method)`` gives an answer as
    ``http.request`` does; it runs on the executors, and on the driver for robots. ``render``
    is a browser (see ``rendered``), ``parse`` another reader of html."""
    config = config.clamped()
    folder, one = Folder(spark, path), ask or _asker(config)
    policy, _ = site_rules(config, one)
    n = folder.last()
    if not n:
        listed = list(config.sitemap_urls) + (policy.sitemaps if config.discover_sitemaps else [])
        starting = spark.createDataFrame([(u, i) for i, u in enumerate(listed)], "url string, ordinal long")
        found = sitemaps.expand(starting, sitemaps.asked(one), config.max_sitemaps)[0] if listed else None
        n = 1
        folder.start(seeded(spark, config, found, time.time()), config)
    crawled, discovered = folder.counts()
    rounds = 0
    while (max_rounds is None or rounds < max_rounds) and not (stop and stop()):
        urls = frontier.reset_in_flight(folder.queue())
        got, new = one_round(folder, n + 1, urls, config, policy, one, round_size, config.retain_bodies and crawled < config.retain_body_url_limit, render, parse)
        if got < 0:
            break
        n, rounds, crawled, discovered = n + 1, rounds + 1, crawled + got, discovered + new
        if on_progress:
            on_progress(Progress(n, crawled, folder.newest()["queued"], discovered))
    return folder.crawl()


def _asker(config: CrawlConfig) -> Ask:
    headers, timeout = config.headers(), config.timeout
    return lambda url, method: http.request(url, method, headers, timeout)


def host_of(config: CrawlConfig) -> str:
    """The name of a crawl's folder where none is given."""
    return urlsplit(normalise(config.seed_url) or "").hostname or "crawl"
