"""The web source against a small server on this machine."""

import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siteaudit.sources import web


class Site:
    def __init__(self) -> None:
        self.asked, self.now, self.most, self.lock = [], defaultdict(int), defaultdict(int), threading.Lock()

    def urls(self, n: int, hosts=("127.0.0.1", "localhost")) -> list[tuple[str, str]]:
        return [(f"http://{h}:{self.port}/p{i}", h) for h in hosts for i in range(n)]


@pytest.fixture(scope="module")
def site():
    out = Site()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            host = self.headers["Host"].split(":")[0]
            with out.lock:
                out.asked.append((time.monotonic(), host, self.path, self.command, self.headers.get("User-Agent")))
                out.now[host] += 1
                out.most[host] = max(out.most[host], out.now[host])
            time.sleep(0.03)
            with out.lock:
                out.now[host] -= 1
            body = f"<title>{self.path}</title>".encode()
            self.send_response(404 if self.path == "/p3" else 200)
            self.send_header("Content-Type", "text/html")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    out.port = server.server_port
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield out
    server.shutdown()


def table(spark, rows):
    return spark.createDataFrame(rows, "url string, host string")


def test_batch_keeps_the_limits_of_a_host(spark, site, tmp_path):
    web.register(spark)
    site.asked.clear()
    site.most.clear()
    web.deal(table(spark, site.urls(12)), str(tmp_path), per_host=2, buckets=8)
    got = spark.read.format(web.FORMAT).option("round", 1).option("header.User-Agent", "me/2").load(str(tmp_path))
    rows = got.collect()
    assert sorted(r.url for r in rows) == sorted(u for u, _ in site.urls(12)) and len(site.asked) == 24
    assert {r.status for r in rows if r.url.endswith("/p3")} == {404} and all(r.status == 200 for r in rows if not r.url.endswith("/p3"))
    assert all(r.html == f"<title>/{r.url.rpartition('/')[2]}</title>" and r.round == 1 for r in rows)
    assert max(site.most.values()) <= 2 and {a[4] for a in site.asked} == {"me/2"}
    assert got.rdd.getNumPartitions() <= 4  # slots of hosts, not urls


def test_delay_between_requests_of_a_host(spark, site, tmp_path):
    web.register(spark)
    site.asked.clear()
    web.deal(table(spark, site.urls(5)), str(tmp_path), per_host=4, delay=0.2)
    spark.read.format(web.FORMAT).option("delay", 0.2).load(str(tmp_path)).collect()
    for host in ("127.0.0.1", "localhost"):
        at = sorted(a[0] for a in site.asked if a[1] == host)
        assert len(at) == 5 and all(y - x >= 0.2 for x, y in zip(at, at[1:], strict=False))


def test_status_only_and_no_answer(spark, site, tmp_path):
    web.register(spark)
    site.asked.clear()
    rows = spark.createDataFrame([(f"http://127.0.0.1:{site.port}/a", "127.0.0.1", 1), ("http://127.0.0.1:1/", "none", 0), (None, "x", 0), ("not a url", "y", None)], "url string, host string, check_only int")
    web.deal(rows, str(tmp_path))
    got = {r.url: r for r in spark.read.format(web.FORMAT).load(str(tmp_path)).collect()}
    assert [a[3] for a in site.asked] == ["HEAD"] and got[f"http://127.0.0.1:{site.port}/a"].html is None
    assert got["http://127.0.0.1:1/"].error_kind == "cannotConnectToHost" and got["not a url"].status == 0 and len(got) == 3
    web.deal(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.format(web.FORMAT).load(str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="needs the folder"):
        spark.read.format(web.FORMAT).load().collect()


def test_stream_goes_on_and_asks_nothing_twice(spark, site, tmp_path):
    web.register(spark)
    site.asked.clear()
    frontier, out, mark = (str(tmp_path / n) for n in ("frontier", "out", "mark"))

    def run():
        reader = spark.readStream.format(web.FORMAT).load(frontier)
        reader.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)

    urls = site.urls(6)
    web.deal(table(spark, urls[:6]), frontier, round=1)
    run()
    assert len(site.asked) == 6
    web.deal(table(spark, urls[6:9]), frontier, round=2)
    web.deal(table(spark, urls[9:]), frontier, round=3)
    run()
    run()
    asked = [(h, p) for _, h, p, _, _ in site.asked]
    assert len(asked) == len(set(asked)) == 12
    assert sorted((r.round, r.url) for r in spark.read.parquet(out).collect()) == sorted([(1, u) for u, _ in urls[:6]] + [(2, u) for u, _ in urls[6:9]] + [(3, u) for u, _ in urls[9:]])


def test_hosts_take_turns():
    now, said = [0.0], []

    def sleep(s):
        now[0] += s

    for url, _ in web.in_turns(iter([("a1", "a", 0), ("a2", "a", 0), ("b1", "b", 0), ("a3", "a", 0)]), 2, lambda: now[0], sleep):
        said.append((round(now[0], 3), url))
    assert said == [(0, "a1"), (0, "b1"), (2, "a2"), (4, "a3")]
