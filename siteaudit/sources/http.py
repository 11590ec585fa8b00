"""Fetched pages as a DataFrame. Requests go out from executors: a host's urls are dealt to as many
slots as the host may be asked at once, and a slot asks for one url after the other, so that the
limit of a host holds without talk between tasks."""

from __future__ import annotations

import errno
import http.client
import json
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.decoding import decode
from siteaudit.functions.pdf import is_pdf
from siteaudit.functions.urls import normalise

SHAPE = "url string, status int, error_kind string, content_type string, content_length long, response_time_ms int, location string, headers_json string, html string, pdf binary"
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


#: Names of what can go wrong before there is an answer, by the kind of exception. The
#: first kind that fits counts, so narrower ones come first.
ERROR_KINDS: tuple[tuple[type[BaseException], str], ...] = (
    (TimeoutError, "timedOut"), (http.client.RemoteDisconnected, "networkConnectionLost"), (http.client.IncompleteRead, "networkConnectionLost"), (http.client.InvalidURL, "badURL"), (http.client.UnknownProtocol, "badServerResponse"),
    (http.client.BadStatusLine, "badServerResponse"), (http.client.LineTooLong, "cannotParseResponse"), (http.client.HTTPException, "cannotParseResponse"), (ssl.SSLError, "secureConnectionFailed"), (ConnectionRefusedError, "cannotConnectToHost"),
    (ConnectionResetError, "networkConnectionLost"), (ConnectionAbortedError, "networkConnectionLost"), (BrokenPipeError, "networkConnectionLost"), (ValueError, "badURL"),
)
_CERTIFICATE = {"expired": "serverCertificateHasBadDate", "not yet valid": "serverCertificateNotYetValid", "self-signed": "serverCertificateHasUnknownRoot", "self signed": "serverCertificateHasUnknownRoot", "unable to get local issuer": "serverCertificateHasUnknownRoot"}
_ERRNO = {errno.ENETUNREACH: "notConnectedToInternet", errno.ENETDOWN: "notConnectedToInternet", errno.EHOSTUNREACH: "cannotConnectToHost", errno.EADDRNOTAVAIL: "cannotConnectToHost", errno.ETIMEDOUT: "timedOut", errno.EACCES: "dataNotAllowed", errno.EMFILE: "resourceUnavailable", errno.ENFILE: "resourceUnavailable"}
_RESOLVER = {socket.EAI_NONAME: "cannotFindHost", socket.EAI_AGAIN: "dnsLookupFailed", socket.EAI_FAIL: "dnsLookupFailed"}


def error_kind(e: BaseException) -> str:
    """A name for what went wrong before there was an answer; what has none is ``urlError(n)`` with the
    system's number, -1 if there is none."""
    e = e.reason if isinstance(e, urllib.error.URLError) and isinstance(e.reason, BaseException) else e
    if isinstance(e, urllib.error.URLError) and "unknown url type" in str(e.reason):
        return "unsupportedURL"
    if isinstance(e, ssl.SSLCertVerificationError):
        said = (getattr(e, "verify_message", "") or str(e)).lower()
        return next((name for part, name in _CERTIFICATE.items() if part in said), "serverCertificateUntrusted")
    if isinstance(e, ssl.SSLError) and "certificate required" in str(e).lower():
        return "clientCertificateRejected"
    if isinstance(e, socket.gaierror):
        return _RESOLVER.get(e.errno, "cannotFindHost")
    known = next((name for kind, name in ERROR_KINDS if isinstance(e, kind)), None)
    number = getattr(e, "errno", None)
    return known or _ERRNO.get(number) or f"urlError({-1 if number is None else number})"


def request(url: str, method: str, headers: dict[str, str], timeout: float) -> dict:
    """One answer; redirects are not followed. ``status`` 0 stands for none. ``body`` is the raw body, for
    who asks from the driver."""
    opener = urllib.request.build_opener(_Stay)
    began = time.monotonic()
    try:
        with opener.open(urllib.request.Request(url, method=method, headers={"Accept": ACCEPT, **headers}), timeout=timeout) as r:
            status, found, body = r.status, dict(r.headers.items()), r.read()
    except urllib.error.HTTPError as e:
        status, found, body = e.code, dict(e.headers.items()), e.read()
    except (OSError, ValueError, http.client.HTTPException) as e:
        return {"url": url, "status": 0, "error_kind": error_kind(e), "response_time_ms": int((time.monotonic() - began) * 1000)}
    return answer(url, status, found, body, method, int((time.monotonic() - began) * 1000))


def answer(url: str, status: int, headers: dict[str, str], body: bytes, method: str, took: int) -> dict:
    low = {k.lower(): v for k, v in headers.items()}
    kind = low.get("content-type")
    told = low.get("content-length", "")
    size = len(body) if method == "GET" else int(told) if told.isdigit() else None  # what is not known stays NULL
    where = normalise(low["location"], url) if 300 <= status < 400 and low.get("location") else None
    text = decode(body, kind) if method == "GET" and kind and "html" in kind.lower() else None
    pdf = body if method == "GET" and text is None and body and is_pdf(body, kind) else None
    return {"body": body, "pdf": pdf, "url": url, "status": status, "content_type": kind.split(";")[0].strip() if kind else None, "content_length": size, "response_time_ms": took, "location": where, "headers_json": json.dumps(headers), "html": text}


def check_status(url: str, ask: Callable[[str, str], dict]) -> dict:
    """HEAD; GET where the server does not take it."""
    first = ask(url, "HEAD")
    return ask(url, "GET") if first["status"] in (405, 501) else first


def fetch(urls: DataFrame, headers: dict[str, str], timeout: float = 20, delay: float = 0, ask: Callable[[str, str], dict] | None = None, per_host: int = 1) -> DataFrame:
    """Answers for (url, host, check_only); ``per_host`` urls of a host are under way at once. With a
    ``delay`` between requests a host has one slot."""
    names = [c.split(" ")[0] for c in SHAPE.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = ask or (lambda url, method: request(url, method, headers, timeout))
        for part in parts:
            rows = []
            for url, only in zip(part["url"], part["check_only"], strict=True):
                got = check_status(url, one) if only else one(url, "GET")
                rows.append({k: got.get(k) for k in names})
                if delay:
                    time.sleep(delay)
            yield pd.DataFrame(rows, columns=names, dtype=object)

    # a number of its own: small tables are not to be put together in one partition again
    parts = max(per_host, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slot = F.pmod(F.xxhash64("url"), F.lit(1 if delay else max(1, per_host)))
    return urls.withColumn("slot", slot).repartition(parts, "host", "slot").select("url", "check_only").mapInPandas(run, SHAPE)
