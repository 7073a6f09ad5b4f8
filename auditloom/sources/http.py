"""Pages over HTTP as a fetch function and as a Python data source: redirects are recorded, slow hosts are tried again over IPv4.

Every address is checked before a request is made to it, redirect targets included.
"""

from __future__ import annotations

import http.client
import ipaddress
import re
import socket
import ssl
import time
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auditloom.functions.urls import PARTS

#: The request that is sent.
USER_AGENT = "auditloom/1.0"
ACCEPT_PAGE = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
ACCEPT_ROBOTS = "text/plain,*/*;q=0.8"
ACCEPT_SITEMAP = "application/xml,text/xml,text/plain;q=0.9,*/*;q=0.8"
CONNECT_SECONDS, TOTAL_SECONDS, MAX_REQUESTS = 10, 30, 5
#: What a timeout is called, the words by which one is known, and how the last attempt's failure is told.
TIMEOUT = "cURL error 28: Operation timed out"
TIMEOUTS = ("curl error 28", "ssl connection timeout", "operation timed out")
LAST_FAILURE = "Native cURL fallback failed: [%d] %s"

_DDL = "report bigint, page_id bigint, url string, status_code int, content_type_header string, html string, redirect_hops int, redirect_target string, redirect_final_url string, load_time bigint, fetch_error string"
_SCHEMA = pa.schema(
    [("report", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("status_code", pa.int32()), ("content_type_header", pa.string()), ("html", pa.string()), ("redirect_hops", pa.int32())]
    + [("redirect_target", pa.string()), ("redirect_final_url", pa.string()), ("load_time", pa.int64()), ("fetch_error", pa.string())]
)


def addresses(host: str, family: int = 0) -> list[str]:
    return list(dict.fromkeys(a[4][0] for a in socket.getaddrinfo(host, None, family, socket.SOCK_STREAM)))


def resolved(location: str, base: str) -> str:
    """The absolute URL of a redirect's location, as functions.urls.absolute gives it for columns."""
    if location.startswith(("http://", "https://")):
        return location
    known = re.match(PARTS, base)
    scheme, host, path = known.groups() if known else ("https", "", "")
    if location.startswith("//"):
        return f"{scheme}:{location}"
    if location.startswith("/"):
        return f"{scheme}://{host}{location}"
    return f"{scheme}://{host}{re.sub(r'/[^/]*/?$', '', path).rstrip('/')}/{location}"


def request(url: str, accept: str, allow_private: bool = False, family: int = 0) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body) of one GET, without following redirects. The address that was checked is the one connected to."""
    parts = urlsplit(url)
    found = [a for a in addresses(parts.hostname or "", family) if allow_private or ipaddress.ip_address(a).is_global]
    if parts.scheme not in ("http", "https") or not found:
        raise OSError("Private or local network targets are not allowed.")
    deadline = time.monotonic() + TOTAL_SECONDS
    port = parts.port or (443 if parts.scheme == "https" else 80)
    sock = conn = None
    try:
        sock = socket.create_connection((found[0], port), CONNECT_SECONDS)
        sock.settimeout(max(0.1, deadline - time.monotonic()))
        if parts.scheme == "https":
            sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
        conn = http.client.HTTPConnection(parts.hostname, port)
        conn.sock = sock
        conn.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": USER_AGENT, "Accept": accept, "Connection": "close"})
        answer = conn.getresponse()
        body = bytearray()
        while chunk := answer.read1(1 << 16):
            body += chunk
            left = deadline - time.monotonic()
            if left <= 0:
                raise TimeoutError
            sock.settimeout(left)
        return answer.status, {k.lower(): v for k, v in answer.getheaders()}, bytes(body)
    except TimeoutError as e:
        raise OSError(TIMEOUT) from e
    finally:
        for held in (conn, sock):
            if held is not None:
                held.close()


def attempt(url: str, accept: str, allow_private: bool = False, send=request) -> tuple[int, dict[str, str], bytes]:
    """send(), after a timeout again over IPv4, and after another one a last time, whose failure is told as such."""

    def timed_out(e: OSError) -> bool:
        return any(t in str(e).lower() for t in TIMEOUTS)

    try:
        return send(url, accept, allow_private)
    except OSError as e:
        if not timed_out(e):
            raise
    try:
        return send(url, accept, allow_private, socket.AF_INET)
    except OSError as e:
        if not timed_out(e):
            raise
    try:
        return send(url, accept, allow_private, socket.AF_INET)
    except OSError as e:
        raise OSError(LAST_FAILURE % (28 if timed_out(e) else 7, e)) from e


def fetch_one(url: str, allow_private: bool = False, get=attempt) -> tuple:
    """The response columns after url. A redirect without a location ends the chain; five redirects are too many."""
    began, at, first_status, target, hops = time.monotonic(), url, 0, "", 0
    ms = lambda: int((time.monotonic() - began) * 1000)
    try:
        for _ in range(MAX_REQUESTS):
            status, headers, body = get(at, ACCEPT_PAGE, allow_private)
            first_status = first_status or status
            location = headers.get("location", "").strip()
            if not 300 <= status < 400 or not location:
                final = at if hops and not 300 <= status < 400 else ""
                return first_status, headers.get("content-type", ""), body.decode("utf-8", "replace"), hops, target, final, ms(), ""
            at = resolved(location, at)
            target, hops = target or at, hops + 1
        raise OSError("Too many redirects while fetching URL.")
    except (OSError, http.client.HTTPException, ValueError) as e:
        return 0, "", "", 0, "", "", ms(), str(e) or type(e).__name__


def fetcher(parallelism: int = 64, allow_private: bool = False, get=attempt):
    """A fetch for crawl(): the URLs of a level are dealt out over tasks, and each task fetches its own one after another."""

    def fetch(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for report, page_id, url in zip(*(batch.column(c).to_pylist() for c in ("report", "page_id", "url"))):
                    row = (report, page_id, url, *fetch_one(url, allow_private, get))
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _SCHEMA)], schema=_SCHEMA)

        return wanted.select("report", "page_id", "url").repartition(parallelism, "url").mapInArrow(run, _DDL)

    return fetch


class PagesSource(DataSource):
    """spark.read.format("audit_http").option("urls", "http://a/ http://b/").load(): a response row for each URL."""

    @classmethod
    def name(cls) -> str:
        return "audit_http"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


class PagesReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.urls = options.get("urls", "").split()
        self.private = options.get("allow_private", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, u)) for i, u in enumerate(self.urls)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, url = partition.value
        yield (0, number, url, *fetch_one(url, self.private))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagesSource)
