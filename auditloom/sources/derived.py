"""Small tables derived from the test tables or stated as literals, on which queries about reports, hops, sites and URLs run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.schemas import HOP, REPORT

#: The moment at which derived reports are looked at.
NOW = 1_700_000_000

HOPS = [
    ("http://a.example/1", 0, "http://a.example/1", 200, ""),
    ("http://a.example/2", 0, "http://a.example/2", 301, "/3"),
    ("http://a.example/2", 1, "http://a.example/3", 200, ""),
    ("http://a.example/4", 0, "http://a.example/4", 302, "//b.example/x"),
    ("http://a.example/4", 1, "http://b.example/x", 301, "y"),
    ("http://a.example/4", 2, "http://b.example/y", 404, ""),
    ("http://a.example/5", 0, "http://a.example/5", 301, ""),
    *(("http://a.example/6", i, f"http://a.example/6{'r' * i}", 307, f"/6{'r' * (i + 1)}") for i in range(5)),
    ("http://a.example/7", 0, "http://a.example/7", 500, ""),
]

#: base_url, robots body (None: not found), {sitemap path: (status, body)}.
SITES = [
    ("https://one.example", "User-agent: *\r\nSitemap: /s.xml\n SITEMAP : https://cdn.example/t.xml\nsitemap:\nSitemap: /s.xml", {"https://one.example/s.xml": (404, ""), "https://cdn.example/t.xml": (200, "<urlset><url/><url><loc>x</loc></url></urlset>")}),
    ("https://two.example/", None, {"https://two.example/sitemap.xml": (200, '<u:urlset xmlns:u="urn:x"><u:url/><u:url/><u:url/></u:urlset>')}),
    ("https://three.example", "Disallow: /", {"https://three.example/sitemap.xml": (500, ""), "https://three.example/sitemap_index.xml": (503, "")}),
    ("https://four.example", "", {"https://four.example/sitemap.xml": (404, ""), "https://four.example/sitemap_index.xml": (200, "<urlset><url></urlset>")}),
    ("https://five.example", "Sitemap: https://five.example/sitemap.xml", {}),
]

URLS = [
    "https://h.com", "https://h.com/x/?q=1#f", "http://u:p@h.com:8080/x", "#top", "/x/", "c", "//cdn.com/x", "../c", "?p=2", "", "  /y  ", "mailto:a@b.c", "tel:1", "javascript:0", "JavaScript:0", "HTTP://h.com/z",
    "https://H.com/X", "http://h.com/", "https://h.com//a//", "/f.PDF", "/f.html", "/a.b/c", "/archive.tar.gz", "/img.webp?x=1",
]
BASE = "https://h.com/a/b"

GUARDED = [
    "", "   ", "not a url", "ftp://h.com/", "http://", "http://localhost/", "http://intranet/", "http://x.local/", "http://a.localhost", "http://10.0.0.1/", "http://172.20.1.1", "http://172.40.1.1", "http://192.168.1.1:8080/x",
    "http://127.0.0.1", "http://169.254.1.1", "http://8.8.8.8/", "http://250.1.1.1", "https://example.com/", "https://example.com/a/b//", "HTTPS://Example.COM", "http://exa mple.com", "http://inside.example/", "mailto:a@b.c",
    "http://[::1]/", "http://[2001:db8::5]/x", "http://[2606:4700::1111]/", "http://[FE80::1]:8080/", "http://[::ffff:10.0.0.1]/", "http://[1::2::3]/", "https://u:p@[2a00:1450:4001:82b::200e]//", "http://[fdff:ffff::]", "http://[fe00::1]",
]
DNS = [("inside.example", ["192.168.0.5"]), ("example.com", ["93.184.216.34"])]


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports (schemas.REPORT) made of orders."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    none = F.when(k % 4 == 0, 0).otherwise(c % 60)
    columns = {
        "uid": k,
        "crdate": day + k % 97,
        "deleted": k % 13 == 0,
        "title": F.concat(F.lit("Report "), "o_orderpriority", F.lit(" "), k.cast("string")),
        "base_url": F.concat(F.lit("https://site"), (c % 50).cast("string"), F.lit(".example.com")),
        "status": k % 5,
        "pages_crawled": none,
        "progress_pages": none,
        "max_pages": c % 230 - 5,
        "overall_score": k % 101,
        "error_message": F.when(k % 5 == 3, "timeout").otherwise(""),
        "queued_at": day,
        "started_at": F.when(k % 6 == 0, 0).otherwise(F.lit(NOW) - k % 60),
        "finished_at": F.lit(0),
        "last_crawled_url": F.when(k % 3 == 0, "https://a/b").otherwise(" "),
        "robots_txt_status": F.lit(0),
        "sitemap_status": F.lit(0),
        "sitemap_url_count": F.lit(0),
    }
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(*(columns.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in REPORT))


def literals(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n bigint, {name} string")


def hops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOPS, HOP)


def sites(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(bases, probes) for sitechecks."""
    probes = []
    for base, body, maps in SITES:
        probes += [(base.rstrip("/") + "/robots.txt", 404 if body is None else 200, body or ""), *((u, s, b) for u, (s, b) in maps.items())]
    return spark.createDataFrame([(b,) for b, _, _ in SITES], "base_url string"), spark.createDataFrame(probes, "url string, status int, body string")
