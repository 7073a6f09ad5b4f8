"""Explicit schemas and the enumerations of the data model. Absence is the empty string or 0, never null."""

from __future__ import annotations

from pyspark.sql import types as T

ISSUE = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "severity", "message")])
ISSUES = T.ArrayType(ISSUE)

REPORT = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("crdate", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("title", T.StringType()),
        T.StructField("base_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("pages_crawled", T.LongType()),
        T.StructField("progress_pages", T.LongType()),
        T.StructField("max_pages", T.LongType()),
        T.StructField("overall_score", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("queued_at", T.LongType()),
        T.StructField("started_at", T.LongType()),
        T.StructField("finished_at", T.LongType()),
        T.StructField("last_crawled_url", T.StringType()),
        T.StructField("robots_txt_url", T.StringType()),
        T.StructField("robots_txt_status", T.IntegerType()),
        T.StructField("robots_txt_sitemaps", T.StringType()),
        T.StructField("sitemap_url", T.StringType()),
        T.StructField("sitemap_status", T.IntegerType()),
        T.StructField("sitemap_url_count", T.LongType()),
    ]
)

#: What the audit reads for each fetched URL. fetch_error is null or empty where the fetch succeeded.
RESPONSE = T.StructType(
    [
        T.StructField("report", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type_header", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("redirect_hops", T.IntegerType()),
        T.StructField("redirect_target", T.StringType()),
        T.StructField("redirect_final_url", T.StringType()),
        T.StructField("load_time", T.LongType()),
        T.StructField("fetch_error", T.StringType()),
    ]
)

HOP = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("hop", T.IntegerType()),
        T.StructField("request_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("location", T.StringType()),
    ]
)

#: Report states, their labels and badges, the points that issues cost, limits.
NEW, RUNNING, COMPLETED, FAILED, QUEUED = range(5)
STATUS_LABELS = {NEW: "New", RUNNING: "Running", COMPLETED: "Completed", FAILED: "Failed", QUEUED: "Queued"}
STATUS_BADGES = {NEW: "secondary", RUNNING: "info", COMPLETED: "success", FAILED: "danger", QUEUED: "warning"}

WEIGHTS = {"error": 15, "warning": 8, "notice": 3}
DEFAULT_MAX_PAGES, LEAST_MAX_PAGES, MOST_MAX_PAGES = 50, 1, 200
STALE_SECONDS = 30
