"""The queue worker: takes queued reports through guard, crawl, checks and roll-up, all reports of a run in the same jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators import crosspage, guard, sitechecks
from auditloom.operators import reports as R
from auditloom.operators.crawl import crawl, written
from auditloom.schemas import FAILED

SITE_COLUMNS = "robots_txt_url robots_txt_status robots_txt_sitemaps sitemap_url sitemap_status sitemap_url_count".split()


@dataclass
class Outcome:
    """reports: all reports after the run; pages: the audited pages of this run; lines: what the worker prints."""

    reports: DataFrame
    pages: DataFrame
    lines: DataFrame


def process_queue(
    reports: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    now: Column,
    limit: int = 5,
    uid: int | None = None,
    probes: DataFrame | None = None,
    dns: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> Outcome:
    """Crawls the next `limit` queued reports, or the one named, whatever its status.

    A base URL that the guard refuses fails its report with the guard's message. dns says what hosts resolve to: a table
    (host, ips), or a function of hosts, such as sources.dns.looked_up. probes (url, status, body) are the answers to
    robots.txt and sitemap requests; without them the site checks stay empty. Reports are crawled in the same jobs; if
    these fail, one by one, and a report whose own jobs fail is FAILED with the error's message.
    """
    todo = R.queued(reports, limit) if uid is None else R.by_uid(reports, uid)
    if callable(dns):
        dns = written(dns(guard.hosts(todo)), "dns")
    verdicts = written(guard.guarded(todo.select("uid", "base_url"), dns).select("uid", "ok", "error", F.col("url").alias("guarded_url")), "verdicts")
    rows = R.begin(reports.join(verdicts, "uid", "left"), F.col("ok").isNotNull(), now)
    refused = F.col("ok").isNotNull() & ~F.col("ok")
    rows = R.updated(rows, refused, status=F.lit(FAILED), error_message=F.col("error"), finished_at=now)
    bases = written(rows.where("ok").select(F.col("uid").alias("report"), F.col("guarded_url").alias("base_url"), "max_pages"), "bases")
    pages, failures = crawled(bases, fetch)
    rows = R.finish(rows, pages, crosspage.overall_scores(pages), now, F.coalesce("ok", F.lit(False)) & ~F.col("uid").isin(list(failures)))
    for failed, message in failures.items():  # `limit` reports at most
        rows = R.fail(rows, F.col("uid") == failed, F.lit(message), now)
    if probes is not None:
        found = sitechecks.site_checks(bases.select("base_url").distinct(), probes)
        found = found.select(F.col("base_url").alias("guarded_url"), *(F.col(c).alias(f"new_{c}") for c in SITE_COLUMNS))
        rows = rows.join(found, "guarded_url", "left")
        rows = R.updated(rows, F.coalesce("ok", F.lit(False)) & F.col("new_robots_txt_url").isNotNull(), **{c: F.col(f"new_{c}") for c in SITE_COLUMNS})
    after = written(rows.select(*reports.columns), "reports")
    return Outcome(after, pages, R.status_lines(after.join(verdicts.select("uid"), "uid", "left_semi")))


def crawled(bases: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[int, str]]:
    """(checked pages of bases, written; the error of each report whose crawl failed)."""
    try:
        return written(crosspage.checked(crawl(bases, fetch)), "pages"), {}
    except (PySparkException, Py4JError, OSError, ValueError) as error:
        reports = [r.report for r in bases.select("report").collect()]
        if len(reports) == 1:
            return crosspage.checked(crawl(bases.where("false"), fetch)), {reports[0]: str(error)[:1000]}
    pages, failures = None, {}
    for report in reports:
        own, failed = crawled(bases.where(F.col("report") == report), fetch)
        pages, failures = own if pages is None else pages.unionByName(own), failures | failed
    return pages, failures
