"""Reports: summaries, lists, filters, the queue and its state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import present, trim
from auditloom.operators import scoring
from auditloom.operators.ranking import column_keys
from auditloom.schemas import COMPLETED, FAILED, QUEUED, RUNNING, STALE_SECONDS


def live(table: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted."""
    return table.where(~F.coalesce(F.col("deleted"), F.lit(False)))


# ---------------------------------------------------------------- summaries
def issue_rows(pages: DataFrame) -> DataFrame:
    """A row for each issue: report, page_id, page_score, pos, type, severity, message."""
    return pages.select("report", "page_id", "page_score", F.posexplode("issues").alias("pos", "i")).select("report", "page_id", "page_score", "pos", "i.*")


def issue_groups(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """type, severity and message as first seen (by score, page, position), count, and that first place."""
    order = F.struct("page_score", "page_id", "pos")
    rows = issue_rows(pages).withColumns({"type": F.coalesce("type", F.lit("unknown")), "severity": F.coalesce("severity", F.lit("notice")), "message": F.coalesce("message", "type", F.lit("unknown"))})
    return rows.groupBy(*(by or []), "type").agg(F.min_by("severity", order).alias("severity"), F.min_by("message", order).alias("message"), F.count("*").alias("count"), F.min(order).alias("first"))


def issue_summary(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """issue_groups(), most frequent first; equally frequent ones as first seen."""
    return issue_groups(pages, by).orderBy(*(by or []), F.desc("count"), "first").drop("first")


def page_type_summary(pages: DataFrame) -> DataFrame:
    has_error = F.exists("issues", lambda i: i["severity"] == "error")
    return pages.groupBy("report").agg(*(F.count_if(F.col("page_type") == t).alias(t) for t in ("html", "redirect", "resource")), F.count_if(has_error).alias("with_errors"))


def severity_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("report").agg(*(F.sum(scoring.severity_count(F.col("issues"), s)).alias(f"{s}s") for s in ("error", "warning", "notice")))


# ---------------------------------------------------------------- lists, filters, sorts
def pages_of(pages: DataFrame, report: int) -> DataFrame:
    """Pages of a report, worst first."""
    return pages.where(F.col("report") == report).orderBy("page_score", "page_id")


def latest(reports: DataFrame) -> DataFrame:
    return live(reports).orderBy(F.desc("crdate"), F.desc("uid"))


def by_uid(reports: DataFrame, uid: int) -> DataFrame:
    return live(reports).where(F.col("uid") == uid)


def is_empty(reports: DataFrame) -> bool:
    """Whether the list of reports shows its empty state. Starts a job."""
    return live(reports).isEmpty()


def queued(reports: DataFrame, limit: int = 5) -> DataFrame:
    """The next reports to crawl, oldest first; at least one."""
    return live(reports).where(F.col("status") == QUEUED).orderBy("queued_at", "crdate", "uid").limit(max(1, limit))


def search(table: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows with the query in one of the fields, in any case: url and page_title of pages, title and base_url of reports."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(present(F.col(f))).contains(query.lower())
    return table.where(hit)


def list_view(reports: DataFrame) -> DataFrame:
    """title, base URL, status, pages, budget, score (of completed reports only) and creation time."""
    return reports.select(
        "uid",
        "title",
        "base_url",
        scoring.status_label(F.col("status")).alias("status"),
        "pages_crawled",
        "max_pages",
        F.when(F.col("status") == COMPLETED, F.col("overall_score")).alias("score"),
        F.date_format(F.timestamp_seconds("crdate"), "dd.MM.yyyy HH:mm").alias("created"),
    )


def filtered(pages: DataFrame, text: str = "", page_type: str = "", severity: str = "", issue_type: str = "") -> DataFrame:
    """Pages that meet all conditions given: text in URL, title or messages; the type; an issue of the severity; one whose type contains issue_type."""
    words = F.lower(F.concat_ws(" ", "url", "page_title", F.transform("issues", lambda i: i["message"])))
    keep = F.lit(True)
    if text.strip():
        keep = keep & words.contains(text.strip().lower())
    if page_type:
        keep = keep & (F.col("page_type") == page_type)
    if severity:
        keep = keep & (scoring.severity_count(F.col("issues"), severity) > 0)
    if issue_type.strip():
        keep = keep & F.exists("issues", lambda i: F.lower(i["type"]).contains(issue_type.strip().lower()))
    return pages.where(keep)


def sorted_by(pages: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """By a column as a table in the browser sorts: numbers before texts, texts without regard to case and accents, ties by page."""
    return pages.orderBy(*column_keys(column, ascending), "page_id")


# ---------------------------------------------------------------- state machine; `now` is always passed in
def is_idle() -> Column:
    """Nothing has been crawled."""
    return (F.col("pages_crawled") <= 0) & (F.col("progress_pages") <= 0) & (trim(present(F.col("last_crawled_url"))) == "")


def is_stale(now: Column) -> Column:
    """A run that never started, or has shown no progress for STALE_SECONDS."""
    return (F.col("status") == RUNNING) & ((F.col("started_at") <= 0) | ((now - F.col("started_at") >= STALE_SECONDS) & is_idle()))


def can_queue() -> Column:
    return ~F.col("status").isin(RUNNING, QUEUED)


def can_start() -> Column:
    return F.col("status") == QUEUED


def queue(reports: DataFrame, chosen: Column, now: Column) -> DataFrame:
    """Puts chosen reports into the queue; counts and score of an earlier run stay."""
    go = chosen & can_queue()
    return updated(reports, go, status=F.lit(QUEUED), queued_at=now, started_at=F.lit(0), finished_at=F.lit(0), progress_pages=F.lit(0), last_crawled_url=F.lit(""), error_message=F.lit(""))


def reset_stale(reports: DataFrame, now: Column, go: Column | None = None) -> DataFrame:
    """Stale runs (or those where go holds) back in the queue."""
    go = is_stale(now) if go is None else go
    zero = dict.fromkeys(("started_at", "finished_at", "progress_pages", "pages_crawled", "overall_score"), F.lit(0))
    return updated(reports, go, status=F.lit(QUEUED), queued_at=now, last_crawled_url=F.lit(""), error_message=F.lit(""), **zero)


def begin(reports: DataFrame, go: Column, now: Column) -> DataFrame:
    """Running reports for those where go holds, whatever their status was."""
    zero = dict.fromkeys(("finished_at", "progress_pages", "pages_crawled", "overall_score", "robots_txt_status", "sitemap_status", "sitemap_url_count"), F.lit(0))
    empty = dict.fromkeys(("error_message", "last_crawled_url", "robots_txt_url", "robots_txt_sitemaps", "sitemap_url"), F.lit(""))
    return updated(reports, go, status=F.lit(RUNNING), queued_at=scoring.queue_time(F.col("queued_at"), now), started_at=now, **zero, **empty)


def start(reports: DataFrame, chosen: Column, now: Column) -> DataFrame:
    return begin(reports, chosen & can_start(), now)


def finish(reports: DataFrame, pages: DataFrame, scores: DataFrame, now: Column, chosen: Column | None = None) -> DataFrame:
    """Running (and chosen) reports, completed with the counts of their pages and their overall scores (report, overall_score)."""
    counts = pages.groupBy("report").agg(F.count("*").alias("_n")).join(scores.select("report", F.col("overall_score").alias("_score")), "report", "left").withColumnRenamed("report", "uid")
    rows = reports.join(counts, "uid", "left")
    go = (F.col("status") == RUNNING) & (F.lit(True) if chosen is None else chosen)
    done = updated(rows, go, status=F.lit(COMPLETED), finished_at=now, pages_crawled=F.coalesce("_n", F.lit(0)), progress_pages=F.coalesce("_n", F.lit(0)), overall_score=F.coalesce("_score", F.lit(0)))
    return done.select(*reports.columns)


def fail(reports: DataFrame, chosen: Column, message: Column, now: Column) -> DataFrame:
    return updated(reports, chosen & (F.col("status") == RUNNING), status=F.lit(FAILED), error_message=message, finished_at=now)


def without_reports(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of reports that aren't in gone (uid): for deletion, and to clear pages before a report is crawled again."""
    return table.join(gone.select(F.col("uid").alias(key)).distinct(), key, "left_anti").select(*table.columns)


def progress(pages: DataFrame) -> DataFrame:
    """report, progress_pages, last_crawled_url after the last of the pages (with crawl_order)."""
    return pages.groupBy("report").agg(F.max("crawl_order").alias("progress_pages"), F.max_by("url", "crawl_order").alias("last_crawled_url"))


def status_lines(reports: DataFrame) -> DataFrame:
    """uid, begins, ends: what the queue worker prints before and after each report."""
    begins = F.format_string("Processing report #%d: %s", "uid", "title")
    ends = F.format_string("Status: %s, pages crawled: %d, score: %d/100", scoring.status_label(F.col("status")), "pages_crawled", "overall_score")
    return reports.select("uid", begins.alias("begins"), ends.alias("ends"))


def updated(reports: DataFrame, go: Column, **new: Column) -> DataFrame:
    """reports with new values, cast to their columns' types, where go holds."""
    types = dict(reports.dtypes)
    # One projection: every new value and `go` read the row as it was.
    return reports.select(*(F.when(go, new[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in reports.columns))
