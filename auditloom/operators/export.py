"""Exports: rows and lines of both CSV files, the JSON document, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import csv_field, present
from auditloom.operators import scoring
from auditloom.operators.reports import issue_groups, issue_summary

#: The header rows, and the byte order mark that only the issues file has.
PAGE_HEADER = [
    "URL", "Page Type", "HTTP Status", "Content Type", "Redirect Target", "Redirect Final URL", "Redirect Hops", "Score", "Errors", "Warnings", "Notices", "Title", "Title Length", "Meta Description",
    "Meta Description Length", "H1 Count", "H1 Text", "H2 Count", "Canonical URL", "Robots Noindex", "Robots Nofollow", "Images Total", "Images Missing Alt", "Internal Links", "External Links", "Word Count",
    "Load Time (ms)", "Issue Types", "Issue Messages",
]
ISSUE_HEADER = ["Issue Type", "Severity", "Message", "Affected Pages"]
BOM = "﻿"


def page_rows(pages: DataFrame) -> DataFrame:
    """The 29 columns of the pages file as strings, with report, page_id and page_score to sort by."""
    i = F.col("issues")
    fields = {
        "url": F.col("url"), "page_type_label": scoring.page_type_label(F.col("page_type")), "status_code": F.col("status_code"), "content_type": F.col("content_type"), "redirect_target": F.col("redirect_target"),
        "redirect_final_url": F.col("redirect_final_url"), "redirect_hops": F.col("redirect_hops"), "score": F.col("page_score"), "errors": scoring.severity_count(i, "error"), "warnings": scoring.severity_count(i, "warning"),
        "notices": scoring.severity_count(i, "notice"), "title": F.col("page_title"), "title_length": F.col("title_length"), "meta_description": F.col("meta_description"),
        "meta_description_length": F.col("meta_description_length"), "h1_count": F.col("h1_count"), "h1_text": F.col("h1_text"), "h2_count": F.col("h2_count"), "canonical_url": F.col("canonical_url"),
        "robots_noindex": scoring.yes_no(F.col("robots_noindex")), "robots_nofollow": scoring.yes_no(F.col("robots_nofollow")), "images_total": F.col("images_total"), "images_missing_alt": F.col("images_missing_alt"),
        "links_internal": F.col("links_internal"), "links_external": F.col("links_external"), "word_count": F.col("word_count"), "load_time": F.col("load_time"), "issue_types": scoring.issue_types(i),
        "issue_messages": scoring.issue_messages(i),
    }
    return pages.select("report", "page_id", "page_score", *(present(v.cast("string")).alias(k) for k, v in fields.items()))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `line`, the CSV line of these columns."""
    return rows.withColumn("line", F.concat_ws(",", *(csv_field(present(F.col(c).cast("string"))) for c in columns)))


def page_lines(pages: DataFrame) -> DataFrame:
    rows = page_rows(pages)
    return csv_lines(rows, rows.columns[3:]).select("report", "page_id", "page_score", "line")


def issue_lines(pages: DataFrame) -> DataFrame:
    return csv_lines(issue_summary(pages), ["type", "severity", "message", "count"]).select("line")


def page_json(pages: DataFrame) -> DataFrame:
    """report, page_id, page_score and `page`, the struct of a page in the JSON document."""
    c, i = F.col, F.col("issues")
    names = {
        "url": c("url"), "pageType": c("page_type"), "pageTypeLabel": scoring.page_type_label(c("page_type")), "statusCode": c("status_code"), "contentType": c("content_type"), "redirectTarget": c("redirect_target"),
        "redirectFinalUrl": c("redirect_final_url"), "redirectHops": c("redirect_hops"), "score": c("page_score"), "errorCount": scoring.severity_count(i, "error"), "warningCount": scoring.severity_count(i, "warning"),
        "noticeCount": scoring.severity_count(i, "notice"), "title": c("page_title"), "titleLength": c("title_length"), "metaDescription": c("meta_description"), "metaDescriptionLength": c("meta_description_length"),
        "h1Count": c("h1_count"), "h1Text": c("h1_text"), "h2Count": c("h2_count"), "wordCount": c("word_count"), "loadTime": c("load_time"), "issues": i,
    }
    return pages.select("report", "page_id", "page_score", F.struct(*(v.alias(k) for k, v in names.items())).alias("page"))


def json_head(reports: DataFrame, pages: DataFrame) -> DataFrame:
    """uid, report_ (struct) and issuesSummary (array; one entry for each issue type) of each report."""
    head = F.struct(
        "uid", "title", F.col("base_url").alias("baseUrl"), scoring.status_label(F.col("status")).alias("status"), F.col("overall_score").alias("overallScore"), F.col("pages_crawled").alias("pagesCrawled"), F.col("max_pages").alias("maxPages")
    )
    groups = issue_groups(pages, ["report"]).select("report", F.struct((-F.col("count")).alias("n"), "first", F.struct("type", "severity", "message", "count").alias("s")).alias("g"))
    summary = groups.groupBy("report").agg(F.transform(F.array_sort(F.collect_list("g")), lambda x: x["s"]).alias("issuesSummary"))
    rows = reports.select("uid", head.alias("report_")).join(summary.withColumnRenamed("report", "uid"), "uid", "left")
    return rows.select("uid", "report_", F.coalesce("issuesSummary", F.array().cast(summary.schema["issuesSummary"].dataType)).alias("issuesSummary"))


def json_lines(reports: DataFrame, pages: DataFrame) -> DataFrame:
    """uid, kind, page_score, page_id, json: the parts of all documents, a row for each report's head and for each page, so that
    a report of any size is dealt out. In the order of (uid, page_score, page_id) they are the documents; heads have -1 for both."""
    heads = json_head(reports, pages).select("uid", F.lit("report").alias("kind"), F.lit(-1).alias("page_score"), F.lit(-1).cast("bigint").alias("page_id"), F.to_json(F.struct(F.col("report_").alias("report"), "issuesSummary")).alias("json"))
    parts = page_json(pages).select(F.col("report").alias("uid"), F.lit("page").alias("kind"), "page_score", "page_id", F.to_json("page").alias("json"))
    return heads.unionByName(parts.join(reports.select("uid"), "uid", "left_semi"))


def json_documents(reports: DataFrame, pages: DataFrame, most_pages: int = 200) -> DataFrame:
    """uid, document: each report with its issue summary and pages as one text, for reports of up to most_pages pages, the
    greatest budget there is. Larger ones are left to json_lines()."""
    small = pages.groupBy("report").agg(F.count("*").alias("n")).where(F.col("n") > most_pages).select(F.col("report").alias("uid"))
    reports = reports.join(small, "uid", "left_anti")
    pages = pages.join(small.withColumnRenamed("uid", "report"), "report", "left_anti")
    body = page_json(pages).groupBy("report").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_score", "page_id", "page"))), lambda x: x["page"]).alias("pages"))
    rows = json_head(reports, pages).join(body.withColumnRenamed("report", "uid"), "uid", "left")
    document = F.to_json(F.struct(F.col("report_").alias("report"), "issuesSummary", F.coalesce("pages", F.array().cast(body.schema["pages"].dataType)).alias("pages")), {"pretty": "true", "ignoreNullFields": "false"})
    return rows.select("uid", document.alias("document"))


def write_pages_csv(pages: DataFrame, path: str) -> None:
    """One folder of CSV parts for each report, worst pages first, without a header (PAGE_HEADER is its text)."""
    lines = page_lines(pages).repartition("report").sortWithinPartitions("report", "page_score", "page_id")
    lines.select("report", "line").write.partitionBy("report").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Replaces the pages of just those reports that occur in pages."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report").parquet(path)


def issues_csv(pages: DataFrame) -> str:
    """The issues file as text; a line for each issue type. Starts a job."""
    rows = [",".join(f'"{h}"' if " " in h else h for h in ISSUE_HEADER), *(r.line for r in issue_lines(pages).collect())]
    return BOM + "\n".join(rows) + "\n"
