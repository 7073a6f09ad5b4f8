"""Checks across the pages of a report: duplicate titles and descriptions, broken internal links, the overall score.

All keys include the report. Groups are counted before they are joined back, so that one title on most pages of a site
is combined map-side, and the join on it may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import trim
from auditloom.functions.urls import normalize_stored
from auditloom.operators.rules import append_if_missing
from auditloom.operators.scoring import page_score


def duplicate_groups(pages: DataFrame, column: str) -> DataFrame:
    """report, key (trimmed, lower case), n: values that two or more HTML pages of a report share."""
    keyed = pages.where("page_type = 'html'").select("report", F.lower(trim(F.col(column))).alias("key")).where("key <> ''")
    return keyed.groupBy("report", "key").agg(F.count("*").alias("n")).where("n >= 2")


def resolved(pages: DataFrame) -> DataFrame:
    """One page for each report and normalised URL: the best scored, then the one with the greatest number."""
    best = F.max_by(F.struct("page_id", "url", "page_type", "status_code", "internal_links", F.exists("issues", lambda i: i["type"] == "fetch_error").alias("failed")), F.struct("page_score", "page_id"))
    return pages.groupBy("report", normalize_stored(F.col("url")).alias("key")).agg(best.alias("page")).select("report", "key", "page.*")


def is_broken() -> Column:
    return (F.col("status_code") >= 400) | (F.col("status_code") == 0) | F.col("failed")


def broken_links(pages: DataFrame) -> DataFrame:
    """report, page_id, pos, url: links of HTML pages to crawled pages that are broken. Uncrawled targets and redirects aren't."""
    known = resolved(pages)
    edges = known.where("page_type = 'html'").select("report", "page_id", F.posexplode("internal_links").alias("pos", "link")).select("report", "page_id", "pos", normalize_stored(F.col("link")).alias("key"))
    return edges.join(known.where(is_broken()).select("report", "key", "url"), ["report", "key"]).select("report", "page_id", "pos", "url")


def broken_message(urls: Column) -> Column:
    """Of distinct URLs in order: their number, the first three, and how many more."""
    n = F.size(urls)
    head = F.when(n == 1, F.lit("Page contains 1 broken internal link")).otherwise(F.format_string("Page contains %d broken internal links", n))
    more = F.when(n > 3, F.format_string(" (+%d more)", n - 3)).otherwise(F.lit(""))
    return F.concat(head, F.lit(": "), F.array_join(F.slice(urls, 1, 3), ", "), more)


def broken_by_source(pages: DataFrame) -> DataFrame:
    """report, page_id, urls (distinct, in link order), message."""
    rows = broken_links(pages).groupBy("report", "page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("found"))
    rows = rows.select("report", "page_id", F.array_distinct(F.transform("found", lambda x: x["url"])).alias("urls"))
    return rows.withColumn("message", broken_message(F.col("urls")))


#: Issues of values that pages of a report share: column, type, severity, message.
SHARED = (
    ("page_title", "duplicate_title", "warning", "Page title is duplicated on multiple crawled pages"),
    ("meta_description", "duplicate_meta_description", "notice", "Meta description is duplicated on multiple crawled pages"),
)


def shared_key(column: str) -> Column:
    """What HTML pages are compared by; null of other pages."""
    return F.when(F.col("page_type") == "html", F.lower(trim(F.col(column))))


def checked(pages: DataFrame) -> DataFrame:
    """pages with the issues across pages appended in fixed order, and HTML pages that got one rescored.

    pages is read several times, so it should be a written table, not a plan that parses documents.
    """
    return applied(pages, [duplicate_groups(pages, column) for column, *_ in SHARED], broken_by_source(pages))


def applied(pages: DataFrame, shared: list[DataFrame], broken: DataFrame) -> DataFrame:
    """pages with the issues that groups of duplicates (one for each of SHARED) and broken links (broken_by_source) raise."""
    out = pages
    for (column, kind, severity, text), groups in zip(SHARED, shared):
        groups = groups.select("report", "key", F.lit(True).alias("_dup"))
        out = out.withColumn("key", shared_key(column)).join(groups, ["report", "key"], "left").drop("key")
        out = out.withColumn("issues", F.when(F.col("_dup"), append_if_missing(F.col("issues"), kind, severity, F.lit(text))).otherwise(F.col("issues"))).withColumnRenamed("_dup", f"_{column}")
    out = out.join(broken.select("report", "page_id", F.col("message").alias("_broken")), ["report", "page_id"], "left")
    out = out.withColumn("issues", F.when(F.col("_broken").isNotNull(), append_if_missing(F.col("issues"), "broken_internal_links", "error", F.col("_broken"))).otherwise(F.col("issues")))
    touched = F.col("_page_title").isNotNull() | F.col("_meta_description").isNotNull() | F.col("_broken").isNotNull()
    return out.withColumn("page_score", F.when(touched, page_score(F.col("issues"))).otherwise(F.col("page_score"))).select(*pages.columns)


def overall_scores(pages: DataFrame) -> DataFrame:
    """report, overall_score: the mean page score, rounded half up."""
    return pages.groupBy("report").agg(F.floor(F.sum("page_score") / F.count("*") + 0.5).cast("bigint").alias("overall_score"))
