"""Scores, labels, badges and counts of pages and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.text import trim
from auditloom.schemas import ISSUES, LEAST_MAX_PAGES, MOST_MAX_PAGES, STATUS_BADGES, STATUS_LABELS, WEIGHTS


def cases(c: Column, values: dict, default) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def page_score(issues: Column) -> Column:
    """100 less the weights of the issues, between 0 and 100; unknown severities cost nothing."""
    cost = F.aggregate(issues, F.lit(0), lambda a, i: a + cases(i["severity"], WEIGHTS, 0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - cost)).cast("int")


def severity_count(issues: Column, severity: str) -> Column:
    return F.size(F.filter(issues, lambda i: i["severity"] == severity)).cast("bigint")


def status_label(status: Column) -> Column:
    return cases(status, STATUS_LABELS, "Unknown")


def status_badge(status: Column) -> Column:
    return cases(status, STATUS_BADGES, "secondary")


def score_badge(score: Column) -> Column:
    return F.when(score >= 80, F.lit("success")).when(score >= 60, F.lit("warning")).otherwise(F.lit("danger"))


def probe_badge(status: Column) -> Column:
    """Of robots.txt and sitemap."""
    return F.when(status == 200, F.lit("success")).when(status == 0, F.lit("secondary")).when(status >= 400, F.lit("warning")).otherwise(F.lit("info"))


def http_class(status: Column) -> Column:
    return F.when(status >= 500, F.lit("danger")).when(status >= 400, F.lit("warning")).when(status >= 300, F.lit("info")).otherwise(F.lit("success"))


def page_type_label(kind: Column) -> Column:
    other = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 2**31 - 1))
    return cases(kind, {"html": "HTML", "redirect": "Redirect", "resource": "Resource", "": "Unknown"}, other)


def page_type_badge(kind: Column) -> Column:
    return cases(kind, {"html": "success", "redirect": "info"}, "secondary")


def progress_percent(progress: Column, most: Column) -> Column:
    return F.when(most <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.try_divide(100 * progress, most)).cast("int"))))


def page_budget(max_pages: Column) -> Column:
    return F.greatest(F.lit(LEAST_MAX_PAGES), F.least(F.lit(MOST_MAX_PAGES), max_pages))


def queue_time(queued_at: Column, now: Column) -> Column:
    return F.when(queued_at > 0, queued_at).otherwise(now)


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("yes")).otherwise(F.lit("no"))


def issues_from_json(text: Column) -> Column:
    """Empty for empty or broken JSON."""
    return F.coalesce(F.from_json(text, ISSUES), F.array().cast(ISSUES))


def strings_from_json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def issue_types(issues: Column) -> Column:
    return F.array_join(F.filter(F.array_distinct(F.transform(issues, lambda i: i["type"])), lambda t: t != ""), " | ")


def issue_messages(issues: Column) -> Column:
    return F.array_join(F.filter(F.transform(issues, lambda i: trim(i["message"])), lambda m: m != ""), " | ")
