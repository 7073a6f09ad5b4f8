"""The rules that one page can break, in the order in which their issues are listed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    type: str
    severity: str
    fires: Column
    message: Column


def message(template: str, *args: Column | str) -> Column:
    return F.format_string(template, *(F.col(a) if isinstance(a, str) else a for a in args)) if args else F.lit(template)


# Fixed values, in the order in which issues are listed: types, severities, limits and messages.
def html_rules() -> list[Rule]:
    """Rules over the facts of an HTML page."""
    c = F.col
    return [
        Rule("http_error", "error", c("status_code") >= 400, message("HTTP error: %d", "status_code")),
        Rule("missing_title", "error", c("title_length") == 0, message("Page title is missing")),
        Rule("title_too_long", "warning", c("title_length") > 60, message("Title is too long (%d chars, max 60 recommended)", "title_length")),
        Rule("title_too_short", "warning", c("title_length").between(1, 9), message("Title is too short (%d chars, min 10 recommended)", "title_length")),
        Rule("missing_meta_description", "warning", c("meta_description_length") == 0, message("Meta description is missing")),
        Rule("meta_description_too_long", "notice", c("meta_description_length") > 160, message("Meta description is too long (%d chars, max 160 recommended)", "meta_description_length")),
        Rule("meta_description_too_short", "notice", c("meta_description_length").between(1, 49), message("Meta description is too short (%d chars, min 50 recommended)", "meta_description_length")),
        Rule("missing_h1", "error", c("h1_count") == 0, message("Page has no H1 heading")),
        Rule("multiple_h1", "warning", c("h1_count") > 1, message("Page has %d H1 headings (exactly 1 recommended)", "h1_count")),
        Rule("missing_canonical", "notice", c("canonical_url") == "", message("No canonical URL defined")),
        Rule("noindex", "warning", c("robots_noindex"), message("Page has noindex directive - it will not be indexed by search engines")),
        Rule("images_missing_alt", "warning", c("images_missing_alt") > 0, message("%d image(s) missing alt attributes", "images_missing_alt")),
        Rule("thin_content", "warning", (c("word_count") < 300) & (c("status_code") < 400), message("Thin content: %d words (min 300 recommended)", "word_count")),
        Rule("missing_og_title", "notice", ~c("has_og_title"), message("Missing Open Graph og:title meta tag")),
        Rule("missing_og_description", "notice", ~c("has_og_description"), message("Missing Open Graph og:description meta tag")),
    ]


def resource_rules() -> list[Rule]:
    kind = F.when(F.col("content_type") == "", F.lit("unknown content type")).otherwise(F.col("content_type"))
    return [
        Rule("http_error", "error", F.col("status_code") >= 400, message("HTTP error: %d", "status_code")),
        Rule("non_html_resource", "notice", F.lit(True), message("Skipped HTML checks for non-HTML resource (%s)", kind)),
    ]


def redirect_rules() -> list[Rule]:
    text = F.when(F.col("redirect_hops") == 1, F.lit("URL responded with a redirect")).otherwise(message("URL redirected %d times before reaching the final target", "redirect_hops"))
    return [Rule("redirect", "notice", F.lit(True), text)]


def failure_rules() -> list[Rule]:
    return [Rule("fetch_error", "error", F.lit(True), message("Failed to fetch page: %s", "fetch_error"))]


def issues(rules: list[Rule]) -> Column:
    """The issues that rules raise for a row, in their order."""
    raised = [F.when(r.fires, F.struct(F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), r.message.alias("message"))) for r in rules]
    return F.filter(F.array(*raised), lambda i: i.isNotNull())


def append_if_missing(have: Column, kind: str, severity: str, text: Column) -> Column:
    new = F.array(F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), text.alias("message")))
    return F.when(F.exists(have, lambda i: i["type"] == kind), have).otherwise(F.concat(have, new))
