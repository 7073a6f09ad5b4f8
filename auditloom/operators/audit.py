"""Fetched responses to audited pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import urls as U
from auditloom.functions.text import present, trim
from auditloom.operators import rules
from auditloom.operators.scoring import page_score

#: Columns of an audited page, in the order of the page table; internal_links (distinct, in order) serves the link graph.
PAGE_COLUMNS = (
    "report page_id url status_code page_type content_type redirect_target redirect_final_url redirect_hops page_title title_length meta_description meta_description_length h1_count h1_text h2_count "
    "canonical_url robots_noindex robots_nofollow images_total images_missing_alt links_internal links_external word_count load_time page_score issues internal_links"
).split()


def classified(responses: DataFrame) -> DataFrame:
    """Adds content_type and kind: failed, redirect, resource or html. Only html pages are read further."""
    ctype = U.content_type(F.col("content_type_header"))
    kind = F.when(present(F.col("fetch_error")) != "", F.lit("failed")).when(F.col("redirect_hops") > 0, F.lit("redirect")).when(U.is_html_type(ctype, F.col("url")), F.lit("html")).otherwise(F.lit("resource"))
    return responses.withColumn("content_type", ctype).withColumn("kind", kind)


def extracted(pages: DataFrame) -> DataFrame:
    """Facts of html pages; of others they are empty or 0. The document is dropped: no later plan carries it.

    Tags are cut out in one projection and read in the next, so that no pattern runs more often than once.
    """
    text = F.when(F.col("kind") == "html", present(F.col("html"))).otherwise("")
    rows = pages.withColumn("_html", text).withColumns({"_clean": H.cleaned(F.col("_html")), "_body": H.body_source(F.col("_html"))})
    clean, read = F.col("_clean"), F.col("_tags")
    rows = rows.select(
        *(F.col(c) for c in pages.columns if c != "html"),
        H.element_text(clean, "title").alias("page_title"),
        H.element_text(clean, "h1").alias("_h1"),
        H.read_tags(clean).alias("_tags"),
        H.body_text(F.col("_body")).alias("_text"),
    )
    rows = rows.withColumns(
        {
            "word_count": H.text_words(F.col("_text")),
            **{f"{h}_count": H.count_tags(read, h) for h in ("h1", "h2")},
            **{f"_{t}": H.tags(read, t) for t in ("meta", "link", "img")},
            "_links": H.links(H.tags(read, "a"), F.col("url")),
        }
    )
    meta = F.col("_meta")
    rows = rows.withColumns(
        {
            "meta_description": trim(present(H.first_content(meta, "name", "description", "content"))),
            "canonical_url": trim(present(H.first_content(F.col("_link"), "rel", "canonical", "href"))),
            "_robots": F.lower(present(H.first_content(meta, "name", "robots", "content"))),
            "has_og_title": H.first_content(meta, "property", "og:title", "content").isNotNull(),
            "has_og_description": H.first_content(meta, "property", "og:description", "content").isNotNull(),
            "images_total": F.size("_img").cast("bigint"),
            "images_missing_alt": F.size(F.filter("_img", lambda t: trim(H.attribute(t, "alt")) == "")).cast("bigint"),
            "_internal": F.transform(F.filter("_links", lambda x: x["internal"]), lambda x: x["url"]),
        }
    )
    return rows.withColumns(
        {
            "title_length": F.char_length("page_title").cast("bigint"),
            "meta_description_length": F.char_length("meta_description").cast("bigint"),
            "h1_text": F.substring("_h1", 1, 200),
            "robots_noindex": F.col("_robots").contains("noindex"),
            "robots_nofollow": F.col("_robots").contains("nofollow"),
            "links_internal": F.size("_internal").cast("bigint"),
            "links_external": (F.size("_links") - F.size("_internal")).cast("bigint"),
            "internal_links": F.array_distinct("_internal"),
        }
    ).drop("_h1", "_tags", "_text", "_meta", "_link", "_img", "_links", "_internal", "_robots")


def audited(responses: DataFrame) -> DataFrame:
    """Audited pages of responses (schemas.RESPONSE): facts, issues of single pages, score."""
    facts = extracted(classified(responses))
    kind = F.col("kind")
    raised = (
        F.when(kind == "failed", rules.issues(rules.failure_rules()))
        .when(kind == "redirect", rules.issues(rules.redirect_rules()))
        .when(kind == "resource", rules.issues(rules.resource_rules()))
        .otherwise(rules.issues(rules.html_rules()))
    )
    score = (
        F.when(kind == "failed", F.lit(0))
        .when(kind == "redirect", F.lit(100))
        .when(kind == "resource", F.when(F.col("status_code") >= 400, F.lit(0)).otherwise(F.lit(100)))
        .otherwise(page_score(F.col("issues")))
    )
    page_type = F.when(kind == "failed", F.lit("resource")).otherwise(kind)
    out = facts.withColumn("issues", raised).withColumn("page_score", score.cast("int")).withColumn("page_type", page_type)
    failed = kind == "failed"
    out = out.withColumns(
        {
            "status_code": F.when(failed, F.lit(0)).otherwise(F.col("status_code")),
            "content_type": F.when(failed, F.lit("")).otherwise(F.col("content_type")),
            **{c: F.when(kind == "redirect", F.col(c)).otherwise(F.lit("")) for c in ("redirect_target", "redirect_final_url")},
        }
    )
    return out.select(*PAGE_COLUMNS)
