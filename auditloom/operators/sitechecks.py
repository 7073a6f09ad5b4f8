"""robots.txt and sitemaps of a site, from the responses to the URLs that were probed."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from auditloom.functions import urls as U


@F.pandas_udf(LongType())
def sitemap_url_count(body: pd.Series) -> pd.Series:
    """Elements named url, in any namespace and depth; 0 for blank or broken XML."""

    def count(xml: str | None) -> int:
        try:
            return sum(1 for e in ElementTree.fromstring((xml or "").strip()).iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "url")
        except (ElementTree.ParseError, ValueError):
            return 0

    return body.map(count, na_action=None)


def robots(bases: DataFrame, probes: DataFrame) -> DataFrame:
    """base_url, robots_txt_url, robots_txt_status, sitemaps of bases (base_url) and probes (url, status, body).

    A file that wasn't found, or answered with anything but 200, names no sitemaps.
    """
    url = F.concat(U.rtrim_slash(F.col("base_url")), F.lit("/robots.txt"))
    rows = bases.select("base_url", url.alias("robots_txt_url")).join(probes.select(F.col("url").alias("robots_txt_url"), "status", "body"), "robots_txt_url", "left")
    found = F.when(F.col("status") == 200, U.robots_sitemaps(F.col("body"), F.col("robots_txt_url"))).otherwise(F.array().cast("array<string>"))
    return rows.select("base_url", "robots_txt_url", F.coalesce("status", F.lit(0)).alias("robots_txt_status"), found.alias("sitemaps"))


def sitemap_choice(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """base_url, sitemap_url, sitemap_status, sitemap_url_count of candidates (base_url, candidates array).

    The first candidate that answers 200 wins; if none does, the status is that of the last one tried, 0 if it failed.
    """
    tried = candidates.select("base_url", F.posexplode("candidates").alias("pos", "url")).join(probes.select("url", "status", "body"), "url", "left").withColumn("status", F.coalesce("status", F.lit(0)))
    win = F.when(F.col("status") == 200, F.col("pos"))
    picked = tried.groupBy("base_url").agg(F.min_by("url", win).alias("url"), F.min_by("body", win).alias("body"), F.min(win).alias("won"), F.max_by("status", "pos").alias("last"))
    return picked.select(
        "base_url",
        F.when(F.col("won").isNotNull(), F.col("url")).otherwise("").alias("sitemap_url"),
        F.when(F.col("won").isNotNull(), F.lit(200)).otherwise(F.col("last")).cast("bigint").alias("sitemap_status"),
        F.when(F.col("won").isNotNull(), sitemap_url_count(F.when(F.col("won").isNotNull(), F.col("body")))).otherwise(F.lit(0).cast("bigint")).alias("sitemap_url_count"),
    )


def site_checks(bases: DataFrame, probes: DataFrame) -> DataFrame:
    """All site-check columns of the report table, by base_url."""
    r = robots(bases, probes)
    choice = sitemap_choice(r.select("base_url", U.sitemap_candidates(F.col("sitemaps"), F.col("base_url")).alias("candidates")), probes)
    return r.join(choice, "base_url").select("base_url", "robots_txt_url", "robots_txt_status", F.to_json("sitemaps").alias("robots_txt_sitemaps"), "sitemap_url", "sitemap_status", "sitemap_url_count")


def redirect_folds(hops: DataFrame) -> DataFrame:
    """url, first_status, redirect_target, redirect_final_url, redirect_hops, too_many of a hop log (schemas.HOP).

    A redirect without a location ends the chain; the final URL is empty then, and where nothing redirected.
    """
    moved = F.col("status").between(300, 399) & (F.trim(F.coalesce("location", F.lit(""))) != "")
    target = F.when(moved, U.resolve_relative(F.trim("location"), F.col("request_url")))
    rows = hops.withColumn("moved", moved).withColumn("target", target)
    out = rows.groupBy("url").agg(
        F.min_by("status", "hop").alias("first_status"),
        F.min_by("target", F.when(F.col("moved"), F.col("hop"))).alias("target"),
        F.max_by("request_url", "hop").alias("last_url"),
        F.max_by("status", "hop").alias("last_status"),
        F.count_if("moved").alias("redirect_hops"),
    )
    ended = ~F.col("last_status").between(300, 399) & (F.col("redirect_hops") > 0)
    return out.select("url", "first_status", F.coalesce("target", F.lit("")).alias("redirect_target"), F.when(ended, F.col("last_url")).otherwise("").alias("redirect_final_url"), "redirect_hops", (F.col("redirect_hops") >= 5).alias("too_many"))


