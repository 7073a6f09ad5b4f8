"""Breadth-first crawl, level by level, over any source of responses.

A level is one DataFrame job for all reports at once: fetch, audit, follow. The order within a level is that of a
first-in-first-out queue: by the parent's order, then the link's position, a redirect's final target after the links; a URL
found twice keeps its first place. Levels are written to a table, so neither lineage nor driver memory grows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.operators.audit import audited
from auditloom.operators.scoring import page_budget


def staging_path(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset, under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    path = staging_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def follow(pages: DataFrame, bases: DataFrame) -> DataFrame:
    """report, url, key (parent's order, position): the admissible URLs that pages (with crawl_order) lead to."""
    none = F.array().cast("array<string>")
    target = F.when(F.col("redirect_final_url") != "", F.col("redirect_final_url")).otherwise(F.col("redirect_target"))
    found = F.concat(F.coalesce("internal_links", none), F.when(target != "", F.array(target)).otherwise(none))
    links = pages.select("report", "crawl_order", F.posexplode(found).alias("pos", "link")).join(bases.select("report", "base_url"), "report")
    # Filters on what explode() makes stay above it; else each would carry a copy of the URL's expression.
    links = links.select("report", F.explode(F.array(U.normalize(F.col("link"), F.col("base_url")))).alias("url"), "base_url", F.struct("crawl_order", "pos").alias("key"))
    links = links.where(F.col("url").isNotNull() & ~U.is_skipped(F.col("url")) & U.same_domain(F.col("url"), F.col("base_url")))
    return links.groupBy("report", "url").agg(F.min("key").alias("key"))


def crawl(bases: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_levels: int = 200) -> DataFrame:
    """Audited pages with crawl_order (from 1) of bases (report, base_url, max_pages).

    fetch takes (report, page_id, url) and returns responses; page_id is the crawl order. Budgets bound the depth:
    a report has at most 200 pages, so it is done after 200 levels at most.
    """
    start = U.normalize(F.col("base_url"), F.col("base_url"))
    bases = written(bases.select("report", "base_url", start.alias("url"), page_budget(F.col("max_pages")).cast("bigint").alias("budget")), "bases")
    frontier = bases.select("report", "url", F.lit(0).cast("bigint").alias("done"), F.lit(1).cast("bigint").alias("rank")).where(F.col("url").isNotNull() & ~U.is_skipped(F.col("url")))
    done: list[DataFrame] = []
    for level in range(max_levels):
        room = frontier.join(bases.select("report", "budget"), "report").where(F.col("done") + F.col("rank") <= F.col("budget"))
        room = written(room.select("report", (F.col("done") + F.col("rank")).alias("page_id"), "url"), "frontier")
        if room.isEmpty():
            break
        answers = written(fetch(room), f"responses{level}")  # so that nothing is fetched twice
        pages = written(audited(answers).withColumn("crawl_order", F.col("page_id")), f"level{level}")
        done.append(pages)
        seen = done[0].select("report", "url")
        for earlier in done[1:]:
            seen = seen.unionByName(earlier.select("report", "url"))
        count = seen.groupBy("report").agg(F.count("*").alias("done"))
        new = follow(pages, bases).join(seen, ["report", "url"], "left_anti").join(count, "report")
        frontier = new.select("report", "url", "done", F.row_number().over(Window.partitionBy("report").orderBy("key")).cast("bigint").alias("rank"))
    if not done:
        return audited(fetch(bases.select("report", F.lit(0).cast("bigint").alias("page_id"), F.lit("").alias("url")).limit(0))).withColumn("crawl_order", F.col("page_id"))
    out = done[0]
    for pages in done[1:]:
        out = out.unionByName(pages)
    return out


def from_site_map(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch over a table of responses by url; a URL that it lacks answers 404."""
    own = responses.drop("report", "page_id").withColumn("_known", F.lit(True))

    def fetch(wanted: DataFrame) -> DataFrame:
        rows = wanted.join(own, "url", "left")
        missing = F.col("_known").isNull()
        return rows.withColumns({"status_code": F.when(missing, F.lit(404)).otherwise(F.col("status_code")), "content_type_header": F.when(missing, F.lit("text/html")).otherwise(F.col("content_type_header")), **{c: F.coalesce(c, F.lit("")) for c in ("html", "redirect_target", "redirect_final_url", "fetch_error")}, **{c: F.coalesce(c, F.lit(0)) for c in ("redirect_hops", "load_time")}}).drop("_known")

    return fetch
