"""The link graph laid out by key: links and pages in tables bucketed by report and URL, so that checks of links join bucket with bucket.

Laying out shuffles once. After that, finding broken links, or finding them again for other statuses of the same layout,
moves no row between tasks. Each normalised URL of a report has one page, the best scored; its links alone count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.urls import normalize_stored
from auditloom.operators import crosspage
from auditloom.operators.crawl import written

KEY = ["report", "key"]


class LinkGraph:
    """Tables <name>_pages (report, key, page_id, url, page_type, status_code, failed) and <name>_links (report, key of the target, page_id, pos)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        """path: the folder of the tables; the warehouse by default."""
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path

    def lay_out(self, pages: DataFrame) -> LinkGraph:
        """Writes both tables of audited pages, in place of earlier ones."""
        known = written(crosspage.resolved(pages), "resolved")
        self.write(known.drop("internal_links"), "pages")
        links = known.where("page_type = 'html'").select("report", "page_id", F.posexplode("internal_links").alias("pos", "link"))
        self.write(links.select("report", normalize_stored(F.col("link")).alias("key"), "page_id", "pos"), "links")
        return self

    def write(self, rows: DataFrame, kind: str) -> None:
        # Dealt as the buckets are, so that each task writes few files.
        dealt = rows.repartition(self.buckets, *KEY).write.format("parquet").mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        (dealt.option("path", f"{self.path}/{kind}") if self.path else dealt).saveAsTable(f"{self.name}_{kind}")

    def pages(self) -> DataFrame:
        return self.spark.table(f"{self.name}_pages")

    def links(self) -> DataFrame:
        return self.spark.table(f"{self.name}_links")

    def targets(self) -> DataFrame:
        """Each link with the page it leads to; links to pages that weren't crawled lead nowhere."""
        return self.links().join(self.pages().withColumnsRenamed({"page_id": "target_id"}).hint("merge"), KEY)

    def broken_links(self) -> DataFrame:
        """report, page_id, pos, url as crosspage.broken_links() gives them."""
        return self.targets().where(crosspage.is_broken()).select("report", "page_id", "pos", "url")

    def unlinked(self) -> DataFrame:
        """report, page_id, url of pages that no other page links to."""
        own = self.pages().hint("merge")
        links = self.links().select(*KEY, F.col("page_id").alias("source_id"))
        return own.join(links, (own.report == links.report) & (own.key == links.key) & (own.page_id != links.source_id), "left_anti").select("report", "page_id", "url")
