"""The crawl as one stream: queue and visited URLs of a report are keyed state, and there is no loop over levels in the driver.

What pages lead to comes in as rows (report, parent, links), parent being a page's place in the crawl; a report's first
row has parent 0 and its start URL. State takes the rows of a report in the order of their parents, whenever they arrive,
gives each new URL the next place while the budget lasts, and sends it out at once. So a report's pages are fetched
together as far as they are known, in the order of a first-in-first-out queue. A micro-batch fetches and audits what was
sent out, commits the pages, and writes what they lead to where the stream reads on.

Rows may come twice, after a restart: state knows the parents it has taken. State of a report holds its budget of URLs
at most, and the links of pages that wait for earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from auditloom.functions import urls as U
from auditloom.operators.audit import audited
from auditloom.operators.scoring import page_budget
from auditloom.sources import page_table

FOUND = "report bigint, parent bigint, budget bigint, links array<string>"
ASKED = "report bigint, crawl_order bigint, url string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Frontier(StatefulProcessor):
    """State of a report: budget, URLs sent out, next parent; place by URL; links by parent that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "budget bigint, sent bigint, next bigint")
        self.places = handle.getMapState("places", "url string", "place bigint")
        self.waiting = handle.getMapState("waiting", "parent bigint", "links array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        budget, sent, parent = self.head.get() if self.head.exists() else (0, 0, 0)
        arrived: dict[int, list[str]] = {}
        for row in rows:
            budget = budget if row.budget is None else row.budget
            if row.parent >= parent:
                arrived.setdefault(row.parent, list(row.links or []))
        while True:
            if parent in arrived:
                links = arrived.pop(parent)
            elif self.waiting.containsKey((parent,)):
                links = list(self.waiting.getValue((parent,))[0])
                self.waiting.removeKey((parent,))
            else:
                break
            parent += 1
            for url in links:
                if sent < budget and not self.places.containsKey((url,)):
                    sent += 1
                    self.places.updateValue((url,), (sent,))
                    yield Row(report=key[0], crawl_order=sent, url=url)
        for late, links in arrived.items():
            self.waiting.updateValue((late,), (links,))
        self.head.update((budget, sent, parent))

    def close(self) -> None:
        pass


def leads(pages: DataFrame, bases: DataFrame) -> DataFrame:
    """FOUND rows of pages (with crawl_order): admissible URLs in link order, a redirect's target last."""
    none = F.array().cast("array<string>")
    target = F.when(F.col("redirect_final_url") != "", F.col("redirect_final_url")).otherwise(F.col("redirect_target"))
    found = F.concat(F.coalesce("internal_links", none), F.when(target != "", F.array(target)).otherwise(none))
    rows = pages.select("report", F.col("crawl_order").alias("parent"), found.alias("found")).join(bases.select("report", "base_url"), "report")
    rows = rows.withColumn("urls", F.transform("found", lambda x: U.normalize(x, F.col("base_url"))))
    return rows.select("report", "parent", F.lit(None).cast("bigint").alias("budget"), F.filter("urls", lambda u: admissible(u, F.col("base_url"))).alias("links"))


def admissible(url: Column, base: Column) -> Column:
    return url.isNotNull() & ~U.is_skipped(url) & U.same_domain(url, base)


class Crawl:
    """A crawl under a folder that all executors share; its state, queue and pages are there, and running it again goes on where it ended."""

    def __init__(self, spark: SparkSession, folder: str, fetch: Callable[[DataFrame], DataFrame]):
        """fetch takes (report, page_id, url) and returns responses; page_id is the place in the crawl."""
        self.spark, self.folder, self.fetch = spark, folder.rstrip("/"), fetch
        self.bases, self.inbox, self.table = f"{self.folder}/bases", f"{self.folder}/inbox", f"{self.folder}/pages"

    def begin(self, bases: DataFrame) -> None:
        """Enters reports (report, base_url, max_pages), once for each folder."""
        start = U.normalize(F.col("base_url"), F.col("base_url"))
        bases.select("report", "base_url", "max_pages").write.parquet(self.bases)
        rows = self.spark.read.parquet(self.bases).withColumn("start", start)
        first = F.when(F.col("start").isNotNull() & ~U.is_skipped(F.col("start")), F.array("start")).otherwise(F.array().cast("array<string>"))
        rows.select("report", F.lit(0).cast("bigint").alias("parent"), page_budget(F.col("max_pages")).cast("bigint").alias("budget"), first.alias("links")).write.parquet(f"{self.inbox}/start")

    def asked(self) -> DataFrame:
        """The stream of URLs to be fetched."""
        found = self.spark.readStream.schema(FOUND).parquet(f"{self.inbox}/*")
        return found.groupBy("report").transformWithState(Frontier(), ASKED, "append", "none")

    def step(self, asked: DataFrame, epoch: int) -> None:
        """Fetches and audits what an epoch asks for. Everything is keyed by the epoch: if it runs again, it replaces what it wrote."""
        own = lambda what: f"{self.folder}/{what}/epoch={epoch}"
        spark = asked.sparkSession
        asked.select("report", F.col("crawl_order").alias("page_id"), "url").write.mode("overwrite").parquet(own("asked"))
        wanted = spark.read.parquet(own("asked"))
        if wanted.isEmpty():
            return
        self.fetch(wanted).write.mode("overwrite").parquet(own("answers"))  # so that nothing is fetched twice
        audited(spark.read.parquet(own("answers"))).withColumn("crawl_order", F.col("page_id")).write.mode("overwrite").parquet(own("audited"))
        pages = spark.read.parquet(own("audited"))
        page_table.append(pages, self.table, query="crawl", epoch=epoch)
        leads(pages, spark.read.parquet(self.bases)).write.mode("overwrite").parquet(f"{self.inbox}/epoch{epoch}")

    def start(self) -> StreamingQuery:
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        return self.asked().writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.folder}/checkpoint").start()

    def run(self) -> DataFrame:
        """Crawls until no report has URLs left; all committed pages."""
        query = self.start()
        try:
            query.processAllAvailable()  # an epoch writes what the next one reads, so this ends with the last queue
        finally:
            query.stop()
        return self.pages()

    def pages(self) -> DataFrame:
        return page_table.pages(self.spark, self.table)

    def progress(self) -> DataFrame:
        return page_table.progress(self.spark, self.table)
