"""Queries whose rows come out of streams: keyed crawl state, committed pages, duplicates as they arrive, roll-ups kept up to date,
silent runs, reports that workers take.

Each reads its whole table as files that arrive over several micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import crawl
from auditloom.plans import catalogue as C
from auditloom.plans import sql as S
from auditloom.schemas import RESPONSE, RUNNING
from auditloom.sources import crawl_view, derived, page_table, report_queue
from auditloom.streaming import duplicates, frontier, rollup, stale


def arriving(rows: DataFrame, batches: int = 4) -> DataFrame:
    """rows as a stream of about so many micro-batches."""
    spark = rows.sparkSession
    n = max(2 * batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = crawl.staging_path(spark, "arriving")
    rows.repartition(n, "page_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-n // batches)).parquet(path)


def finished(writer, spark: SparkSession, path: str | None = None) -> None:
    query = writer.option("checkpointLocation", crawl.staging_path(spark, "checkpoint")).trigger(availableNow=True)
    (query.start(path) if path else query.start()).awaitTermination()


@C.query(C.ORACLE_SQL["frontier_bfs"])
def frontier_stateful(spark, sf_dir):
    """frontier_bfs by keyed state instead of levels."""
    run = frontier.Crawl(spark, crawl.staging_path(spark, "crawl"), crawl.from_site_map(crawl_view.read(spark, sf_dir)))
    run.begin(C._bases(spark, sf_dir))
    return run.run().select("report", "crawl_order", "url", "status_code", "page_score")


def committed(spark: SparkSession, sf_dir: str) -> str:
    page_table.register(spark)
    path = crawl.staging_path(spark, "page-table")
    finished(arriving(C.stored(spark, sf_dir)).writeStream.format("audit_pages").option("path", path).option("order", "page_id"), spark)
    return path


@C.query(S.audit("SELECT report, page_id, url, CASE WHEN kind = 'failed' THEN 0 ELSE status_code END AS status_code, page_type, page_title, page_score, CAST(len(issues) AS BIGINT) AS n_issues FROM audited"))
def pages_committed(spark, sf_dir):
    """All audited pages, through the committing sink and back."""
    rows = page_table.pages(spark, committed(spark, sf_dir))
    return rows.select("report", "page_id", "url", "status_code", "page_type", "page_title", "page_score", F.size("issues").alias("n_issues"))


@C.query(S.audit("SELECT report, count(*) AS progress_pages, arg_max(url, page_id) AS last_crawled_url FROM audited GROUP BY report"))
def progress_committed(spark, sf_dir):
    """Progress of each report, as committed with its pages."""
    return page_table.progress(spark, committed(spark, sf_dir))


@C.query(S.cross("SELECT report, page_id, i.type AS type, i.severity AS severity, i.message AS message FROM issue_rows WHERE i.type IN ('duplicate_title', 'duplicate_meta_description')"))
def duplicates_streamed(spark, sf_dir):
    path = crawl.staging_path(spark, "duplicates")
    found = duplicates.duplicates(arriving(C.stored(spark, sf_dir)))
    finished(found.writeStream.format("parquet"), spark, path)
    return spark.read.schema(found.schema).parquet(path)


def rolled_up(spark: SparkSession, sf_dir: str) -> rollup.Rollup:
    out = rollup.Rollup(spark, crawl.staging_path(spark, "rollup"))
    stream = arriving(crawl_view.read(spark, sf_dir).select(*RESPONSE.fieldNames()))
    finished(stream.writeStream.foreachBatch(out.step), spark)
    return out


@C.query(S.cross(C._SUMMARY))
def rollup_issues(spark, sf_dir):
    """issue_summary, kept up to date over four micro-batches."""
    return rolled_up(spark, sf_dir).issue_summary()


@C.query(
    S.cross("""SELECT report, count(*) FILTER (page_type = 'html') AS html, count(*) FILTER (page_type = 'redirect') AS redirect, count(*) FILTER (page_type = 'resource') AS resource, count(*) FILTER (len(list_filter(issues, lambda x: x.severity = 'error')) > 0) AS with_errors,
    CAST(sum(len(list_filter(issues, lambda x: x.severity = 'error'))) AS BIGINT) AS errors, CAST(sum(len(list_filter(issues, lambda x: x.severity = 'warning'))) AS BIGINT) AS warnings, CAST(sum(len(list_filter(issues, lambda x: x.severity = 'notice'))) AS BIGINT) AS notices,
    CAST(floor(sum(page_score) / count(*) + 0.5) AS BIGINT) AS overall_score FROM final GROUP BY report""")
)
def rollup_reports(spark, sf_dir):
    """page_type_summary, severity_totals and overall_score, kept up to date over four micro-batches."""
    return rolled_up(spark, sf_dir).reports()


def replayed(reports: DataFrame) -> DataFrame:
    """A stream of what is heard of reports: runs that begin, then how all stand at derived.NOW, then a sign of life a minute later."""
    spark, path = reports.sparkSession, crawl.staging_path(reports.sparkSession, "changes")
    fields = [f.split()[0] for f in stale.CHANGE.split(", ")]
    begun = reports.where((F.col("status") == RUNNING) & (F.col("started_at") > 0)).withColumns({"seen_at": F.timestamp_seconds("started_at"), "pages_crawled": F.lit(0), "progress_pages": F.lit(0), "last_crawled_url": F.lit("")})
    stand = reports.withColumn("seen_at", F.timestamp_seconds(F.lit(derived.NOW)))
    life = spark.range(1).select(F.timestamp_seconds(F.lit(derived.NOW + 60)).alias("seen_at"), *(F.lit(None).alias(c) for c in fields if c != "seen_at"))
    schema = spark.createDataFrame([], stale.CHANGE).schema
    for i, rows in enumerate((begun, stand, life)):  # files are read in the order in which they were written
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(f"{path}/{i}")
    files = len(spark.read.schema(schema).parquet(f"{path}/*").inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{path}/*")  # so about four batches of any table


@C.query(C.ORACLE_SQL["stale_reset"])
def stale_streamed(spark, sf_dir):
    """stale_reset by timers, over replayed changes of all reports."""
    reports, path = derived.reports(spark, sf_dir), crawl.staging_path(spark, "silent")
    found = stale.silent(replayed(reports), late="60 seconds")
    finished(found.writeStream.format("parquet"), spark, path)
    return stale.requeued(reports, spark.read.schema(found.schema).parquet(path)).select("uid", "status", "queued_at", "started_at", "overall_score")


@C.query(S.reports("SELECT row_number() OVER (ORDER BY queued_at, crdate, uid) AS place, uid, queued_at, crdate FROM reports WHERE status = 4 AND NOT deleted"))
def queue_streamed(spark, sf_dir):
    """All queued reports in their order, taken by two workers at the same time."""
    path, out = crawl.staging_path(spark, "queue"), crawl.staging_path(spark, "taken")
    report_queue.enqueue(derived.reports(spark, sf_dir), path)
    size = max(report_queue.LEAST_CLAIM, -(-report_queue.Queue(path).size() // 8))
    streams = [report_queue.taken(spark, path, worker, size) for worker in ("a", "b")]
    running = [s.writeStream.format("parquet").option("checkpointLocation", crawl.staging_path(spark, "checkpoint")).start(f"{out}/{i}") for i, s in enumerate(streams)]
    for q in running:
        q.processAllAvailable()
    for q in running:
        q.stop()
    rows = [spark.read.schema(report_queue.TICKETED).parquet(f"{out}/{i}") for i in range(len(running))]
    return rows[0].unionByName(rows[1]).select((F.col("ticket") + 1).alias("place"), "uid", "queued_at", "crdate")
