"""Report summaries that are kept up to date as audited pages come in, micro-batch by micro-batch.

A new page can change earlier ones: its title makes an earlier title a duplicate, its status makes earlier links broken, its
better score makes it the page behind a URL. Each batch finds the pages that it adds or changes by their keys, checks just
these anew, retracts what the changed ones had counted and adds what they count now. What is written for an epoch:

- base: the batch's pages as audited one by one;
- final: the pages added or changed, with all their issues;
- deltas: signed sums for each report and issue type; the sums over all epochs are the summaries;
- firsts: for touched issue types, the issue that comes first; it is looked for anew only where a changed page held it.

All are partitioned by buckets of reports, as checks across pages never leave a report; so a batch reads the buckets of
its reports only. An epoch that runs again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from auditloom.functions.urls import normalize_stored
from auditloom.operators import crosspage, scoring
from auditloom.operators.audit import audited
from auditloom.operators.reports import issue_rows

SEVERITIES = ("error", "warning", "notice")
TYPES = ("html", "redirect", "resource")
PAGE = ["report", "page_id"]
FINAL = "report bigint, page_id bigint, page_type string, issues array<struct<type:string,severity:string,message:string>>, page_score int"
COUNTS = ["pages", "score", *TYPES, "with_errors", *(f"{s}s" for s in SEVERITIES)]
DELTAS = "report bigint, type string, n bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
FIRSTS = "report bigint, type string, first struct<page_score:int,page_id:bigint,pos:int>, severity string, message string"

class Rollup:
    """Summaries under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # ------------------------------------------------------------ the tables
    def bucket(self) -> Column:
        return F.pmod(F.col("report"), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, name: str, epoch: int) -> None:
        rows.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def read(self, name: str, schema: StructType | str, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the epochs up to one, of some buckets; epoch and bucket are partition columns, so the others aren't read."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        whole = StructType([*schema.fields]).add("epoch", "integer").add("bucket", "integer")
        try:
            rows = self.spark.read.schema(whole).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing is written yet
            rows = self.spark.createDataFrame([], whole)
        if upto is not None:
            rows = rows.where(F.col("epoch") <= upto)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    # ------------------------------------------------------------ a micro-batch
    def step(self, responses: DataFrame, epoch: int) -> None:
        """responses: schemas.RESPONSE rows of one micro-batch."""
        self.add(audited(responses), epoch)

    def add(self, pages: DataFrame, epoch: int) -> None:
        """pages: audited ones, each new."""
        columns = pages.columns
        # Keys of URLs are written, so that no later plan carries their expressions.
        targets = F.when(F.col("page_type") == "html", F.array_distinct(F.transform("internal_links", normalize_stored)))
        base = pages.withColumns({"url_key": normalize_stored(F.col("url")), "link_keys": targets})
        self.write(base, "base", epoch)
        known = self.read("base", base.schema, epoch)
        buckets = [r.bucket for r in known.where(F.col("epoch") == epoch).select("bucket").distinct().collect()]
        if not buckets:
            for name, schema in (("final", FINAL), ("deltas", DELTAS), ("firsts", FIRSTS)):
                self.write(self.spark.createDataFrame([], schema), name, epoch)
            return
        known = known.where(F.col("bucket").isin(buckets))
        new, old = known.where(F.col("epoch") == epoch), known.where(F.col("epoch") < epoch)
        changed = self.changed(new, old).withColumn("_old", F.lit(True))
        touched = known.join(changed, PAGE, "left").where((F.col("epoch") == epoch) | F.col("_old"))
        self.write(self.judged(touched, known, columns).select(*FINAL_COLUMNS), "final", epoch)
        after = self.read("final", FINAL, buckets=buckets).where(F.col("epoch") == epoch)
        before = self.current(epoch - 1, buckets).join(after.select(*PAGE), PAGE, "left_semi")
        self.write(merged(measured(after, 1).unionByName(measured(before, -1))), "deltas", epoch)
        self.write(self.first_issues(after, before, epoch, buckets), "firsts", epoch)

    def changed(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """report, page_id of earlier pages that the new ones may change."""
        found = []
        for column, *_ in crosspage.SHARED:
            key = crosspage.shared_key(column)
            keys = new.select("report", key.alias("key")).where("key <> ''").distinct()
            met = old.select("report", "page_id", key.alias("key")).where("key <> ''").join(keys, ["report", "key"], "left_semi")
            # Of two and more earlier ones, all have the issue already.
            found.append(met.groupBy("report", "key").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")).where("n = 1").select(*PAGE))
        urls = new.select("report", "url_key").distinct()
        found.append(old.join(urls, ["report", "url_key"], "left_semi").select(*PAGE))
        found.append(edges(old).join(urls, ["report", "url_key"], "left_semi").select(*PAGE))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def judged(self, touched: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
        """touched pages with the issues across pages that all known ones raise on them."""
        shared = []
        for column, *_ in crosspage.SHARED:
            keys = touched.select("report", crosspage.shared_key(column).alias("_key")).where("_key <> ''").distinct()
            with_key = known.withColumn("_key", crosspage.shared_key(column)).join(keys, ["report", "_key"], "left_semi")
            shared.append(crosspage.duplicate_groups(with_key, column))
        # Broken links of a page depend on the pages at its own URL and at those it links to.
        asked = touched.select("report", "url_key").unionByName(edges(touched).select("report", "url_key")).distinct()
        around = known.join(asked, ["report", "url_key"], "left_semi").select(*columns)
        return crosspage.applied(touched.select(*columns), shared, crosspage.broken_by_source(around))

    def current(self, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The last version of each page."""
        rows = self.read("final", FINAL, upto, buckets)
        last = F.max_by(F.struct("page_type", "issues", "page_score"), "epoch").alias("v")
        return rows.groupBy(*PAGE).agg(last).select(*PAGE, "v.*")

    def first_issues(self, after: DataFrame, before: DataFrame, epoch: int, buckets: list[int]) -> DataFrame:
        """FIRSTS of the issue types that the batch touches."""
        kept = latest_firsts(self.read("firsts", FIRSTS, epoch - 1, buckets))
        held = issue_rows(before).select("report", "type", *PAGE[1:]).distinct()
        lost = kept.join(held.withColumn("first_page", F.col("page_id")), (kept.report == held.report) & (kept.type == held.type) & (kept["first.page_id"] == F.col("first_page")), "left_semi").select("report", "type")
        touched = issue_rows(after).select("report", "type").unionByName(lost).distinct()
        anew = issue_rows(self.current(epoch, buckets).join(lost.select("report").distinct(), "report", "left_semi")).join(lost, ["report", "type"], "left_semi")
        fresh = firsts_of(issue_rows(after)).unionByName(firsts_of(anew)).unionByName(kept.join(lost, ["report", "type"], "left_anti"))
        return least(fresh.join(touched, ["report", "type"], "left_semi"))

    # ------------------------------------------------------------ summaries
    def sums(self) -> DataFrame:
        return merged(self.read("deltas", DELTAS).select(*DELTA_COLUMNS))

    def reports(self) -> DataFrame:
        """report, html, redirect, resource, with_errors, errors, warnings, notices, overall_score."""
        score = F.floor(F.col("score") / F.col("pages") + 0.5).cast("bigint")
        return self.sums().where("type is null and pages > 0").select("report", *TYPES, "with_errors", *(f"{s}s" for s in SEVERITIES), score.alias("overall_score"))

    def issue_summary(self, by: list[str] | None = None) -> DataFrame:
        """type, severity, message and count of issues, as reports.issue_summary() gives them; by ["report"] for each report."""
        counts = self.sums().where("type is not null and n > 0").select("report", "type", "n")
        rows = counts.join(latest_firsts(self.read("firsts", FIRSTS)), ["report", "type"])
        out = rows.groupBy(*(by or []), "type").agg(F.min_by("severity", "first").alias("severity"), F.min_by("message", "first").alias("message"), F.sum("n").alias("count"), F.min("first").alias("first"))
        return out.orderBy(*(by or []), F.desc("count"), "first").drop("first")

    def start(self, responses: DataFrame) -> StreamingQuery:
        """Keeps the summaries up to date with a stream of responses, until it is stopped."""
        return responses.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.folder}/checkpoint").start()


FINAL_COLUMNS = "report page_id page_type issues page_score".split()
DELTA_COLUMNS = ["report", "type", "n", *COUNTS]


def edges(pages: DataFrame) -> DataFrame:
    """report, page_id, url_key of the link targets of HTML pages."""
    return pages.select(*PAGE, F.explode("link_keys").alias("url_key"))


def measured(pages: DataFrame, sign: int) -> DataFrame:
    """DELTAS of pages, times sign: a row for each report, whose type is null, and one for each of its issue types."""
    one = F.lit(sign).cast("bigint")
    none = F.lit(0).cast("bigint")
    count = {"pages": one, "score": one * F.col("page_score"), **{t: F.when(F.col("page_type") == t, one).otherwise(none) for t in TYPES}, "with_errors": F.when(F.exists("issues", lambda i: i["severity"] == "error"), one).otherwise(none), **{f"{s}s": one * scoring.severity_count(F.col("issues"), s) for s in SEVERITIES}}
    own = pages.select("report", F.lit(None).cast("string").alias("type"), none.alias("n"), *(c.cast("bigint").alias(k) for k, c in count.items()))
    types = pages.select("report", F.explode("issues").alias("i")).select("report", F.coalesce("i.type", F.lit("unknown")).alias("type"), one.alias("n"), *(none.alias(c) for c in COUNTS))
    return own.unionByName(types)


def merged(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("report", "type").agg(*(F.sum(c).alias(c) for c in ("n", *COUNTS))).select(*DELTA_COLUMNS)


def firsts_of(issues: DataFrame) -> DataFrame:
    first = F.struct(F.col("page_score").cast("int").alias("page_score"), "page_id", F.col("pos").cast("int").alias("pos"))
    rows = issues.select("report", F.coalesce("type", F.lit("unknown")).alias("type"), first.alias("first"), F.coalesce("severity", F.lit("notice")).alias("severity"), F.coalesce("message", "type", F.lit("unknown")).alias("message"))
    return least(rows)


def least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("report", "type").agg(F.min("first").alias("first"), F.min_by("severity", "first").alias("severity"), F.min_by("message", "first").alias("message"))


def latest_firsts(rows: DataFrame) -> DataFrame:
    v = F.max_by(F.struct("first", "severity", "message"), "epoch").alias("v")
    return rows.groupBy("report", "type").agg(v).select("report", "type", "v.*")
