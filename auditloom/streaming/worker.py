"""The audit as a stream: responses arrive as files, audited pages and their issue counts go out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.audit import audited
from auditloom.operators.reports import issue_rows
from auditloom.schemas import RESPONSE


def responses(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", max_files).parquet(folder)


def audited_stream(stream: DataFrame) -> DataFrame:
    """Single-page audits need no state; checks across pages run on the finished table."""
    return audited(stream)


def issue_counts(stream: DataFrame) -> DataFrame:
    """report, type, severity, n over all pages so far; the state has a row for each report and issue type."""
    return issue_rows(audited(stream)).groupBy("report", "type", "severity").agg(F.count("*").alias("n"))


def fetch_health(stream: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Windowed counts and failures of responses that carry fetched_at; windows close when the watermark passes."""
    timed = stream.withWatermark("fetched_at", late)
    return timed.groupBy(F.window("fetched_at", every), "report").agg(F.count("*").alias("n"), F.count_if((F.col("status_code") >= 400) | (F.col("status_code") == 0)).alias("bad"), F.avg("load_time").alias("load_time"))
