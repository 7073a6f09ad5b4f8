"""The queue of reports as a streaming source, `report_queue`, from which several workers take without taking one report twice.

`enqueue` writes queued reports in their order, and gives each a ticket: its place in the whole queue. What workers take are
ranges of tickets, each an entry in a log whose numbered entries can only be made once: who comes second makes the next one
instead. So claims are decided by files of a few bytes, and the driver handles no reports; tasks read the rows of a range
from the files that hold it.

A worker's offset is the number of its last claim in the log. A claim is made before its offset is noted; if the worker is
lost in between, its next start reads that claim first. A worker that never comes back can be replaced by one of its name.

The log needs a file system that refuses to link a name twice (local, or a mount that all workers share).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from auditloom.operators import reports as R
from auditloom.operators.ranking import ranked
from auditloom.schemas import QUEUED, REPORT

TICKETED = StructType([*REPORT.fields, StructField("ticket", LongType())])
LEAST_CLAIM = 5  # reports that a worker takes at once if it doesn't say


def local(path: str) -> str:
    path = path.rstrip("/")
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: claims need a mounted file system")
    return path


class Log:
    """Numbered entries, from 1; each number is given once."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def path(self, n: int) -> str:
        return f"{self.folder}/{n:012d}.json"

    def last(self) -> int:
        return max((int(f[:12]) for f in os.listdir(self.folder) if f.endswith(".json")), default=0)

    def read(self, n: int) -> dict:
        with open(self.path(n), encoding="utf-8") as f:
            return json.load(f)

    def add(self, n: int, entry: dict) -> bool:
        """False if there is an entry n already."""
        draft = f"{self.folder}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(entry, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, self.path(n))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)


class Queue:
    """What is queued and claimed under a folder. Tickets count from 0."""

    def __init__(self, path: str):
        self.root = local(path)
        self.queued, self.claims = Log(f"{self.root}/_queued"), Log(f"{self.root}/_claims")

    def size(self) -> int:
        """Tickets given out so far."""
        last = self.queued.last()
        return 0 if not last else (entry := self.queued.read(last))["first"] + entry["count"]

    def append(self, segment: str, files: list[list]) -> None:
        """Puts a segment (files: name, first and last place in it) behind all that is queued."""
        while True:
            last = self.queued.last()
            if self.queued.add(last + 1, {"segment": segment, "first": self.size() if last else 0, "count": max(f[2] for f in files), "files": files}):
                return

    def claim(self, worker: str, size: int) -> int:
        """Takes the next tickets, at most `size`, for a worker. The number of its last claim, 0 if it has none."""
        while True:
            last = self.claims.last()
            start = self.claims.read(last)["to"] if last else 0
            end = min(start + size, self.size())
            if end <= start:
                return next((n for n in range(last, 0, -1) if self.claims.read(n)["worker"] == worker), 0)
            if self.claims.add(last + 1, {"worker": worker, "from": start, "to": end}):
                return last + 1

    def slices(self, worker: str, after: int, upto: int) -> list[Slice]:
        """Where the reports are that a worker took by the claims after one number, up to another; a slice for each file."""
        own = [c for n in range(after + 1, upto + 1) if (c := self.claims.read(n))["worker"] == worker]
        if not own:
            return []
        out = []
        for n in range(self.queued.last(), 0, -1):
            entry = self.queued.read(n)
            first, end = entry["first"], entry["first"] + entry["count"]
            for c in own:
                low, high = max(c["from"], first) - first + 1, min(c["to"], end) - first  # places in the segment
                out += [Slice(f"{self.root}/segments/{entry['segment']}/{name}", first, max(low, a), min(high, b)) for name, a, b in entry["files"] if a <= high and b >= low and low <= high]
            if first <= own[0]["from"]:
                break
        return sorted(out, key=lambda s: s.before + s.low)


@dataclass
class Slice(InputPartition):
    """Places low to high of a file; a place's ticket is `before` + place - 1."""

    file: str
    before: int
    low: int
    high: int


class ClaimReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.worker, self.size = options["path"], options["worker"], int(options.get("size", LEAST_CLAIM))

    def initialOffset(self) -> dict:
        return {"claim": 0}

    def latestOffset(self) -> dict:
        return {"claim": Queue(self.path).claim(self.worker, max(1, self.size))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return Queue(self.path).slices(self.worker, start["claim"], end["claim"])

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        held = pq.read_table(partition.file, filters=[("place", ">=", partition.low), ("place", "<=", partition.high)]).sort_by("place")
        ticket = pc.add(held.column("place"), partition.before - 1)
        yield from held.select(REPORT.fieldNames()).append_column("ticket", ticket).to_batches()


class ReportQueue(DataSource):
    """Options: path; worker (its name); size (reports that a claim takes at most, 5)."""

    @classmethod
    def name(cls) -> str:
        return "report_queue"

    def schema(self) -> StructType:
        return TICKETED

    def streamReader(self, schema: StructType) -> ClaimReader:
        return ClaimReader(self.options)


def enqueue(reports: DataFrame, path: str) -> None:
    """Puts the live queued reports among these behind those that `path` holds; oldest first, as reports.queued orders them."""
    segment = uuid.uuid4().hex
    queue = Queue(path)
    rows = R.live(reports).where(F.col("status") == QUEUED)
    where = f"{queue.root}/segments/{segment}"
    ranked(rows, [F.col(c) for c in ("queued_at", "crdate", "uid")]).select(*REPORT.fieldNames(), "place").write.parquet(f"file://{where}")
    written = reports.sparkSession.read.parquet(f"file://{where}")
    files = written.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min("place").alias("first"), F.max("place").alias("last")).collect()  # a row for each file
    if files:
        queue.append(segment, sorted(([f.name, f.first, f.last] for f in files), key=lambda f: f[1]))


def taken(spark: SparkSession, path: str, worker: str, size: int = LEAST_CLAIM) -> DataFrame:
    """The stream of reports that a worker takes (schemas.REPORT, ticket), at most `size` at once."""
    spark.dataSource.register(ReportQueue)
    return spark.readStream.format("report_queue").options(path=path, worker=worker, size=str(size)).load()
