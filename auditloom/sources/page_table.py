"""A page table whose writes are committed as a whole: format `audit_pages`, for batches and streams.

Tasks write Parquet files of pages and, beside each, one with the progress of the reports in it. Nothing of that can be
seen until the driver's commit puts a list of the files into `_commits`, in one rename; so pages and progress appear
together. A commit that names a query and an epoch happens once: an epoch that comes again, after a restart, leaves no
second copy. Files of tasks that failed, or of writes that never committed, are on no list; `vacuum` removes them.

Only names of files and counts go through the driver. The folder has to be one that all executors share.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PROGRESS = "report bigint, pages bigint, crawl_order bigint, url string"
_PROGRESS = pa.schema([("report", pa.int64()), ("pages", pa.int64()), ("crawl_order", pa.int64()), ("url", pa.string())])
_MARK = "_commits"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    pages: list[str] = field(default_factory=list)
    progress: list[str] = field(default_factory=list)
    rows: int = 0


class Folder:
    """What is written and committed under a path."""

    def __init__(self, path: str):
        self.fs, self.root = file_system(path.rstrip("/"))

    def commits(self) -> list[str]:
        """Lists of files, in the order of their commits."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{_MARK}", allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".json"))

    def held(self) -> list[dict]:
        """The commits that count: those from the last one that replaced all pages."""
        out = []
        for path in self.commits():
            with self.fs.open_input_stream(path) as f:
                commit = json.loads(f.read())
            out = [commit] if commit["replaces"] else [*out, commit]
        return out

    def commit(self, name: str, messages: list[Written | None], schema: str, replaces: bool = False) -> bool:
        """Makes what was written seen, all at once. False, and the files go, if a commit of this name is there already."""
        done = self.commits()
        if any(p.endswith(f"-{name}.json") for p in done):
            self.drop(messages)
            return False
        known = [m for m in messages if m is not None]
        body = {"name": name, "replaces": replaces, "schema": schema, "rows": sum(m.rows for m in known), "pages": [p for m in known for p in m.pages], "progress": [p for m in known for p in m.progress]}
        self.fs.create_dir(f"{self.root}/{_MARK}", recursive=True)
        draft = f"{self.root}/{_MARK}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(body).encode())
        self.fs.move(draft, f"{self.root}/{_MARK}/{len(done):012d}-{name}.json")
        return True

    def drop(self, messages: list[Written | None]) -> None:
        for m in messages:
            for path in [*m.pages, *m.progress] if m is not None else ():
                if self.fs.get_file_info(f"{self.root}/{path}").type != pafs.FileType.NotFound:
                    self.fs.delete_file(f"{self.root}/{path}")

    def write(self, batches: Iterator[pa.RecordBatch], order: str) -> Written:
        """One task's files. If it fails, its own files go at once; a task that is killed leaves files that no commit names."""
        out, name, writers = Written(), f"{uuid.uuid4().hex}.parquet", {}
        for kind in ("pages", "progress"):
            self.fs.create_dir(f"{self.root}/{kind}", recursive=True)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not writers:
                    out.pages.append(f"pages/{name}")
                    writers["pages"] = pq.ParquetWriter(f"{self.root}/pages/{name}", batch.schema, filesystem=self.fs, compression="zstd")
                    out.progress.append(f"progress/{name}")
                    writers["progress"] = pq.ParquetWriter(f"{self.root}/progress/{name}", _PROGRESS, filesystem=self.fs)
                writers["pages"].write_batch(batch)
                writers["progress"].write_batch(progress_of(batch, order))
                out.rows += batch.num_rows
            for w in writers.values():
                w.close()
        except BaseException:
            self.drop([out])
            raise
        return out

    def vacuum(self, older_than_s: float = 86_400.0) -> int:
        """Removes files that no commit names and that no running write can still want."""
        named = {p for path in self.commits() for c in [json.loads(self.fs.open_input_stream(path).read())] for p in [*c["pages"], *c["progress"]]}
        gone = 0
        for kind in ("pages", "progress"):
            for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{kind}", allow_not_found=True)):
                if f"{kind}/{f.base_name}" not in named and time.time() - f.mtime.timestamp() >= older_than_s:
                    self.fs.delete_file(f.path)
                    gone += 1
        return gone


def progress_of(batch: pa.RecordBatch, order: str) -> pa.RecordBatch:
    """For each report in the batch: its pages, the greatest place in the crawl, the URL there."""
    found: dict[int, list] = {}
    for report, place, url in zip(*(batch.column(c).to_pylist() for c in ("report", order, "url"))):
        held = found.setdefault(report, [0, -1, ""])
        held[0] += 1
        if place is not None and place > held[1]:
            held[1:] = place, url
    return pa.RecordBatch.from_pylist([{"report": r, "pages": n, "crawl_order": place, "url": url} for r, (n, place, url) in found.items()], schema=_PROGRESS)


class PageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"], schema.json(), overwrite
        self.order = options.get("order", "crawl_order")
        self.name = f"{options['query']}-{int(options['epoch']):012d}" if "query" in options else f"batch-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Folder(self.path).write(iterator, self.order)

    def commit(self, messages: list) -> None:
        Folder(self.path).commit(self.name, messages, self.schema, self.overwrite)

    def abort(self, messages: list) -> None:
        Folder(self.path).drop(messages)


class PageStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema.json()
        self.order, self.query = options.get("order", "crawl_order"), options.get("query", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Folder(self.path).write(iterator, self.order)

    def commit(self, messages: list, batchId: int) -> None:
        Folder(self.path).commit(f"{self.query}-{batchId:012d}", messages, self.schema)

    def abort(self, messages: list, batchId: int) -> None:
        Folder(self.path).drop(messages)


class PageTable(DataSource):
    """Options: path; query and epoch (of a batch write: it happens once for each epoch; a stream passes its own); order (the column that
    holds a page's place in the crawl, crawl_order). Mode append adds pages, overwrite replaces all there are."""

    @classmethod
    def name(cls) -> str:
        return "audit_pages"

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> PageStreamWriter:
        return PageStreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageTable)


def append(pages: DataFrame, path: str, query: str | None = None, epoch: int | None = None, order: str = "crawl_order", overwrite: bool = False) -> None:
    """Writes pages in one commit, once for each epoch of a query if these are given."""
    register(pages.sparkSession)
    named = {} if query is None else {"query": query, "epoch": str(epoch)}
    pages.write.format("audit_pages").options(path=path, order=order, **named).mode("overwrite" if overwrite else "append").save()


def _files(spark: SparkSession, path: str, kind: str, schema: StructType | str | None) -> DataFrame:
    commits = Folder(path).held()
    if schema is None and not commits:
        raise ValueError(f"nothing is committed under {path}")
    schema = schema or StructType.fromJson(json.loads(commits[-1]["schema"]))
    files = [f"{path.rstrip('/')}/{p}" for c in commits for p in c[kind]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def pages(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All committed pages; filters and columns reach the files as with any Parquet table."""
    return _files(spark, path, "pages", schema)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """report, progress_pages (committed), last_crawled_url (that of the greatest place), as of the last commit."""
    rows = _files(spark, path, "progress", PROGRESS)
    return rows.groupBy("report").agg(F.sum("pages").alias("progress_pages"), F.max_by("url", "crawl_order").alias("last_crawled_url"))
