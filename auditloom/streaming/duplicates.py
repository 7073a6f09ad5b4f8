"""Duplicate titles and descriptions over a stream of audited pages, whatever the order in which they come.

State is keyed by report, issue type and value. The first page with a value waits there; when a second one comes, both are
told, and from then on each further page at once. State of a value is one page, later a mark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom.operators.crosspage import SHARED, shared_key
from auditloom.streaming.frontier import ROCKSDB

DUPLICATE = "report bigint, type string, page_id bigint"


class FirstWaits(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getListState("first", "page_id bigint")
        self.told = handle.getValueState("told", "several boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        report, kind, _ = key
        several = self.told.exists()
        held = [] if several else [p for (p,) in self.first.get()]
        for row in rows:
            if not several:
                held.append(row.page_id)
                if len(held) < 2:
                    continue
                several = True
                self.told.update((True,))
                self.first.clear()
                yield from (Row(report=report, type=kind, page_id=p) for p in held)
            else:
                yield Row(report=report, type=kind, page_id=row.page_id)
        if not several and held:
            self.first.put([(held[0],)])

    def close(self) -> None:
        pass


def keyed(pages: DataFrame) -> DataFrame:
    """report, type, key, page_id: a row for each value by which a page is compared."""
    values = F.array(*(F.struct(F.lit(kind).alias("type"), shared_key(column).alias("key")) for column, kind, *_ in SHARED))
    return pages.select("report", "page_id", F.explode(values).alias("v")).select("report", "v.type", "v.key", "page_id").where("key <> ''")


def duplicates(pages: DataFrame) -> DataFrame:
    """report, page_id, type, severity, message of the issues that a stream of audited pages raises, each once."""
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    found = keyed(pages).groupBy("report", "type", "key").transformWithState(FirstWaits(), DUPLICATE, "append", "none")
    said = lambda i: F.coalesce(*(F.when(F.col("type") == x[1], F.lit(x[i])) for x in SHARED))
    return found.select("report", "page_id", "type", said(2).alias("severity"), said(3).alias("message"))
