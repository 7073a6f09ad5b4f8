"""What host names resolve to, looked up by tasks, for the guard."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.sources.http import addresses

_SCHEMA = pa.schema([("host", pa.string()), ("ips", pa.list_(pa.string()))])


def looked_up(hosts: DataFrame, resolve: Callable[[str], list[str]] = addresses, parallelism: int = 16) -> DataFrame:
    """host, ips of hosts (host); names that don't resolve have no addresses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = batch.column("host").to_pylist(), []
            for name in names:
                try:
                    found.append(list(resolve(name)))
                except (socket.gaierror, UnicodeError):
                    found.append([])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, _SCHEMA.field("ips").type)], schema=_SCHEMA)

    return hosts.select("host").repartition(parallelism, "host").mapInArrow(run, "host string, ips array<string>")
