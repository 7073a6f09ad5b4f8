"""Cost-balanced packing of documents into token sequences.

A sequence costs linear * tokens + quadratic * (sum of squared piece lengths), as attention within pieces does. Each
task packs its documents in blocks of bounded size: documents longer than a sequence give full sequences first, what
remains goes in descending length to the cheapest sequence that has room for all of it, and if none has, it is cut
over the cheapest ones. A block opens just as many sequences as its tokens need; the last, partial one is divided into
sequences of powers of two, which need no padding.

Edge cases: a null text is an empty one (the end id alone); null or repeated document ids are packed row by row; ties
in length keep the order of the rows; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import TokenBytes

END_ID = 2
_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def capacities(total: int, size: int, smallest: int = 64) -> list[int]:
    """Room of each sequence for `total` tokens: full ones, then powers of two; less than `smallest` shares one more."""
    out, rest = [size] * (total // size), total % size
    while rest >= smallest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out + ([1 << (rest - 1).bit_length()] if rest else [])


def pack(lengths: list[int], size: int = 4096, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents with these token counts."""
    pieces, sequence, rest = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            pieces.append((d, start, size, sequence, 0))
            sequence += 1
        if n % size:
            rest.append((n % size, d, n - n % size))
    rest.sort(key=lambda x: (-x[0], x[1]))
    rooms = capacities(sum(n for n, _, _ in rest), size)
    room, used = np.array(rooms, dtype=np.int64), np.zeros(len(rooms), dtype=np.int64)
    cost = np.zeros(len(rooms))

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, sequence + s, int(used[s])))
        used[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n, d, start in rest:
        s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[s] >= n:
            put(d, start, n, s)
            continue
        while n:
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
            m = int(min(n, room[s]))
            put(d, start, m, s)
            start, n = start + m, n - m
    return pieces


def packed(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = END_ID, block_tokens: int = 1 << 21) -> DataFrame:
    """The pieces of all documents, with their ids as little-endian uint32 bytes. sequence_id is the task's number, then a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, n_done = TokenBytes.of(tokenizer_path), np.uint32(end_id).tobytes(), 0
        part, held_ids, held, held_tokens = 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_done, held_ids, held, held_tokens
            rows = []
            for d, start, n, s, offset in pack([len(x) // 4 for x in held], size):
                ids = held[d][4 * start : 4 * (start + n)]
                rows.append((held_ids[d], start, n, zlib.crc32(ids) & 0xFFFFFFFF, len(held[d]) // 4, (part << 32) + n_done + s, offset, ids))
            n_done = max([n_done, *((r[5] & 0xFFFFFFFF) + 1 for r in rows)])
            held_ids, held, held_tokens = [], [], 0
            for i in range(0, len(rows), 2000):
                cut = list(zip(*rows[i : i + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cut, _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
                held_ids.append(doc_id)
                held.append(tokens.encode(text) + end)
                held_tokens += len(held[-1]) // 4
                if held_tokens >= block_tokens:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, _DDL)
