"""Token ids as ORC: integer run-length encoded id lists, row indexes and Bloom filters on the document id.

Files hold ascending document ids: rows are dealt by range and sorted before encoding, so that stripes cover disjoint
id ranges. Readers prune stripes by the row index, skip row groups by the Bloom filter, and read stripes in parallel.

Edge cases: a null text is an empty one and yields the end id alone; rows with a null document id come first; repeated
ids stay separate rows, in the order of a hash of their texts; extra columns aren't written; an empty table gives files without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import TokenBytes, crc32_of

END_ID = 2
_FILE = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encoder(tokenizer_path: str, end_id: int = END_ID):
    """mapInArrow function: (part, doc_id, text) in order -> rows of the file format. `first` counts the ids before a document within its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = TokenBytes.of(tokenizer_path), np.uint32(end_id).tobytes()
        at: dict[int, list[int]] = {}
        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [tokens.encode(t) + end for t in piece.column("text").to_pylist()]
                counts = [len(x) // 4 for x in ids]
                firsts, seqs = [], []
                for part, n in zip(piece.column("part").to_pylist(), counts):
                    held = at.setdefault(part, [0, 0])
                    firsts.append(held[0])
                    seqs.append(held[1])
                    held[0] += n
                    held[1] += 1
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").view(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), type=pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([piece.column("part"), pa.array(seqs, pa.int64()), piece.column("doc_id"), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), lists], schema=_FILE)

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, stripe_bytes: int = 64 << 20, index_stride: int = 10_000) -> None:
    """Writes documents (doc_id, text) to ORC files in ascending doc_id order."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("of_text"), F.monotonically_increasing_id().alias("row"))
    order = "doc_id", "of_text", "row"  # rows of one id, or without one, may fill several ranges
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(encoder(tokenizer_path, end_id), "part int, seq bigint, doc_id bigint, first bigint, n_tokens bigint, ids array<int>")
    options = {
        "orc.compress": "ZSTD",
        "orc.stripe.size": str(stripe_bytes),
        "orc.create.index": "true",
        "orc.row.index.stride": str(index_stride),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    rows.write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id, first, n_tokens, ids; a filter on doc_id reaches the stripes' indexes and Bloom filters."""
    return spark.read.schema("part int, seq bigint, doc_id bigint, first bigint, n_tokens bigint, ids array<int>").orc(path)


def checksums(tokens: DataFrame) -> DataFrame:
    """part, doc_id, first, n_tokens, ids_crc32 of the ids in the files."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, cuts = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            crcs = [crc32_of(flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("first"), pa.array(np.diff(cuts), pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    return tokens.select("part", "doc_id", "first", "ids").mapInArrow(run, "part int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")


def offsets(tokens: DataFrame) -> DataFrame:
    """part, before: ids in all parts before this one. A row for each part, summed from one column of the files."""
    from pyspark.sql import Window

    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the written files. The broadcast side has a row for each written part."""
    tokens = read(spark, path)
    return checksums(tokens).join(F.broadcast(offsets(tokens)), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
