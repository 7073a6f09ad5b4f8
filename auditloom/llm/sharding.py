"""Extendible hashing: shards by hash prefixes, of which only oversized ones split on another bit.

The 60-bit hash of a row is 40 bits of its key's md5 and, below them, 20 bits that tell rows of one key apart. The
directory starts with one shard; a shard above its byte limit splits on the next bit until it fits, so shards have
different depths and rows of one key stay together unless the key alone is too large for a shard.

Byte totals are first summed by a prefix a few bits deeper than an even split needs (a row for each prefix, combined
before the shuffle), and shards are read off these totals level by level. Prefixes still too large there are summed
again some bits deeper, and only those, until all bits are used; a row that alone exceeds the limit has a shard to itself.

Edge cases: null texts count no bytes; null keys are hashed as a key of their own; repeated rows are told apart by a
number of the row, which is written with it, so they may split too; extra columns are carried; an empty table has no shards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import staged

KEY_BITS, ROW_BITS = 40, 20
BITS = KEY_BITS + ROW_BITS


def hash_of(key: Column, row: Column) -> Column:
    """A non-negative hash of BITS bits."""
    high = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    low = F.conv(F.substring(F.md5(row.cast("string")), 1, ROW_BITS // 4), 16, 10).cast("bigint")
    return F.shiftleft(high, ROW_BITS) + low


def prefix(h: Column, depth: Column | int) -> Column:
    """The first `depth` of BITS bits."""
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """depth, shard (the prefix of that depth), bytes, n_rows of all shards of rows (hash, bytes)."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, top, leaves = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + step)), 0, None
    open_ = None
    while True:
        counted = rows if open_ is None else rows.join(open_, prefix(F.col("hash"), top) == F.col("open"), "left_semi")
        cells = counted.groupBy(prefix(F.col("hash"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows"))
        levels = cells.select(F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"), "cell", "bytes", "n_rows")
        levels = levels.groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")).alias("shard")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        levels = staged(levels, "levels")
        fits = (F.col("bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") == BITS)
        large = levels.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        found = levels.where(fits)
        inner = found.where(F.col("depth") > top).join(large, (found["depth"] == large["depth"]) & (F.call_function("shiftright", F.col("shard"), F.lit(1)) == F.col("parent")), "left_semi")
        found = inner if top else inner.unionByName(found.where("depth = 0"))
        leaves = found if leaves is None else leaves.unionByName(found)
        open_ = staged(levels.where(~fits & (F.col("depth") == depth)).select(F.col("shard").alias("open")), "open")
        if open_.isEmpty():
            return leaves
        top, depth = depth, min(BITS, depth + 2 * step)


def assigned(rows: DataFrame, shards: DataFrame, max_broadcast_shards: int = 2_000_000) -> DataFrame:
    """rows (hash, ...) with a struct `at` (depth, shard, bytes, n_rows) of the shard whose prefix the hash has.

    Shards are disjoint ranges of hashes. A directory of up to max_broadcast_shards rows (32 bytes each) goes to the
    tasks and is searched there; a larger one is joined on the range's prefix at each depth that occurs.
    """
    if shards.count() <= max_broadcast_shards:
        table = shards.toArrow()
        depth, shard, size, n = (table.column(c).to_numpy() for c in ("depth", "shard", "bytes", "n_rows"))
        first = shard << (BITS - depth)
        order = np.argsort(first)
        found = rows.sparkSession.sparkContext.broadcast(tuple(x[order] for x in (first, depth, shard, size, n)))

        @F.pandas_udf("depth bigint, shard bigint, bytes bigint, n_rows bigint")
        def lookup(h: pd.Series) -> pd.DataFrame:
            first, *columns = found.value
            at = np.searchsorted(first, h.to_numpy(), side="right") - 1
            return pd.DataFrame({c: x[at].astype(np.int64) for c, x in zip(("depth", "shard", "bytes", "n_rows"), columns)})

        return rows.withColumn("at", lookup("hash"))
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # BITS + 1 numbers at most
    keys = rows.select("hash").distinct()
    keys = keys.select("hash", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("hash"), d).alias("shard")) for d in depths))).alias("k"))
    near = keys.select("hash", "k.*").join(shards, ["depth", "shard"]).select("hash", F.struct(F.col("depth").cast("bigint").alias("depth"), "shard", "bytes", "n_rows").alias("at"))
    return rows.join(near, "hash")


def sharded(docs: DataFrame, key: str = "doc_id", limit: int = 64 << 20) -> DataFrame:
    """docs with shard_depth, shard (prefix), shard_bytes, shard_rows. Bytes are those of text in UTF-8."""
    names = [c for c in docs.columns if c not in ("shard_depth", "shard", "shard_bytes", "shard_rows")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.monotonically_increasing_id().alias("_n"))
    rows = rows.select("_row", hash_of(F.col(f"_row.`{key}`"), F.col("_n")).alias("hash"), F.coalesce(F.octet_length("_row.text"), F.lit(0)).cast("bigint").alias("bytes"))
    rows = staged(rows, "hashed")  # so that a row has one hash, whatever its source does when it is read again
    out = assigned(rows.select("_row", "hash"), staged(directory(rows.select("hash", "bytes"), limit), "shards"))
    return out.select("_row.*", F.col("at.depth").alias("shard_depth"), F.col("at.shard").alias("shard"), F.col("at.bytes").alias("shard_bytes"), F.col("at.n_rows").alias("shard_rows"))


def write(docs: DataFrame, path: str, key: str = "doc_id", limit: int = 64 << 20) -> None:
    """A Parquet folder for each shard. Rows are dealt by shard, so a shard is written by one task and fits its memory."""
    rows = sharded(docs, key, limit)
    rows.repartition("shard_depth", "shard").write.partitionBy("shard_depth", "shard").parquet(path)
