"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

Documents fall into size classes by powers of two of their distinct five-word shingles. A class has a signature of
`load` coordinates for each shingle that its largest document may have, and a coordinate keeps the least hash that
falls on it (one-permutation MinHash), so signatures grow with the class and an item's containment, not the tiny
Jaccard similarity, decides how many coordinates agree. Items are signed for each class; one shared coordinate makes a
candidate, and the candidate's containment is counted exactly. With the default load an item's shingle survives on its
coordinate with probability over 0.88, so a contained item of ten shingles stays unseen with probability below 1e-7.
That says nothing for shorter items: all shingles of items with fewer than ten are looked up among all shingles of each
document, so none of those is missed.

An index over all items goes to the tasks if its shingles are few enough; beyond that the same search is done by joins.

Edge cases: null, empty and blank texts have no shingles, are never contaminated and contaminate nothing; a text of one
to four words is one shingle; repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import NEAR_SIMILARITY, SHINGLE_WORDS, chunks, fresh, rows_to_batch, staged, window_hashes, word_hashes

_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item_shingles", pa.int64())])
_PAIRS_DDL = "doc_id bigint, item_id bigint, n_shared bigint, n_item_shingles bigint"
_SHINGLES = pa.schema([("id", pa.int64()), ("hash", pa.int64())])
#: Coordinates for each shingle of a class's largest document, as a power of two.
LOAD_BITS = 2
#: Items with fewer shingles are looked up by all of them.
SIGNED_SHINGLES = 10


def shingles_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes (uint64) of each text."""
    words, counts = word_hashes(texts)
    at = 0
    for n in counts:
        yield np.unique(window_hashes(words[at : at + n], SHINGLE_WORDS))
        at += n


def size_class(n: int) -> int:
    """Bits of the signature of a text with n distinct shingles."""
    return max(1, int(n - 1).bit_length()) + LOAD_BITS


def signature(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The least of the ascending hashes on each of 2**bits coordinates, given by the top bits."""
    if not len(hashes):
        return hashes
    place = hashes >> np.uint64(64 - bits)
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    return hashes[first]


def exploded(table: DataFrame, key: str) -> DataFrame:
    """id, hash: the distinct shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                sets = list(shingles_of(texts))
                hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, s in zip(ids, sets) for _ in range(len(s))], pa.int64()), pa.array(hashes.view(np.int64))], schema=_SHINGLES)

    return table.select(F.col(key).cast("bigint").alias("id"), "text").mapInArrow(run, "id bigint, hash bigint")


class Index:
    """Items signed for every size class. Memory: 8 bytes for each distinct item shingle, again for those of short items, and for those of the others for each class in use."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, threshold: float):
        order = np.lexsort((hashes, ids))
        self.ids, self.hashes, self.threshold = ids[order], hashes[order], threshold
        starts = np.flatnonzero(np.r_[True, self.ids[1:] != self.ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        self.cuts = np.r_[starts, len(ids)].astype(np.int64)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.diff(self.cuts)
        short = np.repeat(sizes < SIGNED_SHINGLES, sizes)
        values, items = self.hashes[short], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[short]
        order = np.argsort(values, kind="stable")
        self.short = values[order], items[order]

    def of_class(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascending signature values of all items under this class, and the item of each."""
        if bits not in self.classes:
            parts = [signature(self.hashes[a:b] if b - a >= SIGNED_SHINGLES else self.hashes[:0], bits) for a, b in zip(self.cuts, self.cuts[1:])]
            values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            items = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            order = np.argsort(values, kind="stable")
            self.classes[bits] = values[order], items[order]
        return self.classes[bits]

    def search(self, shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, shared shingles, shingles of the item) for each item with at least the threshold's share inside."""
        if not len(shingles):
            return []
        bits = size_class(len(shingles))
        met: set[int] = set()
        for (values, items), own in ((self.of_class(bits), signature(shingles, bits)), (self.short, shingles)):
            if not len(values):
                continue
            lo = np.searchsorted(values, own)
            agree = values[np.minimum(lo, len(values) - 1)] == own
            if agree.any():
                hi = np.searchsorted(values, own[agree], side="right")
                met.update(int(i) for x, y in zip(lo[agree], hi) for i in items[x:y])
        out = []
        for item in sorted(met):
            wanted = self.hashes[self.cuts[item] : self.cuts[item + 1]]
            at = np.minimum(np.searchsorted(shingles, wanted), len(shingles) - 1)
            shared = int((shingles[at] == wanted).sum())
            if shared >= self.threshold * len(wanted) - 1e-9:
                out.append((int(self.ids[self.cuts[item]]), shared, len(wanted)))
        return out


def small_index(table: DataFrame, threshold: float, max_broadcast_shingles: int):
    """A broadcast index over the item shingles (id, hash), or None if there are more than max_broadcast_shingles (8 bytes each,
    and 12 again for each size class in use)."""
    if table.count() > max_broadcast_shingles:
        return None
    rows = table.toArrow()
    return table.sparkSession.sparkContext.broadcast(Index(rows.column("id").to_numpy(), rows.column("hash").to_numpy().view(np.uint64), threshold))


def item_shingles(items: DataFrame) -> DataFrame:
    return staged(exploded(items.where("item_id is not null"), "item_id").distinct(), "items")


def signed(sets: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """id, bits, value: the signatures of sets (id, hashes: all of a text's), under each of these classes or else their own.

    bits 0: all shingles, of items that are too short to be signed, or else of all texts.
    """
    schema = pa.schema([("id", pa.int64()), ("bits", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, hashes in zip(batch.column("id").to_pylist(), batch.column("hashes")):
                own = np.sort(np.asarray(hashes.values).view(np.uint64))
                if not len(own):
                    continue
                signs = {0: own} if classes is None or len(own) < SIGNED_SHINGLES else {}
                if classes is None or len(own) >= SIGNED_SHINGLES:
                    signs |= {bits: signature(own, bits) for bits in (classes if classes is not None else [size_class(len(own))])}
                for bits, values in signs.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i)), pa.array(np.full(len(values), bits, dtype=np.int32)), pa.array(values.view(np.int64))], schema=schema)

    return sets.select("id", "hashes").mapInArrow(run, "id bigint, bits int, value bigint")


def joined(docs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """row, item_id, n_shared, n_item_shingles for docs (row, text) and item shingles (id, hash) of any number.

    The same search as by an index, as joins: signatures meet on (size class, value), all shingles of short items on the
    shingle, and candidates' shared shingles are counted. A document is dealt out by its shingles, so none is a hot spot.
    """
    own = staged(exploded(docs, "row"), "shingles")
    sets = staged(own.groupBy("id").agg(F.collect_list("hash").alias("hashes")), "sets")
    longest = sets.agg(F.max(F.size("hashes"))).first()[0] or 1
    items = table.groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    met = signed(sets).join(signed(items, list(range(size_class(1), size_class(longest) + 1))).withColumnRenamed("id", "item_id"), ["bits", "value"])
    met = staged(met.select(F.col("id").alias("row"), "item_id").distinct(), "met")
    shared = met.join(table.select(F.col("id").alias("item_id"), "hash"), "item_id").join(own.select(F.col("id").alias("row"), "hash"), ["row", "hash"])
    shared = shared.groupBy("row", "item_id").agg(F.count("*").alias("n_shared")).join(items.select(F.col("id").alias("item_id"), F.size("hashes").cast("bigint").alias("n_item_shingles")), "item_id")
    return shared.where(F.col("n_shared") >= threshold * F.col("n_item_shingles") - 1e-9)


def contained(docs: DataFrame, items: DataFrame, threshold: float = NEAR_SIMILARITY, max_broadcast_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, n_shared, n_item_shingles of all pairs where the document holds at least `threshold` of the item's shingles."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    table = item_shingles(items)
    index = small_index(table, threshold, max_broadcast_shingles)
    if index is None:
        docs = staged(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        return docs.select("row", "doc_id").join(joined(docs, table, threshold), "row").select("doc_id", "item_id", "n_shared", "n_item_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = index.value.search
        for batch in batches:
            rows = []
            for ids, texts in chunks(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for doc_id, s in zip(ids, shingles_of(texts)):
                    rows += [(doc_id, *x) for x in search(s)]
            yield rows_to_batch(rows, _PAIRS)

    return docs.mapInArrow(run, _PAIRS_DDL)


def clean(docs: DataFrame, items: DataFrame, threshold: float = NEAR_SIMILARITY, max_broadcast_shingles: int = 1_000_000) -> DataFrame:
    """The rows of docs that hold no test item. With a broadcast index rows are tested where they lie; nothing is shuffled."""
    table = item_shingles(items)
    index = small_index(table, threshold, max_broadcast_shingles)
    if index is None:
        row = fresh("row", docs.columns)
        numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found = joined(numbered.select(F.col(row).alias("row"), "text"), table, threshold).select(F.col("row").alias(row)).distinct()
        return numbered.join(found, row, "left_anti").select(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = index.value.search
        for batch in batches:
            texts = batch.column("text").to_pylist()
            free = [not search(s) for _, part in chunks(texts, texts) for s in shingles_of(part)]
            yield batch.filter(pa.array(free, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
