"""Near duplicates: DartMinHash signatures, banded candidates, exact similarity, connected classes.

A document's elements are its shingles of five words, weighted by how often they occur. Each element throws darts into
the strip [0, width) x [0, inf) of (weight, rank): a Poisson process whose positions are hashes of the element and the
dart's number, so equal elements throw equal darts in every document. Darts above the element's weight are discarded,
each remaining dart picks a coordinate, and a coordinate keeps its earliest dart. Two documents agree on a coordinate
with probability equal to their weighted Jaccard similarity. Ranks are cut at a bound that leaves about k (ln k + 2)
darts for a document whatever its size; a document with an empty coordinate doubles it.

Near copies are documents whose shingles are alike as sets or as weighted sets. A document that repeats no shingle has
one signature for both; others have two, and bands of both.

Plan: equal texts fold into one node; band hashes of signatures give buckets; buckets with the same members count once.
Settling: every member of a bucket is compared exactly with one node of a bucket, the first of those it meets most, so
that a large group of copies becomes a class in linear work; texts are fetched only for pairs whose signatures look alike. The rest: in buckets that still hold several classes,
members of different classes are compared by short signatures, and the nodes that look alike across classes exactly.
Large buckets are dealt out as pairs of bounded blocks; blocks of one class aren't paired. All pairs of different classes
in a bucket are compared, so a link is lost only if a pair at the threshold meets in no band (below 1e-6 with the
defaults) or its estimate falls five deviations short. What stays quadratic, in blocks, is a large bucket of texts that
look alike and of which few pairs are near copies.

Edge cases: null texts count as empty; texts without words are near copies of equal texts only; texts of one to four
words have one shingle; rows with a null doc_id get a null class; rows that repeat a doc_id are judged each by its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import NEAR_SIMILARITY, SHINGLE_WORDS, by_group, chunks, fresh, mix64, rows_to_batch, staged, window_hashes, word_hashes
from auditloom.llm.components import components

BANDS, ROWS = 40, 5
BLOCK_DOCS, BLOCK_CHARS = 512, 1 << 22
_SIGNED = pa.schema([("node", pa.int64()), ("chars", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_ALIKE = pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def thrown(elements: np.ndarray, weights: np.ndarray | None, docs: np.ndarray, bound: np.ndarray, k: int, skip_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinate, numbered over all documents; rank; dart) of the darts of elements that docs own, up to bound[document].

    Strips of weight are [0, 1), [1, 2), [2, 4) and so on. skip_first leaves out the first.
    """
    keys, ranks, darts = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.uint64)]
    low, width, strip = (1.0, 1.0, 1) if skip_first else (0.0, 1.0, 0)
    top = 1.0 if weights is None or not len(weights) else float(weights.max())
    while low < top:
        e, d, w = elements, docs, weights
        if low:
            far = w > low
            e, d, w = e[far], d[far], w[far]
        seed = mix64(e ^ np.uint64((strip * 0x51_7C_C1_B7_27_22_0A_95) & 0xFFFFFFFFFFFFFFFF))
        rank = np.zeros(len(e))
        number = 0
        while len(e):
            number += 1
            u = mix64(seed + np.uint64((number * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log((u >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / width
            near = rank <= bound[d]
            e, d, seed, rank, u = e[near], d[near], seed[near], rank[near], u[near]
            dart = mix64(u + np.uint64(0x632BE59BD9B4E019))
            hit = slice(None)
            if w is not None:
                w = w[near]
                hit = low + width * (mix64(dart) >> np.uint64(11)).astype(float) * 2.0**-53 < w
            keys.append(d[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
            ranks.append(rank[hit])
            darts.append(dart[hit])
        low, width, strip = low + width, (low + width), strip + 1
    return np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)


def earliest(n: int, k: int, *some: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(dart, rank) tables, n documents x k, of the earliest of some darts on each coordinate; 0 and inf where there is none."""
    key, rank, dart = (np.concatenate(x) for x in zip(*some))
    late_first = np.argsort(-rank, kind="stable")
    flat, ranks = np.zeros(n * k, dtype=np.uint64), np.full(n * k, np.inf)
    flat[key[late_first]], ranks[key[late_first]] = dart[late_first], rank[late_first]  # the earliest dart of a coordinate is written last
    return flat.reshape(n, k), ranks.reshape(n, k)


def bound_of(mass: np.ndarray, k: int) -> np.ndarray:
    return k * (np.log(k) + 2) / np.maximum(mass, 1e-12)


def ranked_signatures(elements: np.ndarray, weights: np.ndarray | None, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 signatures, their darts' ranks), documents x k, of documents that own consecutive runs of `counts` elements.

    weights None: all 1; then elements may repeat within a document. Documents without elements get zeros.
    """
    docs = np.repeat(np.arange(len(counts)), counts)
    bound = bound_of(counts.astype(float) if weights is None else np.bincount(docs, weights, minlength=len(counts)), k)
    out, ranks = np.zeros((len(counts), k), dtype=np.uint64), np.full((len(counts), k), np.inf)
    todo = np.flatnonzero(counts)
    while len(todo):
        chosen = np.zeros(len(counts), dtype=bool)
        chosen[todo] = True
        own = chosen[docs]
        table, at = earliest(len(counts), k, thrown(elements[own], None if weights is None else weights[own], docs[own], bound, k))
        full = np.zeros(len(counts), dtype=bool)
        full[todo] = (table[todo] != 0).all(axis=1)
        out[full], ranks[full] = table[full], at[full]
        todo = todo[~full[todo]]
        bound[todo] *= 2
    return out, ranks


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, counts: np.ndarray, k: int) -> np.ndarray:
    return ranked_signatures(elements, weights, counts, k)[0]


def weighted_from_plain(plain: np.ndarray, ranks: np.ndarray, elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Weighted signatures of documents with distinct elements whose plain ones, and ranks, are known.

    The plain darts are those of the first strip, so only the weight above 1 throws anew.
    """
    docs = np.repeat(np.arange(len(counts)), counts)
    bound = bound_of(np.bincount(docs, weights, minlength=len(counts)), k)
    known = ranks <= bound[:, None]
    first = np.flatnonzero(known), ranks[known], plain[known]
    more = weights > 1
    table, _ = earliest(len(counts), k, first, thrown(elements[more], weights[more], docs[more], bound, k, skip_first=True))
    open_ = np.flatnonzero(~(table != 0).all(axis=1))
    if len(open_):
        own = np.isin(docs, open_)
        table[open_] = dart_signatures(elements[own], weights[own], counts[open_], k)
    return table


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r::rows][:, :bands])
    return mix64(out + np.arange(bands, dtype=np.uint64))


def shingles(texts: list[str | None], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, number of shingles of each)."""
    words, counts = word_hashes(texts)
    cuts = np.cumsum([0, *counts])
    runs = [window_hashes(words[a:b], size) for a, b in zip(cuts, cuts[1:])]
    return (np.concatenate(runs) if runs else words), np.array([len(r) for r in runs], dtype=np.int64)


def weighted(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents that repeat an element; their distinct elements; the numbers of occurrences as weights; how many each has)."""
    cuts = np.cumsum([0, *counts])
    parts = {}
    for d, (a, b) in enumerate(zip(cuts, cuts[1:])):
        ordered = np.sort(elements[a:b])
        if (ordered[1:] == ordered[:-1]).any():
            parts[d] = np.unique(ordered, return_counts=True)
    empty = [np.zeros(0, np.uint64)]
    return (
        np.array(list(parts), dtype=np.int64),
        np.concatenate(empty + [p[0] for p in parts.values()]),
        np.concatenate([np.zeros(0)] + [p[1].astype(float) for p in parts.values()]),
        np.array([len(p[0]) for p in parts.values()], dtype=np.int64),
    )


def signed(nodes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """node, chars, sketch (a byte of each coordinate), bands of nodes (node, text) that have a word.

    Where shingles repeat, the sketch of the weighted signature follows that of the plain one, and bands are those of both.
    """
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.column("node").to_pylist(), batch.column("text").to_pylist(), 1 << 20):
                elements, counts = shingles(texts)
                plain, ranks = ranked_signatures(elements, None, counts, k)
                twice, distinct, weights, sizes = weighted(elements, counts)
                heavy = weighted_from_plain(plain[twice], ranks[twice], distinct, weights, sizes, k)
                of = {int(d): i for i, d in enumerate(twice)}
                small = [(x & np.uint64(0xFF)).astype(np.uint8) for x in (plain, heavy)]
                hashed = [band_hashes(x, bands, rows).view(np.int64) for x in (plain, heavy)]
                out = []
                for d in np.flatnonzero(counts):
                    i = of.get(int(d))
                    if i is None:
                        out.append((ids[d], len(texts[d]), small[0][d].tobytes(), hashed[0][d]))
                    else:
                        out.append((ids[d], len(texts[d]), small[0][d].tobytes() + small[1][i].tobytes(), np.unique(np.r_[hashed[0][d], hashed[1][i]])))
                yield rows_to_batch(out, _SIGNED)

    return nodes.select("node", "text").mapInArrow(run, "node bigint, chars bigint, sketch binary, bands array<bigint>")


class Forest:
    """Union-find over 0..n-1; join() tells whether two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def agreements(sketches: list[bytes], k: int) -> np.ndarray:
    """Matrix of the numbers of equal bytes of these sketches, the greater of those of plain and weighted signatures."""
    out = None
    halves = [np.frombuffer(b"".join(bytes(x[:k]) for x in sketches), dtype=np.uint8).reshape(-1, k)]
    if any(len(x) > k for x in sketches):
        halves.append(np.frombuffer(b"".join(bytes(x[-k:]) for x in sketches), dtype=np.uint8).reshape(-1, k))
    for half in halves:
        same = np.zeros((len(half),) * 2, dtype=np.uint16)
        for column in np.ascontiguousarray(half.T):
            same += column[:, None] == column[None, :]
        out = same if out is None else np.maximum(out, same)
    return out


def across(group: dict[str, list]) -> np.ndarray:
    """Which pairs of members are of different classes and belong to this pair of blocks: those within a block are left to the pair (x, x)."""
    side, of = np.array(group["own"]), np.array(group["class"])
    apart = of[:, None] != of[None, :]
    return apart & (side[:, None] != side[None, :]) if group["x"][0] != group["y"][0] else apart


def by_class(members: DataFrame, group: str) -> DataFrame:
    """members (group, node, class, chars) dealt out as pairs of blocks x <= y: a row for each pair that its own block is in.

    A class that fills blocks has its own, which aren't paired with one another; smaller classes share the others. A
    block has about BLOCK_DOCS members and BLOCK_CHARS characters.
    """
    each = members.groupBy(group, "class").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    each = each.withColumn("part", F.when((F.col("n") >= BLOCK_DOCS) | (F.col("chars") >= BLOCK_CHARS), F.col("class")).otherwise(F.lit(-1)))
    parts = each.groupBy(group, "part").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_DOCS, F.sum("chars") / BLOCK_CHARS, F.lit(1.0))).cast("int").alias("blocks"))
    in_group = Window.partitionBy(group)
    upto = F.sum("blocks").over(in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select(group, "part", "blocks", (upto - F.col("blocks")).cast("int").alias("lo"), F.sum("blocks").over(in_group).cast("int").alias("total"))
    parts = each.select(group, "class", "part").join(parts, [group, "part"])
    own = F.col("lo") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda o: (F.col("part") == -1) | (o < F.col("lo")) | (o >= F.col("lo") + F.col("blocks")))
    dealt = members.join(parts, [group, "class"]).withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "part", "blocks", "lo", "total", "chars")


def alike(group: dict[str, list], k: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(node, class, least class it is connected with) of the members of two blocks that look alike across classes:
    at least this many coordinates agree."""
    nodes, of = group["node"], group["class"]
    if len(set(of)) < 2:
        return
    i, j = np.nonzero(np.triu((agreements(group["sketch"], k) >= least) & across(group), 1))
    if not len(i):
        return
    names, codes = np.unique(np.array(of), return_inverse=True)
    forest = Forest(len(names))
    for x, y in np.unique(np.c_[codes[i], codes[j]], axis=0).tolist():
        forest.join(x, y)
    for n in np.unique(np.r_[i, j]).tolist():
        yield nodes[n], of[n], int(names[forest.root(int(codes[n]))])


Shingled = tuple[np.ndarray, np.ndarray]


def counted(texts: list[str | None]) -> list[Shingled]:
    """Ascending distinct shingles of each text, with their numbers of occurrences."""
    elements, counts = shingles(texts)
    cuts = np.cumsum([0, *counts])
    return [np.unique(elements[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:])]


def similarity(a: Shingled, b: Shingled) -> float:
    """The greater of plain and weighted Jaccard similarity; 0 if one has no shingle."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    total = int(a[1].sum() + b[1].sum())
    if total == len(a[0]) + len(b[0]):
        return plain
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return max(plain, shared / (total - shared))


def likely(pairs: DataFrame, signs: DataFrame, k: int, least: int) -> DataFrame:
    """Those of pairs (node, parent) whose sketches agree on at least this many coordinates, with the node's chars."""
    both = pairs.join(signs.select("node", "chars", F.col("sketch").alias("own")), "node").join(signs.select(F.col("node").alias("parent"), F.col("sketch").alias("other")), "parent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("own", "other"))
            halves = [np.frombuffer(b"".join(x[part] for x in side), dtype=np.uint8).reshape(-1, k) for part in (slice(k), slice(-k, None)) for side in (a, b)]
            agree = np.maximum((halves[0] == halves[1]).sum(axis=1), (halves[2] == halves[3]).sum(axis=1))
            yield batch.select(["node", "parent", "chars"]).filter(pa.array(agree >= least))

    return both.select("node", "parent", "chars", "own", "other").mapInArrow(run, "node bigint, parent bigint, chars bigint")


def stars(nodes: DataFrame, parents: DataFrame, threshold: float) -> DataFrame:
    """a, b: which nodes (b) of parents (node, parent, chars) are near copies of their parent (a).

    A parent's nodes are dealt out in bounded blocks, each with the parent's text.
    """
    sizes = parents.groupBy("parent").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("chars") / BLOCK_CHARS, F.lit(1.0))).cast("int").alias("blocks"))
    own = parents.join(sizes, "parent").select("parent", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    hubs = sizes.select("parent", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("parent").alias("node"))

    def run(group: dict[str, list]) -> Iterator[tuple[int, int]]:
        parent, sets = group["parent"][0], counted(group["text"])
        hub = sets[group["node"].index(parent)]
        for node, own in zip(group["node"], sets):
            if node != parent and similarity(hub, own) >= threshold - 1e-12:
                yield parent, node

    return by_group(own.unionByName(hubs).join(nodes.select("node", "text"), "node"), ["parent", "block"], run, _PAIR, "a bigint, b bigint")


def verified(group: dict[str, list], threshold: float, k: int, least: int) -> Iterator[tuple[int, int]]:
    """Classes that the members of two blocks link: a spanning forest of the pairs of different classes whose exact
    similarity reaches the threshold.

    Pairs are met in descending order of estimated similarity; those whose classes are already joined need no test.
    """
    of = group["class"]
    if len(set(of)) < 2:
        return
    estimate = agreements(group["sketch"], k)
    sets = counted(group["text"])
    names, codes = np.unique(np.array(of), return_inverse=True)
    forest = Forest(len(names))
    i, j = np.nonzero(np.triu(across(group) & (estimate >= least), 1))
    for p in np.argsort(-estimate[i, j].astype(np.int64), kind="stable"):
        x, y = int(codes[i[p]]), int(codes[j[p]])
        if forest.root(x) != forest.root(y) and similarity(sets[i[p]], sets[j[p]]) >= threshold - 1e-12:
            forest.join(x, y)
            yield int(names[x]), int(names[y])


def grouped(nodes: DataFrame, threshold: float = NEAR_SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """node, root: the class of each of nodes (node, text; nodes not negative) that has a near copy."""
    k = bands * rows
    least = int(k * (threshold - 5 * (threshold * (1 - threshold) / k) ** 0.5))
    signs = staged(signed(nodes, bands, rows), "signs")
    in_bands = signs.select("node", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("first")).where("n > 1")
    buckets = buckets.groupBy("n", "who", "first").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times")).select("bucket", "first", "times")
    members = staged(in_bands.join(buckets, "bucket"), "members")

    met = members.where("node <> first").groupBy("node", "first").agg(F.sum("times").alias("times"))
    parents = met.groupBy("node").agg(F.max_by("first", F.struct("times", -F.col("first"))).alias("parent"))
    parents = staged(likely(parents, signs, k, least).select("node", "parent", "chars"), "parents")
    settled = staged(components(stars(nodes, parents, threshold)), "settled")

    members = members.select("bucket", "node").join(settled, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("class"))
    members = staged(members, "classed")
    mixed = members.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("bucket")
    rest = by_class(members.join(mixed, "bucket").withColumn("chars", F.lit(0).cast("bigint")), "bucket").join(signs.select("node", "sketch"), "node")
    found = staged(by_group(rest, ["bucket", "x", "y"], lambda g: alike(g, k, least), _ALIKE, "node bigint, a bigint, b bigint"), "alike")
    if found.isEmpty():
        return settled

    roots = components(found.select("a", "b"))
    rest = found.select("node", F.col("a").alias("class")).distinct().join(roots.select(F.col("node").alias("class"), "root"), "class")
    rest = by_class(staged(rest.join(signs.select("node", "chars"), "node"), "open"), "root").join(signs.select("node", "sketch"), "node").join(nodes.select("node", "text"), "node")
    joined = components(by_group(rest, ["root", "x", "y"], lambda g: verified(g, threshold, k, least), _PAIR, "a bigint, b bigint"))
    joined = staged(joined.select(F.col("node").alias("class"), F.col("root").alias("whole")), "joined")
    old = settled.withColumnRenamed("root", "class").join(joined, "class", "left").select("node", F.coalesce("whole", "class").alias("root"))
    alone = joined.join(settled, joined["class"] == settled["node"], "left_anti").select(F.col("class").alias("node"), F.col("whole").alias("root"))
    return old.unionByName(alone)


def keyed_classes(docs: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key of each row; key, copies, class_id, best for each distinct text of rows with a doc_id).

    best: whether its first row stands for the class: the least doc_id, and of equal ones the least key.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.md5(F.encode("text", "utf-8")).alias("key"))
    nodes = keyed.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("text").alias("text"))
    # Numbered as they are written, so that a number stays with its text.
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.select("node", "key", "first", "copies").join(grouped(nodes, threshold, bands, rows), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = staged(named.select("root", "key", "first", "copies"), "named")
    least = named.groupBy("root").agg(F.min(F.struct("first", "key")).alias("least"))
    named = named.join(least, "root").select("key", "copies", F.col("least.first").alias("class_id"), (F.col("least.key") == F.col("key")).alias("best"))
    return keyed.select("doc_id", "key"), named


def classes(docs: DataFrame, threshold: float = NEAR_SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), copies (rows with an equal text), for each row of docs."""
    keyed, named = keyed_classes(docs, threshold, bands, rows)
    out = keyed.join(named, "key", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.col("copies")).alias("copies"))


def deduplicated(docs: DataFrame, threshold: float = NEAR_SIMILARITY) -> DataFrame:
    """One row of docs for each class: that of its least doc_id, and of several texts with that id the least by hash; rows with
    a null doc_id stay. Columns as in docs."""
    _, named = keyed_classes(docs, threshold)
    names = [fresh(c, docs.columns) for c in ("kept_id", "kept_key")]
    kept = staged(named.where("best").select(F.col("class_id").alias(names[0]), F.col("key").alias(names[1])), "kept")
    one = docs.where("doc_id is not null")
    key = F.md5(F.encode(F.coalesce(one["text"], F.lit("")), "utf-8"))
    one = one.join(kept, (one["doc_id"] == kept[names[0]]) & (key == kept[names[1]])).dropDuplicates(["doc_id", names[1]]).drop(*names)
    return one.unionByName(docs.where("doc_id is null"))
