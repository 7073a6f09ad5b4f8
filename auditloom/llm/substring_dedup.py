"""Passages that repeat across documents, also with edits: shared k-mer seeds, collinear chains, alignment.

Seeds are runs of `K` words, sampled by minimizers (the least hash of each `W` neighbouring runs), so that two equal
runs of K + W - 1 words share a seed. The first place of a seed, in order of (doc_id, position), is its source; every
other document that has the seed is matched with that source alone, which keeps matches linear in the seeds however
many documents share a passage. Per pair of document and source, matches that lie on one diagonal are merged, and
chained by a Fenwick tree over source positions: the best score of a chain that ends before (d, s) is a prefix maximum,
since the cost of a gap is the sum of its two lengths times a constant. Where that best one lies too far back, the
matches that end within the widest gap are compared one by one: a place of a document has one seed at most, so they are
few. Chains are cut at wide gaps, extended over the text around them by a banded alignment with a drop-off, which
bridges edits, aligned by the longest common subsequence, and reported if long and alike enough.

One source a seed may split a passage over several earlier documents, none of which has enough of it. So the runs of
min_words words that no passage covers, though earlier documents have each of their seeds, are looked up as a whole:
every exact repeat of min_words words is matched with a document that holds all of it. Only documents with a seed of
such a run are asked, each run goes to its first place, and the work stays linear in the words.

Edited passages may be split like that, too. So where several known seeds stand together and no passage covers them, each
is matched again, with the `BEFORE` documents that have it next before, and these matches are chained and aligned as the
first ones. A document's neighbours among those that have a seed come from one sort by (seed, document), in ranges, so a
seed that most documents have is no hot key.

Edge cases: null and short texts have no seeds; rows with a null doc_id have no passages and are never cut; rows that
repeat a doc_id are parts of one document, each with word places of its own text; a passage that repeats within one
document only isn't reported; of several sources of the same words the least (doc_id, position) is told; an empty table has no passages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import SPACE_CLASS, by_group, chunks, fresh, rows_to_batch, staged, window_hashes, word_hashes

K, W = 7, 12
PAD, MAX_GAP, GAP_COST, LEAST_CHAIN = 64, 64, 0.2, K
#: Documents before a document with which an uncovered seed is matched, and how many such seeds stand within min_words words.
BEFORE, TOGETHER = 4, 3
#: Edits that an extension bridges at most on a side, and those in a row without a gain at which it ends.
MAX_EDITS, DROP = 24, 6
_SEED = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])
_CHAIN = pa.schema([(c, pa.int64()) for c in ("doc_id", "source_id", "d0", "d1", "s0", "s1")])
_PASSAGE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start_word", "n_words", "source_id", "source_start", "source_words", "n_equal")])
_RUN = pa.schema([("hash", pa.int64()), ("seed", pa.int64()), ("doc_id", pa.int64()), ("places", pa.list_(pa.int64()))])
_RANGES = ("d0", "d1", "s0", "s1", "d_lo", "d_hi", "s_lo", "s_hi")
_WORDS = pa.schema([*((c, pa.int64()) for c in ("doc_id", "source_id", *_RANGES)), ("words", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def window_best(values: np.ndarray, w: int, best: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or greatest) of each w neighbouring values, by windows of twice the width at each step."""
    step = 1
    while 2 * step <= w:
        values = best(values[:-step], values[step:])
        step *= 2
    return best(values[: len(values) - (w - step)], values[w - step :])


def minimizers(runs: np.ndarray, w: int = W) -> np.ndarray:
    """Ascending places of the least hash in each w neighbouring runs; of equal hashes within w places only the first."""
    if not len(runs):
        return np.zeros(0, dtype=np.int64)
    w = min(w, len(runs))
    # A run is least in one of its windows if it is as great as the greatest of their least ones.
    least = np.zeros(len(runs) + w - 1, dtype=runs.dtype)
    least[w - 1 : len(runs)] = window_best(runs, w)
    at = np.flatnonzero(runs == window_best(least, w, np.maximum))
    same, apart = runs[at[1:]] == runs[at[:-1]], np.diff(at)
    if (same & (apart < w)).any():  # a window with equal ones, of which the first counts
        at = np.unique(np.lib.stride_tricks.sliding_window_view(runs, w).argmin(axis=1) + np.arange(len(runs) - w + 1))
        same, apart = runs[at[1:]] == runs[at[:-1]], np.diff(at)
    again = np.zeros(len(at), dtype=bool)
    again[1:] = same & (apart <= w)
    return at[~again]


def seeds(docs: DataFrame, w: int = W) -> DataFrame:
    """hash, doc_id, pos of the seeds of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words, counts = word_hashes(texts)
                at, hashes, owners, places = 0, [], [], []
                for doc_id, n in zip(ids, counts):
                    if n >= K:
                        runs = window_hashes(words[at : at + n], K)
                        own = minimizers(runs, w)
                        hashes.append(runs[own])
                        places.append(own.astype(np.int32))
                        owners.append(np.full(len(own), doc_id, dtype=np.int64))
                    at += n
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places))], schema=_SEED)

    return docs.where("doc_id is not null").mapInArrow(run, "hash bigint, doc_id bigint, pos int")


def matches(docs: DataFrame, w: int = W) -> tuple[DataFrame, DataFrame]:
    """(hash, doc_id, pos of all seeds; hash, doc_id, pos, source_id, source_pos: each seed beside the first document that has it).

    A place is packed into one long where document ids and lengths leave room, which is looked up; that lets Spark
    aggregate in hash tables. Else it is a struct, and Spark sorts. Ids below 2**32 need no look at the texts: a row of
    Spark's has fewer than 2**30 words.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    pos_bits = 30
    if high is not None and high >= 1 << 32:
        longest = docs.agg(F.max(F.octet_length("text"))).first()[0]
        pos_bits = max(1, math.ceil(math.log2((longest or 1) / 2 + 2)))
    found = seeds(docs, w)
    if low is not None and low >= 0 and high < 1 << (62 - pos_bits):
        found = staged(found.select("hash", (F.shiftleft("doc_id", pos_bits) + F.col("pos")).alias("at")), "seeds")
        doc_of, pos_of = (lambda c: F.shiftright(c, pos_bits)), (lambda c: F.col(c).bitwiseAND((1 << pos_bits) - 1))
    else:
        found = staged(found.select("hash", F.struct("doc_id", "pos").alias("at")), "seeds")
        doc_of, pos_of = (lambda c: F.col(f"{c}.doc_id")), (lambda c: F.col(f"{c}.pos").cast("bigint"))
    first = found.groupBy("hash").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(doc_of("first") < doc_of("last")).select("hash", "first")
    both = found.join(first, "hash").where(doc_of("at") > doc_of("first"))
    both = both.select("hash", doc_of("at").alias("doc_id"), pos_of("at").alias("pos"), doc_of("first").alias("source_id"), pos_of("first").alias("source_pos"))
    return found.select("hash", doc_of("at").alias("doc_id"), pos_of("at").alias("pos")), staged(both, "matches")


def runs(docs: DataFrame, min_words: int, w: int, whole: bool) -> DataFrame:
    """hash, seed, doc_id, places of runs of min_words words of docs (doc_id, text, hashes: array of seeds, spans: array of word ranges).

    whole: the runs whose seeds all are among hashes and which spans don't cover, with all their places, ascending; else those
    whose first seed is, with their first place. A run is one row for each document, however often it stands there: texts
    that repeat a few words have few runs, each at a great many places.
    """
    n_windows = min_words - K - w + 2  # of w seed places each, that lie within a run and so choose the same seeds wherever it stands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, hashes, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hashes", "spans"))):
                words = word_hashes([text])[0]
                n = len(words) - min_words + 1
                if n < 1:
                    continue
                short = window_hashes(words, K)
                least = window_best(short, w).view(np.int64)
                hit = np.isin(least, np.array(hashes, dtype=np.int64))
                if whole:
                    held = np.r_[0, np.cumsum(hit)]
                    hit = held[n_windows:] - held[:-n_windows] == n_windows
                    open_ = np.ones(len(words), dtype=bool)
                    for x in spans or ():
                        open_[x["a"] : x["b"]] = False
                    left = np.r_[0, np.cumsum(open_)]
                    hit &= left[min_words:] > left[:-min_words]
                at = np.flatnonzero(hit[:n])
                if len(at):
                    long = window_hashes(words, min_words).view(np.int64)[at]
                    order = np.argsort(long, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(long[order]) != 0])
                    places, ends = (at[order], np.r_[first, len(at)]) if whole else (at[order[first]], np.arange(len(first) + 1))
                    at = at[order[first]]
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(long[order[first]]), pa.array(least[at]), pa.array(np.full(len(at), doc_id, dtype=np.int64)), lists], schema=_RUN)

    return docs.select("doc_id", "text", "hashes", "spans").mapInArrow(run, ddl(_RUN))


def split_passages(docs: DataFrame, every: DataFrame, matched: DataFrame, found: DataFrame, min_words: int, w: int) -> DataFrame:
    """The exact repeats of min_words words and more that found, passages by the first places of seeds, leaves uncovered."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), (F.col("start_word") + F.col("n_words")).alias("b"))).alias("spans"))
    held = matched.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    wanted = staged(runs(docs.join(held, "doc_id").join(spans, "doc_id", "left"), min_words, w, whole=True), "wanted")
    if wanted.isEmpty():
        return found
    asked = every.join(wanted.select(F.col("seed").alias("hash")).distinct(), "hash", "left_semi").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    offered = runs(docs.join(asked, "doc_id").withColumn("spans", F.lit(None).cast("array<struct<a:bigint,b:bigint>>")), min_words, w, whole=False)
    # Combined before they are dealt, and staged, so that a run which most documents have is no hot spot.
    first = staged(offered.groupBy("hash").agg(F.min(F.struct("doc_id", F.col("places")[0].alias("pos"))).alias("first")), "first")
    pairs = wanted.join(first, "hash").where("doc_id > first.doc_id").select("doc_id", "places", F.col("first.doc_id").alias("source_id"), F.col("first.pos").alias("source_pos"))

    def run(group: dict[str, list]) -> Iterator[tuple]:
        d = np.concatenate([np.array(places, dtype=np.int64) for places in group["places"]])
        s = np.repeat(np.array(group["source_pos"], dtype=np.int64), [len(places) for places in group["places"]])
        order = np.lexsort((d, d - s))
        d, s = d[order], s[order]
        cut = np.ones(len(d), dtype=bool)
        cut[1:] = (d[1:] - s[1:] != d[:-1] - s[:-1]) | (np.diff(d) > min_words)
        first = np.flatnonzero(cut)
        pieces = sorted((int(d[i]), int(s[i]), int(d[j] - d[i]) + min_words) for i, j in zip(first, np.r_[first[1:], len(d)] - 1))
        end, i = -1, 0  # words before end are told; of periodic texts, with a piece at each word, only as many are as cover all
        while i < len(pieces):
            best = i
            while i < len(pieces) and pieces[i][0] <= max(end, pieces[best][0]):
                best = i if sum(pieces[i][::2]) > sum(pieces[best][::2]) else best
                i += 1
            a, b, n = pieces[best]
            if a + n > end:
                yield group["doc_id"][0], a, n, group["source_id"][0], b, n, n
                end = a + n

    return found.unionByName(staged(by_group(pairs, ["doc_id", "source_id"], run, _PASSAGE, ddl(_PASSAGE)), "split"))


_NEXT = pa.schema([(c, pa.int64()) for c in ("hash", "doc_id", "pos", "source_id", "source_pos")] + [("edge", pa.bool_())])


def predecessors(places: DataFrame, most: int = BEFORE) -> DataFrame:
    """hash, doc_id, source_id, source_pos of places (hash, doc_id, pos; one for each hash and document): the `most` documents next before each.

    Ranges of the sorted places are gone through once. The first and last places of each, a few for each range, are put
    together afterwards, as neighbours may lie on both sides of a border.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)
        seen = 0
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("hash", "doc_id", "pos")])], axis=1)
            old, n = held.shape[1], rows.shape[1]
            out = []
            for j in range(1, most + 1):
                i = np.arange(max(old, j), n)
                i = i[rows[0, i] == rows[0, i - j]]
                out.append(np.stack([*rows[:, i], rows[1, i - j], rows[2, i - j], np.zeros(len(i), dtype=np.int64)]))
            heads = np.arange(old, min(n, old + max(0, most - seen)))
            out.append(np.stack([*rows[:, heads], *np.zeros((2, len(heads)), dtype=np.int64), np.ones(len(heads), dtype=np.int64)]))
            seen += n - old
            yield _batch(np.concatenate(out, axis=1))
            held = rows[:, -most:]
        tails = held[:, max(0, held.shape[1] - max(0, seen - most)) :]  # those that weren't heads
        yield _batch(np.stack([*tails, *np.zeros((2, tails.shape[1]), dtype=np.int64), np.ones(tails.shape[1], dtype=np.int64)]))

    def _batch(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows[:5]), pa.array(rows[5].astype(bool))], schema=_NEXT)

    ordered = places.repartitionByRange("hash", "doc_id").sortWithinPartitions("hash", "doc_id")
    found = staged(ordered.mapInArrow(run, ddl(_NEXT)), "neighbours")
    here = Window.partitionBy("hash").orderBy("doc_id")
    near = [F.struct(F.lag("doc_id", j).over(here).alias("source_id"), F.lag("pos", j).over(here).alias("source_pos")) for j in range(1, most + 1)]
    edges = found.where("edge").select("hash", "doc_id", F.array(*near).alias("near")).select("hash", "doc_id", F.explode("near").alias("s")).select("hash", "doc_id", "s.*").where("source_id is not null")
    columns = ["hash", "doc_id", "source_id", "source_pos"]
    return found.where("not edge").select(*columns).unionByName(edges.select(*columns)).distinct()


def rematched(every: DataFrame, matched: DataFrame, found: DataFrame, min_words: int) -> DataFrame | None:
    """doc_id, pos, source_id, source_pos of the seeds that stand together and that found, the passages by first places, leaves uncovered."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), (F.col("start_word") + F.col("n_words")).alias("b"))).alias("spans"))
    covered = F.exists("spans", lambda x: (F.col("pos") >= x["a"]) & (F.col("pos") + K <= x["b"]))
    open_ = matched.select("hash", "doc_id", "pos").join(spans, "doc_id", "left").where(~F.coalesce(covered, F.lit(False)))
    around = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-min_words, min_words)  # a document's own seeds
    open_ = staged(open_.withColumn("together", F.count("*").over(around)).where(F.col("together") >= TOGETHER).select("hash", "doc_id", "pos"), "open")
    if open_.isEmpty():
        return None
    places = every.join(open_.select("hash").distinct(), "hash", "left_semi").groupBy("hash", "doc_id").agg(F.min("pos").alias("pos"))
    columns = ["doc_id", "pos", "source_id", "source_pos"]
    again = staged(open_.join(predecessors(places), ["hash", "doc_id"]).select(*columns), "again")
    # With the matches of the same two documents that are known already, so that a passage told in part is told whole.
    known = matched.join(again.select("doc_id", "source_id").distinct(), ["doc_id", "source_id"], "left_semi").select(*columns)
    return again.unionByName(known).distinct()


class Fenwick:
    """Prefix maxima over ranks 1..n of (value, index)."""

    def __init__(self, n: int):
        self.best = [(-math.inf, -1)] * (n + 1)

    def put(self, i: int, entry: tuple[float, int]) -> None:
        while i < len(self.best):
            if entry > self.best[i]:
                self.best[i] = entry
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        found = (-math.inf, -1)
        while i:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chain(d: np.ndarray, s: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(d0, d1, s0, s1), word ranges in document and source, of the chains of matches at (d, s), each K words long."""
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    diagonal = np.lexsort((d, d - s))
    d, s = d[diagonal], s[diagonal]
    cut = np.ones(len(d), dtype=bool)
    cut[1:] = (d[1:] - s[1:] != d[:-1] - s[:-1]) | (np.diff(d) > W + K)
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(d)] - 1
    d0, s0, n = d[first], s[first], d[last] - d[first] + K
    order = np.lexsort((s0, d0))
    d0, s0, n = d0[order].tolist(), s0[order].tolist(), n[order].tolist()
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(s0)))}
    tree, score, ends, back = Fenwick(len(ranks)), [0.0] * len(d0), [0.0] * len(d0), [-1] * len(d0)
    waiting: list[int] = []  # of equal d0: they may not follow one another
    near: list[int] = []  # those in the tree that end within MAX_GAP words before the place, or behind it
    for i in range(len(d0)):
        if waiting and d0[waiting[0]] < d0[i]:
            for j in waiting:
                ends[j] = score[j] + GAP_COST * (d0[j] + s0[j] + 2 * n[j])
                tree.put(ranks[s0[j]], (ends[j], j))
            near = [j for j in near + waiting if d0[i] - d0[j] - n[j] <= MAX_GAP]
            waiting = []
        value, j = tree.top(ranks[s0[i]] - 1)
        if j >= 0 and (d0[i] - d0[j] - n[j] > MAX_GAP or s0[i] - s0[j] - n[j] > MAX_GAP):
            value, j = max(((ends[j], j) for j in near if s0[j] < s0[i] and s0[i] - s0[j] - n[j] <= MAX_GAP), default=(-math.inf, -1))
        gain = value - GAP_COST * (d0[i] + s0[i])
        if j >= 0 and gain > 0:
            back[i], score[i] = j, gain + n[i]
        else:
            score[i] = float(n[i])
        waiting.append(i)
    used, out = [False] * len(d0), []
    for i in sorted(range(len(d0)), key=lambda x: -score[x]):
        if used[i]:
            continue
        a = b = i
        while True:
            used[a] = True
            if back[a] < 0 or used[back[a]]:
                break
            a = back[a]
        if d0[b] + n[b] - d0[a] >= LEAST_CHAIN:
            out.append((d0[a], d0[b] + n[b], s0[a], s0[b] + n[b]))
    return out


def chains(pairs: DataFrame) -> DataFrame:
    """doc_id, source_id, d0, d1, s0, s1. A group has the seeds of one document at most."""

    def run(group: dict[str, list]) -> Iterator[tuple]:
        ids = group["doc_id"][0], group["source_id"][0]
        for c in chain(np.array(group["pos"], dtype=np.int64), np.array(group["source_pos"], dtype=np.int64)):
            yield (*ids, *c)

    return by_group(pairs, ["doc_id", "source_id"], run, _CHAIN, ddl(_CHAIN))


def with_words(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Word hashes (uint32, as bytes) for chains (with d_lo, d_hi, s_lo, s_hi): a row for each chain with the words of its
    document's range, and a row (source_id, s_lo, s_hi) for each distinct range of a source. Texts are dealt out once, for both."""
    own = found.select("doc_id", F.struct("source_id", *_RANGES).alias("r"))
    sources = found.select(F.col("source_id").alias("doc_id"), "s_lo", "s_hi").distinct()
    none = F.lit(None).cast("bigint")
    sources = sources.select("doc_id", F.struct(none.alias("source_id"), *(F.col(c) if c in ("s_lo", "s_hi") else none.alias(c) for c in _RANGES)).alias("r"))
    wanted = own.unionByName(sources).groupBy("doc_id").agg(F.collect_list("r").alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges"))):
                words = (word_hashes([text])[0] >> np.uint64(32)).astype("<u4")
                for r in ranges:
                    if r["source_id"] is None:
                        rows.append((None, doc_id, *(r[c] for c in _RANGES), words[r["s_lo"] : r["s_hi"]].tobytes()))
                    else:
                        rows.append((doc_id, r["source_id"], *(r[c] for c in _RANGES), words[r["d_lo"] : r["d_hi"]].tobytes()))
                if len(rows) > 2000:
                    yield rows_to_batch(rows, _WORDS)
                    rows = []
            yield rows_to_batch(rows, _WORDS)

    return docs.join(wanted, "doc_id").select("doc_id", "text", "ranges").mapInArrow(run, ddl(_WORDS))


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        hit = state & places.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def extended(d: list[int], s: list[int], costs: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """For each cost of an edit, (words of d, words of s, equal words) of the best common start, in a band of MAX_EDITS diagonals.

    Furthest places by diagonal are kept for each number of edits, so only edits cost time. A start ends with an equal
    word; the search drops off where no diagonal is within DROP edits of the best start.
    """
    best = [(0.0, 0, 0, 0)] * len(costs)
    front = {0: (0, 0)}  # diagonal (place in d less place in s): furthest place in d, equal words up to there
    last = 0
    for edits in range(MAX_EDITS + 1):
        for k, (i, equal) in front.items():
            j, at = i - k, i
            while i < len(d) and j < len(s) and d[i] == s[j]:
                i, j = i + 1, j + 1
            if i > at:
                equal += i - at
                front[k] = i, equal
                for c, cost in enumerate(costs):
                    if equal - cost * edits > best[c][0]:
                        best[c] = equal - cost * edits, i, j, equal
                        last = edits
        if edits - last >= DROP:
            break
        following: dict[int, tuple[int, int]] = {}
        for k, (i, equal) in front.items():
            for to, place in ((k, i + 1), (k + 1, i + 1), (k - 1, i)):
                if place <= len(d) and 0 <= place - to <= len(s) and (place, equal) > following.get(to, (-1, 0)):
                    following[to] = place, equal
        front = following
    return [x[1:] for x in best]


def align(d: np.ndarray, s: np.ndarray, d0: int, d1: int, s0: int, s1: int, min_identity: float = 0.8) -> tuple[int, int, int, int, int]:
    """The ranges, extended on both sides as far as they stay alike enough, and the words they have in common in order.

    Each side is extended by equal words, over edits that more equal words outweigh (the longest way), or over edits that
    by themselves keep to min_identity; of these ways the longest that keeps the whole to min_identity is taken.
    """
    n = min(d0, s0)
    apart = np.flatnonzero(d[d0 - n : d0] != s[s0 - n : s0])
    grow = n - (apart[-1] + 1) if len(apart) else n
    d0, s0 = d0 - int(grow), s0 - int(grow)
    n = min(len(d) - d1, len(s) - s1)
    apart = np.flatnonzero(d[d1 : d1 + n] != s[s1 : s1 + n])
    grow = apart[0] if len(apart) else n
    d1, s1 = d1 + int(grow), s1 + int(grow)
    equal = d1 - d0 if d1 - d0 == s1 - s0 and (d[d0:d1] == s[s0:s1]).all() else common_words(d[d0:d1].tolist(), s[s0:s1].tolist())
    costs = (1.0, min_identity / max(1 - min_identity, 1e-9))
    none = [(0, 0, 0)]
    left = none + extended(d[:d0][::-1].tolist(), s[:s0][::-1].tolist(), costs) if d0 and s0 else none
    right = none + extended(d[d1:].tolist(), s[s1:].tolist(), costs) if d1 < len(d) and s1 < len(s) else none
    core = d0, d1, s0, s1, equal
    ways = {(d0 - a, d1 + x, s0 - b, s1 + y, equal + m + o) for a, b, m in left for x, y, o in right}
    whole = [w for w in ways if w[4] >= min_identity * max(w[1] - w[0], w[3] - w[2])]
    return max(whole, key=lambda w: (w[1] - w[0], w[4], w)) if whole else core


def aligned(docs: DataFrame, pairs: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """The passages of matches (doc_id, pos, source_id, source_pos): chained, extended and aligned."""
    floor = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - PAD) / PAD) * PAD).cast("bigint")
    ceil = lambda c: (F.ceil((F.col(c) + PAD) / PAD) * PAD).cast("bigint")
    found = staged(chains(pairs).select("*", floor("d0").alias("d_lo"), ceil("d1").alias("d_hi"), floor("s0").alias("s_lo"), ceil("s1").alias("s_hi")), "chains")
    rows = staged(with_words(docs, found), "words")
    # Staged, so that nothing above the join's exchanges keeps adaptive execution from splitting a range that many documents share.
    of_source = staged(rows.where("doc_id is null").select("source_id", "s_lo", "s_hi", F.col("words").alias("s")).dropDuplicates(["source_id", "s_lo", "s_hi"]), "ranges")
    rows = rows.where("doc_id is not null").withColumnRenamed("words", "d").join(of_source, ["source_id", "s_lo", "s_hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, source_id, d0, d1, s0, s1, d_lo, s_lo, d, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source_id", "d0", "d1", "s0", "s1", "d_lo", "s_lo", "d", "s"))):
                d0, d1, s0, s1, equal = align(np.frombuffer(d, "<u4"), np.frombuffer(s, "<u4"), d0 - d_lo, d1 - d_lo, s0 - s_lo, s1 - s_lo, min_identity)
                if d1 - d0 >= min_words and equal >= min_identity * max(d1 - d0, s1 - s0):
                    out.append((doc_id, d0 + d_lo, d1 - d0, source_id, s0 + s_lo, s1 - s0, equal))
            yield rows_to_batch(out, _PASSAGE)

    rest = F.struct("source_id", "source_start", "source_words", "n_equal")
    return rows.mapInArrow(run, ddl(_PASSAGE)).groupBy("doc_id", "start_word", "n_words").agg(F.min(rest).alias("s")).select("doc_id", "start_word", "n_words", "s.*")


def of_rows(docs: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """passages() of docs (doc_id bigint, text) whose ids don't repeat."""
    w = max(1, min(W, min_words - K + 1))
    every, matched = matches(docs, w)
    out = staged(aligned(docs, matched.drop("hash"), min_words, min_identity), "passages")
    again = rematched(every, matched, out, min_words)
    if again is not None:
        out = out.unionByName(staged(aligned(docs, again, min_words, min_identity), "more-passages"))
    if min_words >= K:
        out = split_passages(docs.where("doc_id is not null"), every, matched, out, min_words, w)
    # Those within another one of the same two documents say nothing more.
    before = Window.partitionBy("doc_id", "source_id").orderBy("start_word", F.desc("n_words"), "source_start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start_word") + F.col("n_words")
    return out.withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(-1))).where(F.col("reach") < end).drop("reach")


def numbered(docs: DataFrame) -> DataFrame | None:
    """row, doc_id, of_text, text: the distinct texts of each document, numbered in the order of doc_id; None if no id repeats."""
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("of_text"), "text").dropDuplicates(["doc_id", "of_text"])
    return staged(rows.repartitionByRange("doc_id", "of_text").sortWithinPartitions("doc_id", "of_text").select(F.monotonically_increasing_id().alias("row"), "*"), "numbered")


def found_in(docs: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """passages(), with of_text, the hash of the text in which a passage lies; null if ids don't repeat."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = numbered(docs)
    if rows is None:
        return of_rows(docs, min_words, min_identity).withColumn("of_text", F.lit(None).cast("bigint"))
    found = staged(of_rows(rows.select(F.col("row").alias("doc_id"), "text"), min_words, min_identity), "found")
    own = rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("own_id"), "of_text")
    source = rows.select(F.col("row").alias("source_id"), F.col("doc_id").alias("its_id"))
    found = found.join(own, "doc_id").join(source, "source_id").where("own_id <> its_id")
    return found.select(F.col("own_id").alias("doc_id"), "start_word", "n_words", F.col("its_id").alias("source_id"), "source_start", "source_words", "n_equal", "of_text")


def passages(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8) -> DataFrame:
    """doc_id, start_word, n_words, source_id, source_start, source_words, n_equal: each passage of at least min_words that an earlier
    document has too, where the words in common are at least min_identity of the longer side."""
    return found_in(docs, min_words, min_identity).drop("of_text")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without these word ranges; the white space before a removed word goes with it."""
    gone = np.zeros(max(b for _, b in spans) + 1, dtype=bool)
    for a, b in spans:
        gone[a:b] = True
    kept = [m.group() for i, m in enumerate(re.finditer(rf"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", text)) if i >= len(gone) or not gone[i]]
    return "".join(kept).lstrip(" \t\n\x0b\x0c\r") if gone[0] else "".join(kept)


def clean(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8) -> DataFrame:
    """docs with repeated passages cut from all but their first document; a document that loses its last word goes.

    Columns as in docs; n_chars, where docs has it, is counted anew for the texts that are cut.
    """
    found = found_in(docs.where("doc_id is not null"), min_words, min_identity)
    names = docs.columns
    key, text_key, cuts = fresh("cut_id", names), fresh("cut_text", names), fresh("cut_spans", names)
    spans = found.groupBy(F.col("doc_id").alias(key), F.col("of_text").alias(text_key)).agg(F.collect_list(F.struct(F.col("start_word").alias("a"), (F.col("start_word") + F.col("n_words")).alias("b"))).alias(cuts))
    spans = staged(spans, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(names)
            ranges = batch.column(cuts).to_pylist()
            hit = [i for i, r in enumerate(ranges) if r is not None]
            if not hit:
                yield rows
                continue
            columns = dict(zip(names, rows.columns))
            texts, keep = columns["text"].to_pylist(), [True] * len(ranges)
            for i in hit:
                if texts[i] is not None:
                    texts[i] = cut(texts[i], [(x["a"], x["b"]) for x in ranges[i]])
                    keep[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
            columns["text"] = pa.array(texts, type=columns["text"].type)
            if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                chars = columns["n_chars"].to_pylist()
                for i in hit:
                    chars[i] = len(texts[i] or "")
                columns["n_chars"] = pa.array(chars, type=columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=rows.schema).filter(pa.array(keep))

    same_text = spans[text_key].isNull() | (spans[text_key] == F.xxhash64(docs["text"]))
    return docs.join(spans, (docs["doc_id"] == spans[key]) & same_text, "left").drop(key, text_key).mapInArrow(run, docs.schema)
