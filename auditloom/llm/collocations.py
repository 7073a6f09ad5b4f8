"""Phrases whose words meet more often than their parts suggest, counted on position bitmaps.

A task lays the pieces of its texts, language by language, on one line of positions; a gap follows each piece. Each word
of such a shard has a compressed bitmap: 32 positions a block, blocks without a bit left out. A phrase is extended as
in SPAM: its bitmap (of last words) is shifted by one and ANDed with the bitmaps of the words that have bits in the same
blocks; what stays is the bitmap of the longer phrase, its popcount the phrase's count in the shard. A gap has no word,
so no phrase leaves its piece. numpy does this for many bitmaps at once, over bounded stretches of the line.

Popcounts of shards are summed. Phrases of two words come first, since one sum over all shards prunes best there: shards
send them, packed, to ranges of a hash, where they are counted exactly; the bitmaps of those frequent over all shards go
back to their shards, and there phrases are extended depth-first to the greatest length, each by the frequent pairs that
start with its last word. A pair that is frequent within a shard is so over all: only its count is sent, so a common
phrase is one entry for each shard and no hot key. There are as many ranges as the texts' size calls for.

Arithmetic is exact: scores are quotients of decimals.

Edge cases: a null text is an empty one, a null language is `und`; null or repeated ids count row by row, as ids aren't
read; a piece longer than a shard's bound is held whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import by_group, mix64, staged

#: What ends a piece, and what parts words.
_ENDS = b",;:!?\n\x0b\x0c\r"
_ONE_MARK = bytes.maketrans(b"\t" + _ENDS, b" " + b"." * len(_ENDS))
_CUT = re.compile(r"[.,;:!?\n\x0b\x0c\r]")
NO_LANGUAGE = "und"

_BLOCK_BITS = 5
_BLOCK = 1 << _BLOCK_BITS
#: Phrases of one length of a shard, one after another, each column compressed: their bytes and byte counts, how often they occur, and, of
#: those whose bitmaps come along, the number of blocks of each, the blocks and the masks.
_PARTS = ("text", "sizes", "n", "blocks_of", "blocks", "masks")
_PACKED = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("length", pa.int32()), ("shard", pa.int64()), *((c, pa.binary()) for c in _PARTS)])
_PACKED_DDL = "lang string, range bigint, length int, shard bigint, " + ", ".join(f"{c} binary" for c in _PARTS)
#: Rows of a phrase over all shards (phrase, n), and of the bitmaps of frequent pairs of one shard (shard, text, ...).
_FOUND = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("shard", pa.int64()), *((c, pa.binary()) for c in _PARTS if c != "n")])
_FOUND_DDL = "lang string, length int, phrase string, n bigint, shard bigint, " + ", ".join(f"{c} binary" for c in _PARTS if c != "n")


# ---------------------------------------------------------------- bitmaps of a shard
class Bitmaps:
    """Compressed bitmaps of phrases, one after another: owner (ascending), block (ascending for each owner), mask."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, mask: np.ndarray):
        self.owner, self.block, self.mask = owner, block, mask

    @classmethod
    def of_positions(cls, owner: np.ndarray, position: np.ndarray) -> Bitmaps:
        return cls.summed(owner, position >> _BLOCK_BITS, np.uint32(1) << (position & (_BLOCK - 1)).astype(np.uint32))

    @classmethod
    def summed(cls, owner: np.ndarray, block: np.ndarray, mask: np.ndarray) -> Bitmaps:
        """Of entries in any order, whose masks are ORed where owner and block agree."""
        if not len(owner):
            return cls(owner, block, mask)
        order = np.lexsort((block, owner))
        owner, block, mask = owner[order], block[order], mask[order]
        start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])))
        return cls(owner[start], block[start], np.bitwise_or.reduceat(mask, start))

    def shifted(self) -> Bitmaps:
        """Each bitmap moved on by one position, in the order of blocks."""
        carry = self.mask >> np.uint32(_BLOCK - 1) > 0
        owner = np.concatenate([self.owner, self.owner[carry]])
        block = np.concatenate([self.block, self.block[carry] + 1])
        mask = np.concatenate([self.mask << np.uint32(1), np.ones(int(carry.sum()), dtype=np.uint32)])
        order = np.argsort(block, kind="stable")
        return Bitmaps(owner[order], block[order], mask[order])

    def by_block(self) -> Bitmaps:
        order = np.argsort(self.block, kind="stable")
        return Bitmaps(self.owner[order], self.block[order], self.mask[order])

    def popcounts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owners, first entry of each, bits of each)."""
        if not len(self.owner):
            return self.owner, self.owner, self.owner
        start = np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1]))
        return self.owner[start], start, np.add.reduceat(np.bitwise_count(self.mask).astype(np.int64), start)


def extended(left: Bitmaps, right: Bitmaps, n_right: int, stretch: int = 1 << 21) -> Bitmaps:
    """Bitmaps of left shifted by one AND right, for every two that share a block; owners are left * n_right + right.

    right comes in the order of blocks. Entries meet block by block, so there are at most 32 x 32 a block; `stretch` of
    them are held at once.
    """
    a = left.shifted()
    low = np.searchsorted(right.block, a.block, side="left")
    counts = np.searchsorted(right.block, a.block, side="right") - low
    ends = np.cumsum(counts)
    out = []
    begin = 0
    while begin < len(a.block):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + stretch, side="right")))
        n = counts[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[begin:end], n)
        mask = a.mask[i] & right.mask[j]
        some = np.flatnonzero(mask)
        i, j = i[some], j[some]
        out.append((a.owner[i] * n_right + right.owner[j], a.block[i], mask[some]))
        begin = end
    if not out:
        return Bitmaps(left.owner[:0], left.block[:0], left.mask[:0])
    return Bitmaps.summed(*(np.concatenate(c) for c in zip(*out)))


class Packed:
    """Phrases as _PARTS: an Arrow array of texts, their counts, and a bitmap for each (blocks_of is 0 where none comes along)."""

    def __init__(self, texts: pa.Array, n: np.ndarray, blocks_of: np.ndarray, blocks: np.ndarray, masks: np.ndarray):
        self.texts, self.n, self.blocks_of, self.blocks, self.masks = texts, n, blocks_of, blocks, masks
        self.ends = np.array([len(n)])  # of the rows that the phrases came in

    def take(self, chosen: np.ndarray) -> Packed:
        sizes = self.blocks_of[chosen]
        first = (np.cumsum(self.blocks_of) - self.blocks_of)[chosen]
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return Packed(self.texts.take(pa.array(chosen)), self.n[chosen], sizes, self.blocks[at], self.masks[at])

    def without_bitmaps(self, where: np.ndarray) -> Packed:
        keep = np.repeat(~where, self.blocks_of)
        return Packed(self.texts, self.n, np.where(where, 0, self.blocks_of), self.blocks[keep], self.masks[keep])

    def bytes(self) -> dict[str, bytes]:
        texts = self.texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        text = texts.buffers()[2]
        text = b"" if text is None else text.to_pybytes()[offsets[0] : offsets[-1]]
        held = {"text": text, "sizes": np.diff(offsets).astype("<u4").tobytes(), "n": self.n.astype("<i8").tobytes(), "blocks_of": self.blocks_of.astype("<u4").tobytes(), "blocks": self.blocks.astype("<u4").tobytes(), "masks": self.masks.astype("<u4").tobytes()}
        pack = zstandard.ZstdCompressor(level=1).compress
        return {k: pack(v) for k, v in held.items()}

    def bytes_found(self) -> dict[str, bytes]:
        return {k: v for k, v in self.bytes().items() if k != "n"}

    @classmethod
    def of_rows(cls, rows: dict[str, list]) -> Packed:
        """All rows' phrases, one after another."""
        unpack = zstandard.ZstdDecompressor().decompress
        raw = {c: [unpack(v) for v in rows[c]] for c in _PARTS if c in rows}
        flat = lambda c, t="<u4": np.frombuffer(b"".join(raw[c]), dtype=t).astype(np.int64)
        offsets = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(flat("sizes"))])
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(raw["text"])))
        n = flat("n", "<i8") if "n" in rows else np.zeros(len(texts), dtype=np.int64)
        out = cls(texts, n, flat("blocks_of"), flat("blocks"), np.frombuffer(b"".join(raw["masks"]), dtype="<u4"))
        out.ends = np.cumsum([len(s) // 4 for s in raw["sizes"]])
        return out


# ---------------------------------------------------------------- shards
def slices(text: str, limit: int = 1 << 22) -> Iterator[str]:
    """Cuts a long text at ends of pieces, so that few words are held at once; a longer piece stays whole."""
    at = 0
    while len(text) - at > limit:
        end = _CUT.search(text, at + limit)
        if end is None:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:] if at else text


class Shard:
    """Words of one language on a line of positions."""

    def __init__(self):
        self.words: dict[bytes, int] = {b".": 0}
        self.line: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
        tokens = raw.translate(_ONE_MARK).replace(b".", b" . ").split()
        tokens.append(b".")
        words = self.words
        ids = [words.setdefault(t, len(words)) for t in tokens]
        self.line.append(np.array(ids, dtype=np.int64))
        self.size += len(ids)
        return len(ids)

    def counts(self, shard: int, lang: str, least: int, ranges: int) -> Iterator[pa.RecordBatch]:
        """_PACKED rows of words and of phrases of two words, range by range; bitmaps of pairs frequent by themselves stay with the shard (range -1 - shard)."""
        line = np.concatenate(self.line)
        position = np.flatnonzero(line)
        names = pa.array([w.decode("utf-8", "surrogatepass") for w in self.words], pa.string())
        hashes = np.array([zlib.crc32(w) for w in self.words], dtype=np.uint64)
        words = Bitmaps.of_positions(line[position], position)
        owner, _, n = words.popcounts()
        no_blocks = np.zeros(0, dtype=np.int64)
        yield from ranged(shard, lang, 1, Packed(names.take(pa.array(owner)), n, np.zeros(len(owner), dtype=np.int64), no_blocks, no_blocks), hashes[owner], ranges)
        pairs = extended(words, words.by_block(), len(names))
        owner, start, n = pairs.popcounts()
        left, right = owner // len(names), owner % len(names)
        texts = pc.binary_join_element_wise(names.take(pa.array(left)), names.take(pa.array(right)), " ")
        packed = Packed(texts, n, np.diff(start, append=len(pairs.owner)), pairs.block, pairs.mask)
        sure = n >= least
        yield from ranged(shard, lang, 2, packed.without_bitmaps(sure), hashes[left] * np.uint64(0x9E3779B1) + hashes[right], ranges)
        if sure.any():
            yield one_row(_PACKED, {"lang": lang, "range": -1 - shard, "length": 2, "shard": shard, **packed.take(np.flatnonzero(sure)).bytes()})


def one_row(schema: pa.Schema, row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in schema}], schema=schema)


def ranged(shard: int, lang: str, length: int, phrases: Packed, hashes: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """A _PACKED row for each range that the phrases' hashes fall into."""
    of = (mix64(hashes) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(of[order]) > 0)) if len(of) else []
    for a, b in zip(cuts, [*cuts[1:], len(of)]):
        yield one_row(_PACKED, {"lang": lang, "range": int(of[order[a]]), "length": length, "shard": shard, **phrases.take(order[a:b]).bytes()})


def shard_counts(docs: DataFrame, least: int, ranges: int, shard_words: int = 2 << 20) -> DataFrame:
    """_PACKED rows of docs (text, lang). A task begins new shards when those it holds have `shard_words` positions in all."""

    def run(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shards: dict[str, Shard] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            for lang in list(shards):
                yield from shards.pop(lang).counts(number, lang, least, ranges)
                number += 1
            held = 0

        for batch in arriving:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for part in slices(text or ""):
                    shard = shards.setdefault(lang, Shard())
                    held += shard.add(part)
                    if held >= shard_words:
                        yield from flush()
        yield from flush()

    return docs.select("text", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang")).mapInArrow(run, _PACKED_DDL)


def frequent_in_range(least: int):
    """Function of the _PACKED rows of one range: _FOUND rows of the phrases that occur `least` times, and of their bitmaps, shard by shard."""

    def count(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        lang, length, held = rows["lang"][0], rows["length"][0], Packed.of_rows(rows)
        own = {"lang": lang, "length": length}
        if rows["range"][0] < 0:
            yield one_row(_FOUND, own | {"shard": rows["shard"][0]} | held.bytes_found())
            return
        if length == 1:  # all words of the range, those that are rare too
            yield one_row(_FOUND, {"lang": lang, "length": 0, "phrase": "", "n": int(held.n.sum())})
        coded = held.texts.dictionary_encode()
        which = np.asarray(coded.indices)
        total = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(total, which, held.n)
        often = np.flatnonzero(total >= least)
        k = len(often)
        if not k:
            return
        columns = {"lang": pa.array([lang] * k), "length": pa.array([length] * k, pa.int32()), "phrase": coded.dictionary.take(pa.array(often)).cast(pa.string()), "n": pa.array(total[often])}
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(k, f.type)) for f in _FOUND], schema=_FOUND)
        if length == 1:
            return
        keep = np.flatnonzero((total[which] >= least) & (held.blocks_of > 0))
        cuts = np.searchsorted(keep, np.append(0, held.ends))
        for shard, a, b in zip(rows["shard"], cuts, cuts[1:]):
            if a < b:
                yield one_row(_FOUND, own | {"shard": shard} | held.take(keep[a:b]).bytes_found())

    return count


def longer(pairs: DataFrame, max_words: int) -> DataFrame:
    """lang, phrase, length, n of each shard's phrases of three to max_words words, whose neighbours all are pairs (_FOUND rows with bitmaps)."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("length", pa.int32()), ("n", pa.int64())])

    def grow(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        held = Packed.of_rows(rows)
        lang, names = rows["lang"][0], held.texts.cast(pa.large_string())
        maps = Bitmaps(np.repeat(np.arange(len(names)), held.blocks_of), held.blocks, held.masks)
        last = pa.array([p.rpartition(" ")[2] for p in names.to_pylist()], pa.large_string())
        right = maps.by_block()

        def deeper(prefix: Bitmaps, phrases: pa.Array, length: int) -> Iterator[pa.RecordBatch]:
            # A pair's bitmap marks its last word. Shifted by one, that of a phrase meets the pairs that start with the phrase's last word.
            met = extended(prefix, right, len(names))
            owner, start, n = met.popcounts()
            if not len(owner):
                return
            found = pc.binary_join_element_wise(phrases.take(pa.array(owner // len(names))), last.take(pa.array(owner % len(names))), pa.scalar(" ", pa.large_string()))
            k = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), found.cast(pa.string()), pa.array(np.full(k, length, dtype=np.int32)), pa.array(n)], schema=schema)
            if length < max_words:
                again = np.repeat(np.arange(k), np.diff(start, append=len(met.owner)))
                yield from deeper(Bitmaps(again, met.block, met.mask), found, length + 1)

        step = 1 << 15  # prefixes at a time
        cuts = np.searchsorted(maps.owner, np.arange(0, len(names) + step, step))
        for a, b in zip(cuts, cuts[1:]):
            if a < b and max_words > 2:
                yield from deeper(Bitmaps(maps.owner[a:b], maps.block[a:b], maps.mask[a:b]), names, 3)

    return by_group(pairs, ["shard"], grow, schema, "lang string, phrase string, length int, n bigint", whole=True)


# ---------------------------------------------------------------- counts over all shards
def ranges_for(docs: DataFrame, range_bytes: int = 16 << 20, fewest: int = 64) -> int:
    """So many ranges that each gets the phrases of about `range_bytes` of text."""
    return max(fewest, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes))


def phrase_counts(docs: DataFrame, max_words: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, n of all words and phrases that occur `least` times or more; lang, n words in all), written."""
    local = shard_counts(docs, least, ranges_for(docs))
    found = by_group(local, ["lang", "range", "length"], frequent_in_range(least), _FOUND, _FOUND_DDL, whole=True)
    found = staged(found, "frequent")
    columns = ["lang", "phrase", "length", "n"]
    more = longer(found.where("shard is not null").select("shard", "lang", *(c for c in _PARTS if c != "n")), max_words)
    more = more.groupBy("lang", "phrase", "length").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    sums = found.where("length = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return found.where("shard is null and length > 0").select(*columns).unionByName(staged(more, "longer").select(*columns)), sums


# ---------------------------------------------------------------- scores
def part(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, length, a, l, r, score of each phrase of two words and more, by its lowest-scoring cut, the first of equal ones."""
    own = frequent.where("length > 1").select("lang", "phrase", "length", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "length", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    sides = [frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(side[0])) for side in ("left", "right")]
    met = cuts.join(sides[0], ["lang", "left"]).join(sides[1], ["lang", "right"])
    million, times = F.lit(1_000_000).cast("decimal(7,0)"), F.col("a").cast("decimal(15,0)")
    score = F.call_function("div", million * times * times, F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)"))
    best = met.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "length", "a", "b.l", "b.r", "b.score")


def inside(frequent: DataFrame) -> DataFrame:
    """lang, phrase, most: of each phrase of two words and more, how often its most frequent longer phrase occurs."""
    own = frequent.where("length > 2").select("lang", "length", "n", F.split("phrase", " ").alias("w"))
    sizes = F.sequence(F.lit(2), F.col("length") - 1)
    parts = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.col("length") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    return own.select("lang", "n", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases, but for those that mostly (`share` percent) belong to a longer one."""
    frequent, sums = phrase_counts(docs, max_words, least)
    rows = scored(frequent).join(inside(frequent), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    order = F.desc("score"), F.desc("a"), "phrase"
    # A language's best are among the best of each of 64 parts, so its last task sorts 64 x top rows at most.
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top)
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return first.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
