"""Byte-pair encoding and decoding with a byte-level tokenizers file, by merge rounds in numpy over many words at once.

The symbols of all words of a batch lie in one flat array, with links to the neighbours within a word. A round looks for
the pair of least rank in each word, merges all its places from the left, and ranks the pairs beside them anew; ranks come
from a binary search in the sorted keys of all mergeable pairs. Merging every place of the least pair at once equals
merging one place at a time, since a pair that a merge makes ranks behind that merge. Words that are done leave the array
when they make up half of it. Texts are cut at blanks first where that can't change their words, and each distinct piece
is encoded once for as long as the bounded memo holds it.

Special tokens in a text become their ids, as the library does it. Decoding joins the bytes of the ids; bytes that are no
UTF-8 become replacement characters.

Edge cases: a null text is an empty one and has no ids; rows with null or repeated ids are encoded one by one; a text
without blanks is one word or few, whose rounds pass over a flat array of its length; an empty table gives no rows; other
columns are dropped.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import _byte_letters, chunks

#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int64(1) << 40
_SHIFT = np.int64(1) << 20
_MARKS = tuple(".,;:!?")


class ByteBpe:
    """Ids of texts and texts of ids, as the tokenizers library gives them for the file, without truncation and padding."""

    _of: dict[str, ByteBpe] = {}

    def __init__(self, path: str, limit: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * int(_SHIFT) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        bytes_of = {x: b for b, x in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.table = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.table[i] = bytes(bytes_of[c] for c in token)
        for token, i in self.special.items():
            self.table[i] = token.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words, self.other_space = regex.compile(WORDS), regex.compile(r"[^\S \n]")
        self.limit, self.first, self.later = limit, {}, {}
        self.marks = dict(zip(_MARKS, self.merged(list(_MARKS))))

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    # ------------------------------------------------------------ merging
    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; _NONE for pairs that no merge joins."""
        keys = left * _SHIFT + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian uint32 bytes."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_word, done = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while len(symbols):
            word, symbols = self.rounds(word, symbols, done_word, done)
        at, ids = np.concatenate(done_word), np.concatenate(done)
        order = np.argsort(at, kind="stable")
        flat, cuts = ids[order].astype("<u4").tobytes(), 4 * np.searchsorted(at[order], np.arange(len(raw) + 1))
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def rounds(self, word: np.ndarray, symbols: np.ndarray, done_word: list, done: list) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds until half of the words or symbols are through; gives back what is left of the others."""
        n = len(symbols)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sizes = np.diff(starts, append=n)
        # Slot n stands for "no neighbour": no pair has its symbol.
        symbols = np.append(symbols, _SHIFT - 1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts + sizes - 1], before[starts] = n, n
        after[n] = before[n] = n
        rank = self.rank(symbols, symbols[after])
        alive, held = np.ones(n, dtype=bool), n
        while True:
            least = np.minimum.reduceat(rank[:n], starts)
            live = least < _NONE
            if 2 * np.count_nonzero(live) <= len(live) or 2 * held <= n:
                break
            hit = np.flatnonzero((rank[:n] == np.repeat(least, sizes)) & (rank[:n] < _NONE))
            chained = np.append(False, after[hit[:-1]] == hit[1:])
            if chained.any():  # of a run of equal symbols, every second pair from the left
                place = np.arange(len(hit))
                hit = hit[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            gone = after[hit]
            symbols[hit] = self.made[rank[hit]]
            alive[gone], rank[gone] = False, _NONE
            held -= len(gone)
            after[hit] = after[gone]
            before[after[hit]] = hit
            near = np.concatenate([hit, before[hit]])
            rank[near] = self.rank(symbols[near], symbols[after[near]])
        through = alive & np.repeat(~live, sizes)
        done_word.append(word[through])
        done.append(symbols[:n][through])
        rest = alive & np.repeat(live, sizes)
        return word[rest], symbols[:n][rest]

    # ------------------------------------------------------------ texts
    def words_of(self, text: str) -> list[str]:
        """Words of a text. Code points that are no letters for the library, as its tables have none, are none here."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text if c > "՗"):
            hidden = "".join("!" if c > "՗" and unicodedata.category(c) == "Cn" else c for c in text)
            return [text[m.start() : m.end()] for m in self.words.finditer(hidden)]
        return self.words.findall(text)

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """(pieces as they are, pieces that follow a blank), which lie in this order and never cut a word in two."""
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or self.other_space.search(text):
            return self.words_of(text), []
        head, *rest = text.split(" ")
        return [head], rest

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        parts = []
        for t in texts:
            t = t or ""
            segments = self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t]
            parts.append([self.special[s] if s in self.special else self.pieces(s) for s in segments])
        known = self.first, self.later
        for side in (0, 1):
            wanted = set().union(*(p[side] for ps in parts for p in ps if not isinstance(p, int)))
            if len(known[side]) + len(wanted) > self.limit:
                known[side].clear()
            self.learn(list(wanted - known[side].keys()), known[side], " " * side)
        out = []
        for ps in parts:
            out.append(b"".join(np.uint32(p).astype("<u4").tobytes() if isinstance(p, int) else b"".join(map(known[0].__getitem__, p[0])) + b"".join(map(known[1].__getitem__, p[1])) for p in ps))
        return out

    def learn(self, pieces: list[str], known: dict[str, bytes], blank: str) -> None:
        """Pieces of letters, with or without a mark behind, are cut without the pattern; a word seen before isn't merged again."""
        cut = []
        for p in pieces:
            if p.isalpha():
                cut.append((blank + p,))
            elif p[-1:] in _MARKS and p[:-1].isalpha():
                cut.append((blank + p[:-1], p[-1]))
            else:
                cut.append(self.words_of(blank + p))
        ids = self.marks.copy()
        for ws in cut:
            for w in ws:
                if w not in ids:
                    ids[w] = known.get(w[len(blank) :]) if w.startswith(blank) else None
        fresh = [w for w, x in ids.items() if x is None]
        ids.update(zip(fresh, self.merged(fresh)))
        for p, ws in zip(pieces, cut):
            known[p] = ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


# ---------------------------------------------------------------- tables
def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian uint32 bytes) of each row of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path)
        for batch in batches:
            for ids, texts in chunks(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 1 << 22):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bpe.encode_all(texts), pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of each row of tokens (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path)
        for batch in batches:
            texts = [bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, text string")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decoded()'s rows."""
    return tokens.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))
