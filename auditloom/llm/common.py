"""Helpers that several corpus operators share: staged tables, word hashing, token ids, partition-wise grouping."""

from __future__ import annotations

import array
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, and the same set as a regular expression class.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"

#: Words of a shingle, and the similarity from which two documents are near copies.
SHINGLE_WORDS = 5
NEAR_SIMILARITY = 0.8


# ---------------------------------------------------------------- staged tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session (tests) may leave it unset and gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-auditloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: the lineage ends there, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark hand texts to Python in batches of at most `rows` rows: whole texts are long, and each task holds some batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores behind it if a column has it already."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


# ---------------------------------------------------------------- hashing words with numpy
def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and odd multipliers, modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACE_BYTES)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order as uint64, number of words of each text)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = _IS_WORD[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    body = buf[inside].astype(np.uint64)
    at = np.cumsum(inside)[starts] - 1
    lengths = np.diff(at, append=len(body))
    place = np.arange(len(body)) - np.repeat(at, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, _BASE))
    return mix64(np.add.reduceat((body + np.uint64(1)) * powers[place], at) + lengths.astype(np.uint64)), counts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; a shorter, non-empty text is one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    # Of runs of twice the words at each step; a run of a + b words is the a words' hash times the base to the power b, and the b words'.
    part, step, power, out, done = words, 1, int(_BASE), None, 0
    while True:
        if size & step:
            n = len(words) - done - step + 1
            out = part if out is None else out[:n] * np.uint64(power) + part[done : done + n]
            done += step
            if done == size:
                return mix64(out)
        part = part[:-step] * np.uint64(power) + part[step:]
        step, power = 2 * step, power * power % (1 << 64)


def chunks(ids: list, texts: list, limit: int = 1 << 21) -> Iterator[tuple[list, list]]:
    """Cuts a batch into pieces of about `limit` characters, so that numpy's arrays stay small; a longer text is a piece by itself."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > limit:
            yield ids[start:i], texts[start:i]
            start, held = i, 0
        held += n
    if start < len(texts):
        yield ids[start:], texts[start:]


# ---------------------------------------------------------------- token ids
def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenBytes:
    """Token ids of texts as little-endian uint32 bytes, by a tokenizers file, without special tokens.

    For a byte-level vocabulary that drops white space, lowers case and never joins words and punctuation, as
    `word_bpe_49k.json` does, a text is cut at blanks and line ends and each distinct piece is encoded once: Latin words,
    with or without a mark behind, by the library's model itself, all other pieces by its whole pipeline. A test holds
    this against encoding whole texts. The memo is bounded by `limit` pieces of up to 64 characters and starts anew beyond it.
    """

    _of: dict[str, TokenBytes] = {}
    _LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f]+")
    _MARKS = ",.!?;:"

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        self.tokenizer, self.limit, self.memo = Tokenizer.from_file(path), limit, PieceMemo(self.piece)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marks = {m: self.whole(m) for m in self._MARKS}

    @classmethod
    def of(cls, path: str) -> TokenBytes:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, word: str) -> bytes:
        core, tail = (word[:-1], self.marks[word[-1]]) if word[-1] in self.marks else (word, b"")
        if self._LATIN.fullmatch(core) is None:
            return self.whole(word)
        if tail:
            return self.memo[core] + tail
        core = core.lower()
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.model.tokenize(core)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if len(self.memo) > self.limit:
            self.memo.clear()
            self.memo[""] = b""
        return b"".join(map(self.memo.__getitem__, (text or "").replace("\n", " ").split(" ")))


class PieceMemo(dict):
    """Ids by piece; a piece that is missing is encoded, and kept if it is short."""

    def __init__(self, piece: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.piece = piece

    def __missing__(self, word: str) -> bytes:
        ids = self.piece(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


# ---------------------------------------------------------------- groups, partition by partition
def by_group(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list]], Iterable], schema: pa.Schema, ddl: str, order: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Calls fn with the columns of each group as lists and yields its rows; if `whole`, fn gives Arrow batches instead.

    Groups are dealt by key and sorted within partitions, so one pass over Arrow batches meets each group as a run;
    that saves a pandas frame for each of many tiny groups. Callers bound the size of a group beforehand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        key, out = None, []
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            row_keys = list(zip(*(columns[k] for k in keys)))
            cuts = [0, *(i for i in range(1, len(row_keys)) if row_keys[i] != row_keys[i - 1]), len(row_keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and row_keys[a] != key:
                    if whole:
                        yield from fn(held)
                    else:
                        out.extend(fn(held))
                    held = {}
                key = row_keys[a]
                if not held:
                    held = {n: v[a:b] for n, v in columns.items()}
                else:
                    for n, v in columns.items():
                        held[n].extend(v[a:b])
            if len(out) >= 5000:
                yield rows_to_batch(out, schema)
                out = []
        if held and whole:
            yield from fn(held)
        elif held:
            out.extend(fn(held))
        yield rows_to_batch(out, schema)

    dealt = df.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *(order or []))
    return dealt.mapInArrow(run, ddl)


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
