"""Quality classifier of averaged subword embeddings, trained with numpy.

A text's features are its words, the character n-grams of each word between < and >, and a mark for each word that
repeats the one before; each is hashed to a row of an embedding table. The rows' mean goes through a linear layer and a
softmax. Table and layer are learned together by stochastic gradient descent on a bounded sample of labelled texts:
`per_class` texts of each label, those with the least hash of their id, weighted back to the labels' true shares. Texts
are learned from whole: tasks count their features and write them down, and the driver reads six bytes for each distinct
one. These are at most ROWS of a text, however long it is (1.2 GB if each of two times 1,500 texts fills the whole
table). Scores are computed for every text, from all its features.

For scoring, table and layer fold into one number per row (both are linear), so a text's logit is a mean of numbers.

Edge cases: null and empty texts have no features and score the bias; a null doc_id counts as held out and is never
learned from; a document labelled twice has its largest label; without labels every score is 0.5; repeated rows score
alike; of rows with one labelled id, the text with the least hash is learned from; extra columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import mix64, rows_to_batch, staged

ROWS, DIM = 1 << 16, 8
NGRAMS = (2, 3, 4, 5)
REPEAT = 0  # the row of the mark; hashes use the others


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all features, number of features of each word) of distinct words, vectorised over their code points."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))  # code points from here to the word's end
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max(initial=0)) + 1, np.uint64(0x9E3779B97F4A7C15)))
    hashes, owners = [np.add.reduceat((points + np.uint64(7)) * powers[place], starts) if len(words) else points], [np.arange(len(words))]
    for n in NGRAMS:
        some = np.flatnonzero(left >= n)
        h = np.full(len(some), np.uint64(n))
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ points[some + j]
        hashes.append(h)
        owners.append(owner[some])
    rows, owners = mix64(np.concatenate(hashes)) % np.uint64(ROWS - 1) + np.uint64(1), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def repeats(words: list[str]) -> int:
    return sum(map(operator.eq, words, words[1:]))


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, their counts) of the features of a whole text."""
    words = (text or "").split()
    places: dict[str, int] = {}
    for w in words:
        places[w] = places.get(w, 0) + 1
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, sizes = word_features(list(places))
    total = np.bincount(rows, np.repeat(list(places.values()), sizes), minlength=ROWS).astype(np.int64)
    total[REPEAT] = repeats(words)
    some = np.flatnonzero(total)
    return some, total[some]


class Model:
    """One number for each row, and a bias: logit = mean of the numbers of a text's features + bias."""

    def __init__(self, numbers: np.ndarray, bias: float):
        self.numbers, self.bias = numbers, bias
        self.memo: dict[str, complex] = {}

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        memo = self.memo
        try:
            total = sum(map(memo.__getitem__, words), 0j)
        except KeyError:
            if len(memo) > 400_000:
                memo.clear()
            new = list({w for w in words if w not in memo})
            for part in (new[i : i + 20_000] for i in range(0, len(new), 20_000)):
                rows, sizes = word_features(part)
                sums = np.add.reduceat(self.numbers[rows], np.cumsum(sizes) - sizes)
                memo.update(zip(part, map(complex, sums.tolist(), sizes.tolist())))
            total = sum(map(memo.__getitem__, words), 0j)
        n = repeats(words)
        size = total.imag + n
        logit = self.bias + ((total.real + n * float(self.numbers[REPEAT])) / size if size else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))

    def __getstate__(self):
        return self.numbers, self.bias

    def __setstate__(self, state):
        self.__init__(*state)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """Learns table and layer by stochastic gradient descent on (rows, counts > 0), with labels 0 and 1 and sample weights."""
    draw = np.random.default_rng(seed)
    table = draw.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, step = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in draw.permutation(len(texts)):
            lr = rate * (1 - step / steps)
            step += 1
            rows, counts = texts[i]
            share = counts / max(1, counts.sum(dtype=np.int64))
            hidden = share @ table[rows]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            slope = p * weights[i]
            back = layer @ slope
            layer -= lr * np.outer(hidden, slope)
            bias -= lr * slope
            table[rows] -= (lr * len(rows) ** 0.5) * share[:, None] * back[None, :]
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """Learns from at most per_class texts of each label, none of them held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    shares = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if not shares:
        return Model(np.zeros(ROWS), 0.0)
    chosen = None
    for q in (0, 1):
        least = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = least if chosen is None else chosen.unionByName(least)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("rows", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t) for t in batch.column("text").to_pylist()]
            yield rows_to_batch([(d, q, r.astype("<u2").tobytes(), c.astype("<u4").tobytes()) for d, q, (r, c) in zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), found)], schema)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id").agg(F.first("quality").cast("int").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    features = staged(own.mapInArrow(run, "doc_id bigint, quality int, rows binary, counts binary"), "op10-features")
    sample = sorted(features.toLocalIterator(), key=lambda r: r.doc_id)  # 2 * per_class rows at most
    y = np.array([r.quality for r in sample], dtype=np.int64)
    texts = [(np.frombuffer(r.rows, dtype="<u2"), np.frombuffer(r.counts, dtype="<u4")) for r in sample]
    weights = np.array([shares[int(q)] / max(1, (y == q).sum()) for q in y])
    return train(texts, y, weights / weights.mean() if len(y) else weights)


def scored(docs: DataFrame, labels: DataFrame, per_class: int = 1500, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            scores = [score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
