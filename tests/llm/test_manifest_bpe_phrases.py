"""Merkle manifest, byte-level encoding and phrase mining against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditloom.llm import byte_bpe, collocations, merkle, queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree bigint, place string, shard string, n string, ids string, phrase string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").repartition(4).cache()


def table_of(spark, rows):
    """doc_id, text, lang, source, n_chars, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, *["k"] * 5) for r in rows], COLUMNS)


ODD = [(None, "Null Id", "en", "a", 1), (1, None, None, None, None), (2, "", "en", "", 0), (3, "X y", "en", "x", 3), (3, "X y", "en", "x", 3), (3, "Other", "de", "x", 3), (4, "Long é " * 40_000, "fr", "￿", 9), (5, "漢字 ÀB", "fr", "\U0001f600", 9)]


# ------------------------------------------------------------------ Merkle manifest
def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i // 16 * 16
            yield i - a, [h for j, h in enumerate(level[a : a + 16], a) if j != i]
            i //= 16

    of_source = collections.defaultdict(list)
    for r in rows:
        of_source[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])), r))
    sources = sorted(of_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([k[2] for k, _ in sorted(of_source[s], key=lambda x: x[0])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for g, s in enumerate(sources):
        for i, (k, r) in enumerate(sorted(of_source[s], key=lambda x: x[0])):
            proof, text = [*path(trees[s], i), *path(top, g)], r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            held = leaf(r, text)
            for slot, siblings in proof:
                held = digest(*siblings[:slot], held, *siblings[slot:])
            out.append((r["doc_id"], k[2], trees[s][-1][0], top[-1][0], digest(*(h for _, hs in proof for h in hs)), held, held == top[-1][0]))
    return sorted(out, key=repr)


def manifest(df, **options):
    return sorted((tuple(r) for r in merkle.manifest(df, merkle.tampered(), **options).drop("proof").collect()), key=repr)


def test_manifest_equals_brute_force(docs):
    assert manifest(docs) == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_odd_rows_many_sources_and_hot_ones(spark):
    rows = [*ODD, *((7, "Same", "en", "x", 1) for _ in range(40)), *((i, "T", "en", f"s{i:05}", 1) for i in range(300)), *((i, "Hot", None, "x", i) for i in range(400))]
    df = table_of(spark, rows)
    assert manifest(df) == brute_manifest([r.asDict() for r in df.collect()])
    for few in ([], ODD[:1], ODD[3:5]):
        df = table_of(spark, few)
        assert manifest(df) == brute_manifest([r.asDict() for r in df.collect()])


def test_levels_joined_by_coordinate_give_the_same_proofs(docs, monkeypatch):
    want = manifest(docs)
    monkeypatch.setattr(merkle, "proved", lambda leaves, runs, f=merkle.proved: f(leaves, runs, broadcast_runs=0))
    monkeypatch.setattr(merkle, "small", lambda table: table)
    assert manifest(docs) == want


def test_a_change_of_any_field_is_noticed(docs):
    out = merkle.manifest(docs).where("not verified or folded_root <> root")
    assert out.isEmpty()
    changed = merkle.manifest(docs, F.concat(F.coalesce("text", F.lit("")), F.lit(" ")))
    assert changed.where("verified").isEmpty()
    assert merkle.manifest(docs).select("root").distinct().count() == 1


# ------------------------------------------------------------------ byte-level encoding
LIBRARY = Tokenizer.from_file(queries.BYTE_TOKENIZER)
OWN = byte_bpe.ByteBpe(queries.BYTE_TOKENIZER)


def library_ids(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def same(texts, own=OWN):
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids == library_ids(text), text
        assert own.decode(ids) == LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_encoding_equals_the_library(docs):
    texts = [r.text for r in docs.collect()]
    same(texts)
    small = byte_bpe.ByteBpe(queries.BYTE_TOKENIZER, limit=50)
    for i in range(0, len(texts), 20):
        same(texts[i : i + 20], small)


def test_encoding_of_odd_texts():
    same(["a   b", "a \n b", "\n \n b", " a", "a ", "  ", "", None, "\n\n b", "a\n \nb", "\r\n a\r\n\r\n b", "a\tb \t c", "x<|endoftext|> <|endoftext|>y  ", "<|endoftext|>", "<|end", "it's we'll I'M 's 'S", "漢字漢字 12345 é ́x", "՘ab֋1 ՘", "\x1c a\x85b\xa0c", "🎉 👍🏽"])
    same(["a" * n for n in range(1, 40)] + ["ab" * 3000, "x" * 50_000, "".join(random.Random(1).choices("abcdefgh", k=100_000))])
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(["".join(points[i : i + 700]) for i in range(0, len(points), 700)] + [f"a{c}1{c}!{c}{c} {c}a" for c in points[::97]])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "漢", "!", "<|endoftext|>", "\xa0", "the", "xxx", "՘"]), max_size=30).map("".join))
def test_encoding_of_any_mixture(text):
    same([text])


def test_decoding_of_broken_bytes():
    ids = np.array([OWN.byte_ids[0xE6], OWN.byte_ids[0x41], OWN.byte_ids[0xFF]], dtype="<u4").tobytes()
    assert OWN.decode(ids) == LIBRARY.decode(np.frombuffer(ids, "<u4").tolist()) == "�A�"


def test_encoding_of_rows(spark):
    df = table_of(spark, ODD)
    got = byte_bpe.digest(byte_bpe.decoded(byte_bpe.encoded(df, queries.BYTE_TOKENIZER), queries.BYTE_TOKENIZER)).collect()
    want = []
    for doc_id, text, *_ in ODD:
        ids = library_ids(text)
        want.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest(text or "")))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert queries.op12_byte_bpe(spark, SMALL).count() == 200
    assert byte_bpe.encoded(df.limit(0), queries.BYTE_TOKENIZER).count() == 0


# ------------------------------------------------------------------ phrases
def brute_phrases(rows, max_words=3, least=10, share=50, top=2000):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = collections.Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * most[p] < share * a:
                s, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((s, a, " ".join(p), left, right))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, words[lang], s) for i, (s, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def phrases(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def pairs_of(df):
    return [(r.text, r.lang) for r in df.select("text", "lang").collect()]


def test_phrases_equal_brute_force(docs):
    assert phrases(docs) == brute_phrases(pairs_of(docs))
    few = docs.where("doc_id < 60")
    assert phrases(few, max_words=5, least=3, share=70, top=50) == brute_phrases(pairs_of(few), max_words=5, least=3, share=70, top=50)


def test_phrases_do_not_depend_on_shards(docs, monkeypatch):
    want = phrases(docs)
    monkeypatch.setattr(collocations, "shard_counts", lambda df, least, ranges, f=collocations.shard_counts: f(df, least, 5, shard_words=5000))
    assert phrases(docs.repartition(13)) == want


def test_phrases_of_odd_rows(spark):
    rows = [(None, None, "en"), (1, "", None), (2, "A b A b. a B  a\tb\x0bA b", None), (3, "x x x x x x x x x x x x x x", "en"), (4, "y y y", ""), (5, "é É", None), (6, "s\x1cs s\x1cs", "en"), (7, "a.a.a b", "und")] * 6
    rows += [(8, "k l m n " * 20_000, "en")]
    df = table_of(spark, [(*r, "s", 1) for r in rows])
    assert phrases(df) == brute_phrases(pairs_of(df))
    assert phrases(df.limit(0)) == []
    assert [len(t) for t in collocations.slices("ab." * 10, 7)] == [9, 9, 9, 3] and list(collocations.slices("", 7)) == [""]


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_000, 9_000_000_000_001, 9_100_000_000_000  # noqa: E741
    counts = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, l), ("en", "b", 1, r)], "lang string, phrase string, length int, n bigint")
    assert [tuple(x) for x in collocations.scored(counts).collect()] == [("en", "a b", 2, a, l, r, 1_000_000 * a * a // (l * r))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200))
def test_bitmaps_shift_and_count(line):
    line = np.array(line)
    at = np.flatnonzero(line)
    words = collocations.Bitmaps.of_positions(line[at], at)
    met = collocations.extended(words, words.by_block(), 7, stretch=16)
    owner, _, n = met.popcounts()
    want = collections.Counter((int(a), int(b)) for a, b in zip(line, line[1:]) if a and b)
    assert dict(zip(zip((owner // 7).tolist(), (owner % 7).tolist()), n.tolist())) == want
