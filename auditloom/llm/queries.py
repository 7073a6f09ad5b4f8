"""The corpus queries, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import byte_bpe, chat_format, collocations, decontaminate, html_extract, merkle, minhash_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup, token_output
from auditloom.llm.common import shared_path, small_batches, staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD_BYTES)
    return out.select("doc_id", "shard_depth", "shard", "shard_bytes", "shard_rows")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_output.write(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_output.digest(spark, path)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.judge(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.length("clean_text").cast("bigint").alias("clean_chars"), F.md5(F.encode("clean_text", "utf-8")).alias("clean_md5"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(n).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for n, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digest(staged(chat_format.formatted(rows, TOKENIZER), "windows"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered()).drop("proof")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.decoded(byte_bpe.encoded(table(spark, sf_dir, "documents"), BYTE_TOKENIZER), BYTE_TOKENIZER))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_token_output, op3_minhash_dedup, op4_html_extraction, op5_quality_rules, op6_substring_dedup, op7_packing, op8_decontamination, op9_chat_formatting, op10_quality_classifier, op11_merkle_manifest, op12_byte_bpe, op13_collocations)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(x: str) -> str:
    """Bit by bit over the bytes of a text of digits."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({x}, ''), lambda d: CAST(ord(d) AS BIGINT))), lambda c, b: {byte}), 4294967295)"


def _merkle_sql(levels: int = 8, tops: int = 6) -> str:
    """A single node of a tree stays as it is on all levels above it; so all trees may have the same number of levels."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x} END"
    head = " || ".join(f"({field(c)})" for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        f"d AS (SELECT *, {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS bad FROM documents)",
        f"h AS (SELECT doc_id, source, sha256({head} || ({field('text')})) AS leaf, CASE WHEN bad THEN sha256({head} || ({field(lower)})) ELSE sha256({head} || ({field('text')})) END AS shown FROM d)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM h)",
        "a0 AS (SELECT g, i, n, leaf AS h FROM p)",
    ]
    for tree, depth in (("a", levels), ("b", tops)):
        if tree == "b":
            parts.append(f"b0 AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM a{levels})")
        for k in range(depth):
            parts.append(f"{tree}{k + 1} AS (SELECT g, i // 16 AS i, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {tree}{k} GROUP BY g, i // 16)")
            side = lambda frame: f"coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN {frame}), '')"
            parts.append(f"s{tree}{k} AS (SELECT g, i, n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {tree}{k})")
    steps = [(f"sa{k}", f"x.g = p.g AND x.i = p.i // {16**k}") for k in range(levels)] + [(f"sb{k}", f"x.i = p.g // {16**k}") for k in range(tops)]
    parts.append("w0 AS (SELECT doc_id, leaf, g, i, shown AS c, '' AS proof FROM p)")
    for k, (t, on) in enumerate(steps):
        parts.append(f"w{k + 1} AS (SELECT p.* REPLACE (CASE WHEN x.n = 1 THEN c ELSE sha256(l || c || r) END AS c, proof || l || r AS proof) FROM w{k} p JOIN {t} x ON {on})")
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, o.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, c AS folded_root, c = t.h AS verified FROM w{len(steps)} p JOIN a{levels} o ON o.g = p.g JOIN b{tops} t ON t.g = 0"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_PAUSE_AT_END = quality_rules.PAUSE_AT_END.replace("'", "''")

ORACLE_SQL = {
    "op1_sharding": f"""
        WITH h AS (
            SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 10) AS BIGINT) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS b FROM documents
        ), sums AS (
            SELECT d, h >> (40 - d) AS p, sum(b) AS b, count(*) AS n FROM h, range(0, 31) t(d) GROUP BY ALL
        ), fit AS (
            SELECT doc_id, min(CAST(d AS BIGINT)) AS shard_depth FROM h, sums WHERE p = h >> (40 - d) AND (sums.b <= {SHARD_BYTES} OR n = 1) GROUP BY doc_id
        )
        SELECT h.doc_id, shard_depth, h >> (40 - shard_depth) AS shard, CAST(sums.b AS BIGINT) AS shard_bytes, n AS shard_rows
        FROM h JOIN fit USING (doc_id) JOIN sums ON d = shard_depth AND p = h >> (40 - shard_depth)""",
    "op5_quality_rules": rf"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
        ), each AS (
            SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= 5
        ), wins AS (
            SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS r FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), tagged AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, r) AS c FROM wins WHERE r IS NOT NULL
        ), starts AS (
            SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM tagged WHERE c > 1
        ), reps AS (
            SELECT doc_id, sum(least(5, i - coalesce(before, -5))) AS n FROM starts GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w) GROUP BY doc_id, x
        ), seen AS (
            SELECT doc_id, x, i, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
                   CASE WHEN regexp_matches(x, '{_PAUSE_AT_END}') THEN CASE WHEN length(x) <= 60 THEN 2 ELSE 0 END
                   WHEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 3 AND NOT regexp_matches(x, '{quality_rules.UNMARKED}') THEN 1 ELSE 0 END AS short FROM lines
        ), menu AS (
            SELECT doc_id, x, i, n, coalesce(short = 1 AND (lag(short, 1, 0) OVER o = 1 AND (lag(short, 2, 0) OVER o = 1 OR lead(short, 1, 0) OVER o = 1) OR lead(short, 1, 0) OVER o = 1 AND lead(short, 2, 0) OVER o = 1)
                AND 2 NOT IN (lag(short, 1, 0) OVER o, lag(short, 2, 0) OVER o, lag(short, 3, 0) OVER o, lead(short, 1, 0) OVER o, lead(short, 2, 0) OVER o, lead(short, 3, 0) OVER o), false) AS menu
            FROM seen WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), good AS (
            SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS clean, sum(length(x)) AS good_chars FROM menu
            WHERE NOT (menu
                OR length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > length(x) * 0.1
                OR length(regexp_replace(x, '[^|»›·•]', '', 'g')) * 20 > length(x)
                OR ((length(x) >= 240 AND NOT regexp_matches(x, '{quality_rules.SENTENCE_MARKS}') OR n >= 10 AND NOT regexp_matches(x, '{quality_rules.SENTENCE_ENDS}')) AND NOT regexp_matches(x, '{quality_rules.UNMARKED}'))
                OR (length(x) <= 120 AND regexp_matches(x, '{quality_rules.BOILERPLATE}')))
            GROUP BY doc_id
        ), m AS (
            SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
                   length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(w.l) - len(list_distinct(w.l)) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words,
                   length(array_to_string(w.l, '')) AS line_chars, coalesce(good_chars, 0) AS good_chars, coalesce(clean, '') AS clean
            FROM w LEFT JOIN good USING (doc_id) LEFT JOIN reps USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND line_chars - good_chars <= 0.5 * line_chars AS kept,
               CAST(length(clean) AS BIGINT) AS clean_chars, md5(clean) AS clean_md5 FROM m""",
    "op8_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, {_WORDS} AS w FROM documents
        ), ds AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
        ), b AS (
            SELECT item_id, {_WORDS} AS w FROM benchmark
        ), bs AS (
            SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)
        ), n AS (
            SELECT item_id, count(*) AS n FROM bs GROUP BY item_id
        )
        SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item_shingles FROM ds JOIN bs USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING 10 * count(*) >= 8 * any_value(n)""",
    "op11_merkle_manifest": _merkle_sql(),
    "op13_collocations": rf"""
        WITH p AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), f AS (
            SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS n FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 4) t(k) WHERE len(w) >= k) GROUP BY ALL
        ), sums AS (
            SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), cand AS (
            SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10
        ), cuts AS (
            SELECT c.lang, c.phrase, c.k, a, j, x.n AS l, y.n AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
            JOIN f x ON x.lang = c.lang AND x.k = c.j AND x.phrase = array_to_string(list_slice(c.w, 1, c.j), ' ')
            JOIN f y ON y.lang = c.lang AND y.k = c.k - c.j AND y.phrase = array_to_string(list_slice(c.w, c.j + 1, c.k), ' ')
        ), best AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts) WHERE place = 1
        ), longer AS (
            SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE k = 3) GROUP BY ALL
        ), kept AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
        )
        SELECT lang, rank, phrase, a, l, r, sums.n, score FROM kept JOIN sums USING (lang) WHERE rank <= 2000""",
}
