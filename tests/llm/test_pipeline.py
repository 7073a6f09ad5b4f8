"""The pipeline's stages, each against brute force on its own input."""

import collections
import re

import corpus_pipeline
from auditloom.llm import common, queries
from tests.llm.test_ops import ODD, WORD, brute_classes, brute_clean, check_pieces, frame, shingles

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, items = docs.columns, [shingles(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "packing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, SMALL), name)
        if name == "packing":
            check_pieces(before.items(), docs.collect())
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality_rules":
            want = {i: brute_clean(t) for i, t in before.items()}
            assert after == {i: t for i, t in want.items() if t is not None} and len(after) > 0.7 * len(before)
        if name == "near_dedup":
            classes = brute_classes(before)
            assert after == {i: t for i, t in before.items() if classes[i] == i}
        if name == "substring_dedup":
            seen = set()
            for i in sorted(after):
                w = WORD.findall(after[i])
                runs = {tuple(w[a : a + 60]) for a in range(len(w) - 59)}
                assert not runs & seen
                seen |= runs
            assert sum(after[i] == before[i] for i in after) > 0.9 * len(before)
        if name == "decontamination":
            assert after == {i: t for i, t in before.items() if not any(len(s & shingles(t)) >= 0.8 * len(s) for s in items)}
        before = after
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_stages_of_odd_rows(spark):
    long = " ".join(f"w{i} and" for i in range(60)) + "."
    rows = [*ODD, (8, long), (8, long), (9, long + " more of it."), (10, long.upper()), (None, long), (11, None)]
    docs = frame(spark, rows)
    for source in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = common.staged(stage(spark, source, SMALL), name)
            if name != "packing":
                assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            n = out.count()
            assert (n == 0) == source.isEmpty(), name
            if not n:
                continue
            if name == "quality_rules":
                assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 8, 8, 9, 10]
            if name == "near_dedup":
                assert sorted(r.doc_id or -1 for r in out.collect() if r.text and "and" in r.text.lower()) == [-1, 8, 10]
            if name == "decontamination":
                assert n == len(rows)


def test_every_query_is_registered():
    import __spark_entry__

    numbers = collections.Counter(re.match(r"op(\d+)_", q)[1] for q in __spark_entry__.queries() if re.match(r"op\d+_", q))
    assert numbers == {str(n): 1 for n in range(1, 11)} and "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
