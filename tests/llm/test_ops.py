"""Each corpus operator against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import chat_format, common, components, decontaminate, html_extract, minhash_dedup, packing, quality_classifier, quality_rules, queries, sharding, substring_dedup, token_output

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").repartition(4).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def frame(spark, rows, extra=True):
    """doc_id, text with columns whose names the operators use themselves."""
    names = "kept n_words _row _spans _kept cut_id kept_id node key hash id bucket part start n_chars"
    df = spark.createDataFrame([(*r, "k", *[7] * 14) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{c} {'string' if c == 'kept' else 'bigint'}" for c in names.split()))
    return df if extra else df.select("doc_id", "text")


ODD = [(None, "null id " * 8), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, "a b c d e f g h i j k l " * 3000), (7, "ünï çødé — „text“ 漢字 " * 5), (7, "other text of a repeated id " * 4)]


def shingle_list(text, n=5):
    w = WORD.findall(text or "")
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def shingles(text):
    return set(shingle_list(text))


# ------------------------------------------------------------------ common
def test_memo_equals_whole_texts(texts):
    tokens = common.TokenBytes(queries.TOKENIZER, limit=50)
    odd = ["<|endoftext|> x", "a b\x1cc d", "it's  we'll\t\tI'M", "ΑΣ ΣΑ Σ", "é ́x", "x" * 1000, "", " ", "漢字漢字 12345", "Straße, ÉÈÀ. İI ıi Ǆ ǅ ǆ ŉx ÿŸ Ω! 3d; d3, ªº µm x.y. ..., 'S'", "İstanbul ﬁne Ĳ ŀ ſ ɐ", "naïve;: L·L don't."]
    for text in [*texts.values(), *odd]:
        assert tokens.encode(text) == tokens.whole(text)


def test_word_hashes_tell_words_apart(texts):
    some = list(texts.values())[:50] + [None, "", "  ", "ab ba", "x"]
    hashes, counts = common.word_hashes(some)
    words = [w for t in some for w in WORD.findall(t or "")]
    assert list(counts) == [len(WORD.findall(t or "")) for t in some]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(700, 740)]
    up = {}
    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------ 1 sharding
def test_shards_fit_and_only_large_ones_split(spark, docs):
    limit = 20_000
    rows = sharding.sharded(docs, limit=limit).collect()
    assert len(rows) == docs.count()
    held = collections.defaultdict(list)
    for r in rows:
        held[r.shard_depth, r.shard].append(len((r.text or "").encode()))
        assert r.shard_bytes <= limit or r.shard_rows == 1
    assert all(sum(v) == next(r.shard_bytes for r in rows if (r.shard_depth, r.shard) == k) for k, v in held.items())
    total = collections.Counter()
    for (d, p), v in held.items():
        for up in range(d):
            total[up, p >> (d - up)] += sum(v)
    assert all(total[d - 1, p >> 1] > limit for d, p in held if d)


def test_shards_split_a_hot_key_and_odd_rows(spark):
    hot = frame(spark, [(9, "x" * 100)] * 200 + ODD)
    rows = sharding.sharded(hot, limit=1000).collect()
    assert len(rows) == 200 + len(ODD) and rows[0].kept == "k"
    assert all(r.shard_bytes <= 1000 or r.shard_rows == 1 for r in rows)
    assert sharding.sharded(hot.where("false"), limit=1000).count() == 0


def test_large_directory_path_agrees(spark, docs):
    rows = docs.select("doc_id", sharding.hash_of(F.col("doc_id"), F.lit(0)).alias("hash"), F.octet_length("text").cast("bigint").alias("bytes"))
    shards = common.staged(sharding.directory(rows.select("hash", "bytes"), 30_000), "t")
    a = {r.doc_id: r.at for r in sharding.assigned(rows, shards).collect()}
    b = {r.doc_id: r.at for r in sharding.assigned(rows, shards, max_broadcast_shards=0).collect()}
    assert a == b and len(a) == rows.count()


# ------------------------------------------------------------------ 2 token output
def token_digest(rows):
    tokens = common.TokenBytes(queries.TOKENIZER)
    at, out = 0, []
    for doc_id, text in rows:
        ids = tokens.whole(text or "") + np.uint32(2).tobytes()
        out.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_token_files_round_trip(spark, docs, texts):
    path = common.shared_path(spark, "t")
    token_output.write(docs, path, queries.TOKENIZER)
    assert sorted(map(tuple, token_output.digest(spark, path).collect())) == token_digest(sorted(texts.items()))
    one = token_output.read(spark, path).where("doc_id = 17")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()


def orc_of(spark, path):
    """(stripes, those with a Bloom filter and a row index of doc_id) of all files, from their footers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    stripes = held = 0
    for f in folder.getFileSystem(conf).listStatus(folder):
        if f.getPath().getName().endswith(".orc"):
            reader = jvm.org.apache.orc.OrcFile.createReader(f.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
            column = list(reader.getSchema().getFieldNames()).index("doc_id") + 1
            rows = reader.rows()
            for stripe in reader.getStripes():
                kinds = {x.getKind().toString() for x in rows.readStripeFooter(stripe).getStreamsList() if x.getColumn() == column}
                stripes += 1
                held += {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
            rows.close()
    return stripes, held


def test_token_files_have_stripes_and_filters(spark, docs):
    path = common.shared_path(spark, "t")
    many = docs.select((F.col("doc_id") * 400).alias("doc_id"), "text").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(59)))).select((F.col("doc_id") + F.col("n")).alias("doc_id"), F.col("text")).coalesce(1)
    token_output.write(many, path, queries.TOKENIZER, stripe_bytes=1 << 18, index_stride=1000)
    stripes, held = orc_of(spark, path)
    assert stripes == held and stripes > 2
    assert token_output.read(spark, path).where("doc_id = 6800").count() == 1


def test_token_files_of_a_hot_id(spark):
    path = common.shared_path(spark, "t")
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_output.write(rows, path, queries.TOKENIZER)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[0] for r in token_output.read(spark, path).groupBy("part").count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 1000 and sum(sizes) == 4000


def test_token_files_of_odd_rows(spark):
    path = common.shared_path(spark, "t")
    token_output.write(frame(spark, ODD), path, queries.TOKENIZER)
    got = token_output.digest(spark, path).collect()
    assert len(got) == len(ODD) and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    path = common.shared_path(spark, "t")
    token_output.write(frame(spark, ODD).where("false"), path, queries.TOKENIZER)
    assert token_output.digest(spark, path).count() == 0


# ------------------------------------------------------------------ 3 near duplicates
def brute_classes(texts, threshold=0.8):
    sets = {i: collections.Counter(shingle_list(t)) for i, t in texts.items()}
    up = {i: i for i in texts}

    keys, repeats = {i: set(s) for i, s in sets.items()}, {i for i, s in sets.items() if s.total() > len(s)}

    def near(i, j):
        a, b = keys[i], keys[j]
        if not a or not b:
            return False
        if len(a & b) >= threshold * len(a | b) - 1e-12:
            return True
        return bool({i, j} & repeats) and not a.isdisjoint(b) and (sets[i] & sets[j]).total() >= threshold * (sets[i] | sets[j]).total() - 1e-12

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (texts[a] or "") == (texts[b] or "") or near(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_copies(seed=5, n=90):
    """A base text and copies with more and more edits, besides unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = word()
        out[i] = " ".join(w)
    out |= {n + i: " ".join(word() for _ in range(60)) for i in range(20)}
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_classes_equal_brute_force(spark, docs, texts, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", block)
    rows = {**{i + 1000: t for i, t in texts.items()}, **near_copies()}
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_classes_of_odd_rows(spark):
    got = sorted(map(tuple, minhash_dedup.classes(frame(spark, ODD)).collect()), key=str)
    assert len(got) == len(ODD)
    by = dict((r[0], r[1]) for r in got)
    assert by[1] == by[2] == 1 and by[3] == 3 and by[4] == by[5] == 4 and by[None] is None
    kept = minhash_dedup.deduplicated(frame(spark, ODD))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 6, 7, 7] and kept.columns == frame(spark, ODD).columns
    assert minhash_dedup.classes(frame(spark, ODD).where("false")).count() == 0


def test_classes_of_a_repeated_id(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(100)) for k in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (9, b + " more"), (3, a), (3, a)], "doc_id bigint, text string")
    assert {(r.doc_id, r.class_id) for r in minhash_dedup.classes(df).collect()} == {(5, 3), (5, 5), (9, 5), (3, 3)}
    assert sorted((r.doc_id, r.text) for r in minhash_dedup.deduplicated(df).collect()) == [(3, a), (5, b)]


@pytest.mark.parametrize("block", [512, 8])
def test_a_large_group_of_near_copies_and_repeats(spark, monkeypatch, block):
    """Copies of one text with edits, chains of copies of copies, and texts whose repeats differ in number."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", block)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, base = {}, [word() for _ in range(120)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = word()
        rows[i] = " ".join(w)
    w = [word() for _ in range(120)]
    for i in range(200, 260):
        w[rng.randrange(len(w))] = word()
        rows[i] = " ".join(w)
    line = " ".join(word() for _ in range(12))
    for i in range(300, 340):
        rows[i] = "\n".join([" ".join(word() for _ in range(rng.randrange(4, 30))), *[line] * rng.randrange(2, 12)])
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.r_[a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)]
    sig = minhash_dedup.dart_signatures(np.r_[a, b], None, np.array([300, 300]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 200 / 400) < 0.05
    wa, wb = rng.uniform(0.2, 5, 300), rng.uniform(0.2, 5, 300)
    sig = minhash_dedup.dart_signatures(np.r_[a, a], np.r_[wa, wb], np.array([300, 300]), 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.05


def test_weighted_signatures_from_plain_ones():
    rng = np.random.default_rng(2)
    counts = np.array([1, 3, 40, 500, 2])
    elements = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
    weights = rng.integers(1, 4, counts.sum()).astype(float)
    weights[[0, 2, 50]] = 5000, 1, 900
    plain, ranks = minhash_dedup.ranked_signatures(elements, None, counts, 200)
    assert (minhash_dedup.weighted_from_plain(plain, ranks, elements, weights, counts, 200) == minhash_dedup.dart_signatures(elements, weights, counts, 200)).all()


# ------------------------------------------------------------------ 4 html
def test_html_of_the_test_pages(spark):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_html_parts_and_broken_markup():
    page = '<body><header>Top</header><div class="cookie-notice">We use</div><main><h1>T &amp; x</h1><p>a<p>b <a href=x>li\nnk</a> c<div class="comments"><p>hi</p></div><ul><li>one<li>two</ul><form>f</form><span hidden>no</span>tail</main><aside>s</aside>'
    assert html_extract.main_text(page, frozenset()) == "T & x\na\nb li nk c\none\ntwo\ntail"
    assert html_extract.main_text('plain <p>x<script>if(a<b){"</p>"}</script> y <!-- c > --> z', frozenset()) == "plain\nx\ny z"
    assert html_extract.main_text(None, frozenset()) == html_extract.main_text("<", frozenset())[1:] == ""


def test_html_anchors_of_an_article_are_text():
    page = '<body><main><h2 id="notice-periods">Notice</h2><section id="related-work"><p id="search-algorithms">a</p><span id="social-impact">b</span></section><div class="related-posts">no</div><p class="share">no</p></main>'
    assert html_extract.main_text(page, frozenset()) == "Notice\na\nb"
    assert html_extract.main_text('<body><div><h2 id="social-impact">x</h2><p>y</p></div><div id="social-links">no</div>', frozenset()) == "x\ny"


def test_html_open_head_ends():
    for page in ("<html><head><title>t</title><meta a=b><body><p>text</p></body></html>", "<head><style>x</style><p>text", "<head><link rel=x>text<br>", "<head><title>t</title></head><body>text"):
        assert html_extract.main_text(page, frozenset()) == "text"


def test_long_labels_stay_apart():
    a, b = (html_extract.is_aside("div", f' class="{"x y " * 30}{end}"', False)[1] for end in "ab")
    assert a != b and len(a) < 110


def test_style_tree_removes_branches_that_repeat_on_a_host(spark):
    rng = random.Random(2)
    page = lambda i: (i, f"http://h.org/{i}", f"<body><div><b>Our site since 1990</b></div><section><p>{rng.random()} text {i}</p></section></body>")
    rows = [page(i) for i in range(40)] + [(100 + i, "http://m.org/", "<body><section><p>mirrored</p></section></body>") for i in range(40)] + [(200, None, None), (200, None, None), (201, "x", "")]
    rows += [(300 + i, "http://same.org/", f"<body><nav>{i}</nav><article><h1>Same</h1><p>everywhere</p></article></body>") for i in range(40)]
    rows += [(400 + i, "http://part.org/", f"<body><article><div class='x'><p>Read more of us</p></div><p>own {i} text</p></article></body>") for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, host int")
    got = {r.page_id: r.text for r in html_extract.extracted(df).collect()}
    assert got[3].endswith("text 3") and "1990" not in got[3] and got[100] == "mirrored" and got[200] == got[201] == ""
    assert got[305] == "Same\neverywhere" and got[405] == "own 5 text"
    assert html_extract.extracted(df).count() == len(rows) and html_extract.extracted(df.where("false")).count() == 0


def brute_tree(pages, own_weight=0.3):
    """(host, path) -> (m, content, shape, mass, composite) by plain counting; pages are (host, html)."""
    texts, shows = collections.defaultdict(lambda: collections.defaultdict(dict)), collections.defaultdict(dict)
    for host, page in set(pages):
        blocks, shown = html_extract.parse(page, False)
        for b in blocks:
            texts[host, b.path][b.text][page] = (len(b.text), b.links)
        for path, labels in shown.items():
            shows[host, path][page] = tuple(labels)
    out, branches = {}, collections.defaultdict(list)
    for (host, path), own in texts.items():
        m = len({page for held in own.values() for page in held})
        if m > 1 and "/" in path:
            whole = sum(c for held in own.values() for c, _ in held.values())
            novel = sum((c - k) * (1 - math.log(len(held)) / math.log(m)) for held in own.values() for c, k in held.values())
            parts = path.split("/")
            for i in range(2, len(parts) + 1):
                branches[host, "/".join(parts[:i])].append((m, whole, novel))
    for key, below in branches.items():
        m, content, shape = max(x[0] for x in below), sum(x[2] for x in below) / sum(x[1] for x in below), None
        held = shows.get(key, {})
        if len(held) > 1:
            m = max(m, len(held))
            shape = -sum(n / len(held) * math.log(n / len(held), len(held)) for n in collections.Counter(held.values()).values())
        out[key] = m, content, shape, sum(x[2] for x in below) / m, content if shape is None else own_weight * shape + (1 - own_weight) * content
    return out


def test_tree_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select(html_extract.host_of().alias("host"), "html")
    pages = pages.unionByName(pages.limit(20)).unionByName(spark.createDataFrame([("h", "<div>a<p>b</div>"), ("h", "<div>a<p>c<a href=x>li nk</a></div>"), ("h", "<div>a</div>text"), ("h", None)], "host string, html string"))
    got = {(r.host, r.path): (r.m, r.content, r.shape, r.mass, r.composite) for r in html_extract.importance(html_extract.observed(pages, False)).collect()}
    want = brute_tree([tuple(r) for r in pages.collect()])
    assert got.keys() == want.keys() and ("h", "/div/p") in got
    for key, row in want.items():
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(got[key], row)), (key, got[key], row)


def div_pages(rng, n):
    """Pages of plain divs without a telling name, with their main texts."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    said = lambda k: " ".join(word() for _ in range(k))
    for i in range(n):
        paragraphs = [said(rng.randrange(10, 60)) for _ in range(rng.randrange(2, 9))]
        title, menu = said(5), "".join(f"<div><a href=/{k}>{said(1)}</a></div>" for k in range(rng.randrange(4, 7)))
        body = "".join(f"<div>{p}</div>" for p in paragraphs)
        yield f"<body><div class=xa>{menu}</div><div class=xb>{said(4)}</div><div class=xc><h1>{title}</h1>{body}</div><div class=xd>&copy; us, {said(3)}</div></body>", "\n".join([title, *paragraphs])


def test_style_tree_alone_tells_menus_adverts_and_footers(spark):
    rows = [(i, f"http://d{i % 3}.org/{i}", *x) for i, x in enumerate(div_pages(random.Random(6), 60))]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string"), by_name=False).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_short_slots_of_an_article_stay(spark):
    """A lead or byline of a marked article, and short paragraphs anywhere, aren't taken for adverts."""
    rng = random.Random(12)
    said = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    rows, want = [], {}
    for i in range(30):
        title, by, lead, text, slot = said(4), said(2), said(6), said(200), said(3)
        rows.append((i, f"http://a.org/{i}", f"<body><div class=top>{slot}</div><article><h1>{title}</h1><div class=by>{by}</div><p class=lead>{lead}</p><div class=body>{text}</div></article></body>"))
        rows.append((100 + i, f"http://b.org/{i}", f"<body><div class=top>{slot}</div><div class=post><h1>{title}</h1><p>{lead}</p><div class=body>{text}</div></div></body>"))
        want[i], want[100 + i] = f"{title}\n{by}\n{lead}\n{text}", f"{title}\n{lead}\n{text}"
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_style_tree_alone_on_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extracted(pages, by_name=False).collect()}
    assert got == {r.page_id: r.text for r in html_extract.extracted(pages).collect()}


def test_the_tree_decides_in_the_query(spark):
    """On hosts of several pages, what the query leaves out it leaves out by the tree: without it, most pages keep more."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in queries.op4_html_extraction(spark, "/root/testdata/sf0.1").collect()}
    named = {r.page_id: r.text for r in html_extract.extracted(pages, by_name=True).collect()}
    assert got == named
    rows = pages.where("page_id % 10 = 0").collect()
    assert sum(html_extract.main_text(r.html, frozenset(), False) != got[r.page_id] for r in rows) > 0.9 * len(rows)


def test_names_count_on_small_hosts_only(spark):
    rng = random.Random(3)
    said = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    rows, want = [], {}
    for i in range(20):
        title, quote, text = said(4), said(30), said(120)
        host = "big" if i < 16 else "small"
        # A quotation in an element named as asides are: text where the tree finds it novel, dropped where only names tell.
        rows.append((i, f"http://{host}.org/{i}", f"<body><nav><a href=/>Home</a> <a href=/b>News</a></nav><article><h1>{title}</h1><p>{text}</p><aside>{quote}</aside></article><footer>Imprint</footer></body>"))
        want[i] = f"{title}\n{text}\n{quote}" if i < 16 else f"{title}\n{text}"
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_html_of_a_very_long_page():
    assert len(html_extract.main_text("<p>word &amp; word</p>" * 200_000 + "<p>" + "long " * 2_000_000, frozenset())) == 200_000 * 12 + 5 * 2_000_000 - 1


# ------------------------------------------------------------------ 5 quality rules
def brute_measures(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(spark, texts):
    rows = [*texts.items(), *ODD, (50, "a b c d e a b c d e"), (51, "a a a a a a a"), (52, "x y\nx y\nx y"), (53, "a b c d e f a b c d e")]
    got = quality_rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        n = brute_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    clean = quality_rules.clean(frame(spark, rows))
    assert clean.columns == frame(spark, rows).columns and sorted(clean.select("doc_id").toPandas().doc_id) == sorted(r.doc_id for r in got if r.kept)
    assert quality_rules.judge(frame(spark, rows).where("false")).count() == 0


def test_quality_lines(spark):
    good = "A plain sentence stands here, with words enough to be read by all of us."
    rows = [(1, good), (2, "Home | About | News | Contact | Help | Login | More | Jobs | Press | Terms"), (3, "th*** is%%% junk### with$$$ symbols&&& all### over*** it### and%%% more***"), (4, good + "\nHome | About | Help"), (5, ("word" * 3 + " ") * 8 + " ".join(f"w{i}" for i in range(80)))]
    assert {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, rows, False)).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_quality_clean_removes_fallen_lines(spark):
    good = "A plain sentence stands here, with words enough to be read by all of us."
    more = "\n".join(f"Line {i} has words{i} of{i} its{i} own{i}, and{i} it{i} stays{i} here{i} as{i} well{i}." for i in range(20))
    rows = [(1, f"{good}\nHome | About | Help\n\nAnother one follows, it has its own words, and it stays.\n{good}\nth*** is%%% junk###\n{more}")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id bigint, text string, n_chars int, kept string")
    want = f"{good}\nAnother one follows, it has its own words, and it stays.\n{more}"
    got = quality_rules.clean(df)
    assert [tuple(r) for r in got.collect()] == [(1, want, len(want), "k")] and got.dtypes == df.dtypes


def brute_lines(t):
    """The lines that stand, by the rules written out in Python."""
    lines = list(dict.fromkeys(x for x in (t or "").split("\n") if WORD.search(x)))
    count = lambda x: len(WORD.findall(x))
    ends, marks, unmarked = ".!?…。！？｡．؟۔।॥։።፧။៕᙮᠃᠉", ".!?…。！？｡．؟۔।॥։።፧။៕᙮᠃᠉;:,、，；：؛،፣፤፥;", re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff]")
    paused = [bool(re.search(rf"[{marks}][\"'”’»)\]」』】）〉》]*[\x20\x09-\x0D]*\Z", x)) for x in lines]
    entry = [not p and count(x) <= 3 and not unmarked.search(x) for p, x in zip(paused, lines)]
    verse = [p and len(x) <= 60 for p, x in zip(paused, lines)]
    out = []
    for i, x in enumerate(lines):
        menu = any(a >= 0 and a + 3 <= len(lines) and all(entry[a : a + 3]) for a in (i - 2, i - 1, i)) and not any(verse[max(0, i - 3) : i] + verse[i + 1 : i + 4])
        symbols, dividers = len(re.findall(r"[#*$%&|<>]", x)), len(re.findall("[|»›·•]", x))
        open_ = (len(x) >= 240 and not re.search(f"[{marks}]", x) or count(x) >= 10 and not re.search(f"[{ends}]", x)) and not unmarked.search(x)
        if not (menu or symbols > len(x) * 0.1 or dividers * 20 > len(x) or open_ or len(x) <= 120 and re.search(quality_rules.BOILERPLATE, x)):
            out.append(x)
    return out


def brute_clean(t):
    """The cleaned text, or None where the document is rejected."""
    n = brute_measures(t)
    whole, good = sum(len(x) for x in (t or "").split("\n") if WORD.search(x)), brute_lines(t)
    return None if n[0] < 10 or 100 * n[4] > 20 * n[0] or whole - sum(map(len, good)) > 0.5 * whole else "\n".join(good)


def test_quality_clean_equals_brute_force(spark, texts):
    prose, more, last = (" ".join(f"{k}{w}" for w in "plain sentence stands here with words enough to be read by all of us, whoever we are".split()) + "." for k in "abc")
    made = {
        901: f"Home\nAbout us\nContact\n{prose}\nIntroduction\n{more}\nA B\nC D\n{last}",
        902: f"{prose}\nRead More about it here!\nwe said that we never read more of it, ever, though this line is long enough to stand beside them all as it is, being no part of any menu.\n© X. All rights reserved.",
        903: f"{prose}\none two three four five six seven eight nine ten\none two three four five six seven eight nine\n{more}",
        904: "Home\nHome\nAbout\nAbout\nNews,\nMore\nLess\n" + prose,
        905: "Home\nAbout\nNews\n" * 40 + prose,
        906: None,
        907: prose + "\n" + "x " * 100_000,
    }
    rows = {**texts, **made}
    got = {r.doc_id: r.text for r in quality_rules.clean(frame(spark, rows.items())).collect()}
    want = {i: brute_clean(t) for i, t in rows.items()}
    assert got == {i: t for i, t in want.items() if t is not None}
    assert got[901] == f"{prose}\nIntroduction\n{more}\nA B\nC D\n{last}" and 907 not in got


#: Sound texts of scripts with marks of their own, or without, and verse of short lines.
SOUND = {
    "urdu": "یہ ایک سادہ اور صاف جملہ ہے جو کسی بھی صفحے پر آ سکتا ہے۔ دوسرا جملہ پہلے کے بعد آتا ہے اور کچھ نیا بتاتا ہے۔\nکیا یہ تیسرا جملہ بھی پڑھنے کے لائق ہے یا اسے چھوڑ دینا چاہیے؟",
    "hindi": "यह एक सीधा और साफ वाक्य है जो किसी भी पन्ने पर आ सकता है। दूसरा वाक्य पहले के बाद आता है और कुछ नया बताता है।\nक्या यह तीसरा वाक्य भी पढ़ने लायक है या इसे छोड़ देना चाहिए।",
    "chinese": "这是 一个 简单 的 句子 ，它 可以 出现 在 任何 一页 上 ！\n第二 个 句子 跟 在 后面 ，说 了 一些 新 的 事情 ？\n我们 今天 去 了 公园 ，看 见 了 很 多 花 ！",
    "thai": "\n".join(" ".join(f"ประโยค{i}ที่{j}อ่านได้" for j in range(14)) for i in range(6)),
    "khmer": "\n".join(" ".join(f"ប្រយោគ{i}ទី{j}" for j in range(12)) for i in range(4)),
    "armenian": "Սա մի պարզ նախադասություն է, որը կարող է լինել ցանկացած էջում։\nԵրկրորդ նախադասությունը գալիս է առաջինից հետո և նոր բան է ասում։",
    "amharic": "ይህ ቀላል ዓረፍተ ነገር ነው እና በማንኛውም ገጽ ላይ ሊገኝ ይችላል።\nሁለተኛው ዓረፍተ ነገር ከመጀመሪያው በኋላ ይመጣል እና አዲስ ነገር ይናገራል።",
    "verse": "The river sings\nits silver song,\nthe night is\ndark and long.\nA lantern sways\nabove the door,\nthe tide comes\nback to shore.",
}


def test_sound_texts_of_all_scripts_stand(spark):
    rows = list(enumerate(SOUND.values()))
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert got == {i: (True, t) for i, t in rows}
    assert {i: brute_clean(t) for i, t in rows} == dict(rows)


# ------------------------------------------------------------------ 6 repeated passages
def passage_rows(seed=11):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    plain = lambda n: [word() for _ in range(n)]
    shared = plain(80)
    edited = list(shared)
    for i in (20, 41, 60):
        edited[i] = word()
    del edited[50]
    rows = [(i, plain(100 + 7 * i)) for i in range(30)]
    for i in (3, 9, 17, 25):
        rows[i][1][40:40] = shared
    rows[28][1][10:10] = edited
    rows[5][1][5:5] = shared[:30]  # too short
    return [(i, " ".join(w)) for i, w in rows]


def test_passages(spark):
    rows = passage_rows()
    got = {r.doc_id: r for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {9, 17, 25, 28}
    for i in (9, 17, 25):
        assert (got[i].start_word, got[i].n_words, got[i].source_id, got[i].source_start, got[i].n_equal) == (40, 80, 3, 40, 80)
    assert (got[28].source_id, got[28].n_equal) == (3, 76) and got[28].n_words == 79
    clean = {r.doc_id: r.text for r in substring_dedup.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    assert len(clean) == 30 and all(clean[i] == texts[i] for i in texts if i not in got)
    assert clean[9].split() == texts[9].split()[:40] + texts[9].split()[120:]


def test_passages_cover_exact_repeats(spark, docs, texts):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first, covered = {}, collections.defaultdict(set)
    for i in sorted(words):
        for a in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][a : a + 50]), i)
    for r in substring_dedup.passages(docs).collect():
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
        if r.n_equal == r.n_words == r.source_words:
            assert words[r.doc_id][r.start_word : r.start_word + r.n_words] == words[r.source_id][r.source_start : r.source_start + r.source_words]
    for i, w in words.items():
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < i:
                assert covered[i].issuperset(range(a, a + 50)), (i, a)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_random_splits(spark, seed):
    """Documents are made of overlapping parts of a few sequences, so a passage's seeds come from many earlier documents."""
    rng = random.Random(seed)
    plain = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    long = [plain(200) for _ in range(3)]
    rows = []
    for i in range(90):
        words = plain(rng.randrange(0, 20))
        for _ in range(rng.randrange(1, 4)):
            s, n = rng.choice(long), rng.choice([20, 35, 40, 49, 50, 60, 120])
            a = rng.randrange(0, 200 - n)
            words += s[a : a + n] + plain(rng.randrange(0, 15))
        rows.append((i, words))
    rows += [(200 + k, plain(9) + long[0][40 + 15 * k : 80 + 15 * k] + plain(9)) for k in range(6)] + [(300 + k, plain(30) + long[0][40:160] + plain(30)) for k in range(2)]
    first, covered = {}, collections.defaultdict(set)
    for i, w in rows:
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    for r in substring_dedup.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect():
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
        assert r.source_id < r.doc_id and r.n_words >= 50
    for i, w in rows:
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < i:
                assert covered[i].issuperset(range(a, a + 50)), (i, a)


def test_six_parts_of_a_passage_come_before_it(spark):
    """Two documents share 120 words, of which six earlier documents hold overlapping parts of 40."""
    rng = random.Random(3)
    plain = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    p = plain(120)
    rows = [(k, plain(20) + p[16 * k : 16 * k + 40] + plain(20)) for k in range(6)] + [(10, plain(15) + p + plain(15)), (11, plain(25) + p + plain(5))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    assert [(r.doc_id, r.start_word, r.n_words, r.source_id) for r in substring_dedup.passages(df).collect()] == [(11, 25, 120, 10)]
    assert {r.doc_id: len(r.text.split()) for r in substring_dedup.clean(df).collect()} == {**{k: 80 for k in range(6)}, 10: 150, 11: 30}


def test_passages_whose_seeds_were_first_seen_in_several_documents(spark):
    """Y repeats X, which has 45 words of A1 and 45 of A2: neither has 50 words of Y."""
    rng = random.Random(23)
    plain = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows = []
    for k in range(0, 80, 4):
        a, b = plain(45), plain(45)
        rows += [(k, plain(30) + a + plain(30)), (k + 1, plain(20) + b + plain(20)), (k + 2, plain(15) + a + b + plain(25)), (k + 3, plain(60) + a + b + plain(10))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.start_word, r.n_words, r.source_id, r.source_start, r.n_equal) for r in substring_dedup.passages(df).collect())
    assert got == [(k + 3, 60, 90, k + 2, 15, 90) for k in range(0, 80, 4)]
    assert {r.doc_id: len(r.text.split()) for r in substring_dedup.clean(df).collect()} == {i: len(w) - (90 if i % 4 == 3 else 0) for i, w in rows}


def test_runs_of_periodic_texts_are_a_row_for_each_document(spark):
    """Texts of two or three words that alternate have as few runs, however long they are, and each run keeps all its places."""
    texts = {i: (["a", "b"] * 500)[: 300 + i] if i % 3 else [f"w{i}"] + ["x", "y", "z"] * 90 for i in range(24)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    every = substring_dedup.seeds(df).select("hash").distinct().agg(F.collect_list("hash").alias("hashes"))
    asked = df.crossJoin(every).withColumn("spans", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    got = substring_dedup.runs(asked, 50, substring_dedup.W, whole=True).collect()
    assert len(got) == len({(r.doc_id, r.hash) for r in got}) <= 24 * 4
    text_of, places = {}, collections.defaultdict(list)
    for r in got:
        assert {tuple(texts[r.doc_id][p : p + 50]) for p in r.places} == {text_of.setdefault(r.hash, tuple(texts[r.doc_id][r.places[0] :][:50]))}
        places[r.doc_id] += r.places
    assert all(sorted(places[i]) == list(range(len(x) - 49)) for i, x in texts.items())
    firsts = substring_dedup.runs(asked, 50, substring_dedup.W, whole=False).collect()
    assert {(r.doc_id, r.hash): r.places[0] for r in got}.items() <= {(r.doc_id, r.hash): r.places[0] for r in firsts}.items() and all(len(r.places) == 1 for r in firsts)
    covered = collections.defaultdict(set)
    for r in substring_dedup.passages(df).collect():
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert all(len(covered[i]) == (0 if i < 2 else len(x) - (i % 3 == 0)) for i, x in texts.items())


def test_passages_of_odd_rows(spark):
    odd = frame(spark, [*ODD, (-5, "w " * 200), (2**62, "negative and huge ids " * 40), (2**62 + 1, "negative and huge ids " * 40)])
    assert all(r.doc_id is not None for r in substring_dedup.passages(odd).collect())
    got = substring_dedup.clean(odd)
    assert got.columns == odd.columns and got.where("doc_id is null").count() == 1
    assert substring_dedup.clean(odd.where("false")).count() == 0


def test_passages_of_repeated_ids(spark):
    """Places are those of the row's own text, and each row is cut by its own passages."""
    rng = random.Random(53)
    plain = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    p, q, r = plain(70), plain(60), plain(80)
    rows = [(1, plain(10) + p), (2, plain(20) + q + plain(5)), (7, plain(33) + p + plain(3)), (7, q + plain(44)), (7, q + plain(2) + r), (7, r + plain(9)), (9, plain(4) + r), (7, plain(70)), (9, plain(4) + r)]
    rows[8] = rows[6]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = sorted((x.doc_id, x.start_word, x.n_words, x.source_id, x.n_equal) for x in substring_dedup.passages(df).collect())
    assert got == [(7, 0, 60, 2, 60), (7, 0, 60, 2, 60), (7, 33, 70, 1, 70), (9, 4, 80, 7, 80)]
    clean = sorted((x.doc_id, len(x.text.split())) for x in substring_dedup.clean(df).collect())
    assert clean == sorted([(1, 80), (2, 85), (7, 36), (7, 44), (7, 82), (7, 89), (9, 4), (7, 70), (9, 4)])


def test_chain_and_common_words_against_plain_dynamic_programming():
    rng = random.Random(4)
    for _ in range(30):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert substring_dedup.common_words(a, b) == t[-1][-1]
    tree, values = substring_dedup.Fenwick(50), []
    for _ in range(200):
        i, v = rng.randrange(1, 51), rng.random()
        tree.put(i, (v, i))
        values.append((i, v))
        q = rng.randrange(0, 51)
        assert tree.top(q)[0] == max([v for i, v in values if i <= q], default=-float("inf"))


def plain_chains(frags):
    """Chains of (d0, s0, n), ascending, by looking at all predecessors."""
    gap, cost = substring_dedup.MAX_GAP, substring_dedup.GAP_COST
    score, back = [], []
    for i, (d, s, n) in enumerate(frags):
        best = max(((score[j] - cost * (d - a - m + s - b - m), j) for j, (a, b, m) in enumerate(frags[:i]) if a < d and b < s and d - a - m <= gap and s - b - m <= gap), default=(0, -1))
        back.append(best[1] if best[0] > 0 else -1)
        score.append(n + max(best[0], 0))
    used, out = set(), []
    for i in sorted(range(len(frags)), key=lambda x: -score[x]):
        if i not in used:
            a = i
            used.add(a)
            while back[a] >= 0 and back[a] not in used:
                a = back[a]
                used.add(a)
            out.append((frags[a][0], frags[i][0] + frags[i][2], frags[a][1], frags[i][1] + frags[i][2]))
    return sorted(x for x in out if x[1] - x[0] >= substring_dedup.LEAST_CHAIN)


def test_chains_equal_plain_ones_also_behind_a_far_better_match():
    k = substring_dedup.K
    rng = random.Random(8)
    for t in range(60):
        frags, d = [], 0
        for _ in range(rng.randrange(1, 40)):
            n = rng.choice([8, 12, 20, 30, 300 if t % 2 else 15])
            frags.append((d, rng.randrange(0, 800) if rng.random() < 0.3 else d + rng.randrange(-3, 4) * 40 + 200, n))
            d += n + rng.choice([1, 3, 30, 64, 65, 200])
        frags = [f for i, f in enumerate(frags) if not any(abs((f[0] - f[1]) - (g[0] - g[1])) < 1 for g in frags[:i])]
        at = np.array([(a + x, b + x) for a, b, n in frags for x in range(n - k + 1)])
        assert sorted(substring_dedup.chain(at[:, 0], at[:, 1])) == plain_chains(frags)


def test_a_passage_behind_a_longer_far_one(spark):
    rng = random.Random(31)
    plain = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    far, near = plain(300), plain(64)
    rows = [(1, far + plain(200) + near), (2, far + plain(200) + near[:32] + plain(1) + near[32:])]
    got = sorted((r.start_word, r.n_words, r.n_equal) for r in substring_dedup.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect())
    assert got == [(0, 300, 300), (500, 65, 64)]


def test_align_bridges_edits_near_the_ends():
    rng = random.Random(3)
    plain = lambda n: [rng.randrange(1 << 32) for _ in range(n)]
    p = plain(55)
    q = list(p)
    q[6], q[49] = plain(2)
    d, s = np.array(plain(64) + q + plain(64)), np.array(plain(64) + p + plain(64))
    assert substring_dedup.align(d, s, 64 + 10, 64 + 30, 64 + 10, 64 + 30) == (64, 119, 64, 119, 53)
    d = np.array(plain(64) + p[:8] + plain(1) + p[8:40] + p[41:] + plain(64))  # a word more, and one less
    assert substring_dedup.align(d, s, 64 + 15, 64 + 35, 64 + 14, 64 + 34) == (64, 119, 64, 119, 54)
    d = np.array(p + plain(3))
    assert substring_dedup.align(d, np.array(p), 0, 55, 0, 55) == (0, 55, 0, 55, 55)


def test_passages_with_edits_near_their_ends(spark):
    rng = random.Random(41)
    plain = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, caught = [], collections.defaultdict(set)
    kind = {}
    for i in range(0, 480, 2):
        kind[i + 1] = ("ends", 0.95, 0.9, 0.85)[i // 2 % 4]
        p = plain(55 if kind[i + 1] == "ends" else 100)
        q = list(p)
        for x in (6, 49) if kind[i + 1] == "ends" else rng.sample(range(100), round(100 * (1 - kind[i + 1]))):
            q[x] = plain(1)[0]
        rows += [(i, plain(40) + p + plain(40)), (i + 1, plain(40) + q + plain(40))]
    for r in substring_dedup.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect():
        assert r.n_equal >= 0.8 * max(r.n_words, r.source_words)
        caught[kind[r.doc_id]].add(r.doc_id)
    share = {k: len(v) / 60 for k, v in caught.items()}
    assert share["ends"] == share[0.95] == share[0.9] == 1 and share[0.85] > 0.95, share


@pytest.mark.parametrize("parts", [0, 40])
def test_edited_passages_whose_parts_came_earlier(spark, parts):
    """Documents before both copies hold parts of a passage, each too short to be told; the later copy, with edits, is found all the same."""
    rng = random.Random(parts)
    plain = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, later, at = [], [], 0
    for share in [0.98, 0.95, 0.9] * 20:
        p = plain(120)
        for a in range(0, 120, parts or 120) if parts else ():
            rows.append((at := at + 1, plain(20) + p[a : a + parts] + plain(20)))
        q = list(p)
        for x in rng.sample(range(120), round(120 * (1 - share))):
            q[x] = plain(1)[0]
        rows += [(1000 + at, plain(30) + p + plain(30)), (2000 + at, plain(30) + q + plain(30))]
        later.append((2000 + at, 1000 + at, share))
        at += 1
    got = substring_dedup.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect()
    found = {(r.doc_id, r.source_id) for r in got if r.n_words >= 80}  # edits may lie so close to an end that the rest is less alike
    assert all(r.n_equal >= 0.8 * max(r.n_words, r.source_words) for r in got)
    shares = {s: np.mean([(d, x) in found for d, x, y in later if y == s]) for s in (0.98, 0.95, 0.9)}
    assert min(shares.values()) >= 0.95, shares
    assert {d for d, _ in found} <= {d for d, _, _ in later}


def test_documents_next_before_equal_brute_force(spark):
    rng = random.Random(9)
    rows = list({(h, d): (h, d, rng.randrange(50)) for h, d in ((rng.choice([1, 1, 1, 2, 3, rng.randrange(9, 99)]), rng.randrange(400)) for _ in range(1500))}.values())
    by = collections.defaultdict(list)
    for h, d, p in sorted(rows):
        by[h].append((d, p))
    want = {(h, d, s, p) for h, x in by.items() for i, (d, _) in enumerate(x) for s, p in x[max(0, i - 4) : i]}
    for few in (rows, rows[:9]):
        for n in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [tuple(r) for r in substring_dedup.predecessors(spark.createDataFrame(few, "hash bigint, doc_id bigint, pos bigint")).collect()]
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            assert len(got) == len(set(got)) and (set(got) == want if few is rows else True)
    assert substring_dedup.predecessors(spark.createDataFrame([], "hash bigint, doc_id bigint, pos bigint")).count() == 0


# ------------------------------------------------------------------ 7 packing
def check_pieces(rows, pieces):
    tokens = common.TokenBytes(queries.TOKENIZER)
    ids = collections.defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(tokens.whole(text or "") + np.uint32(2).tobytes())
    got, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        got[p.doc_id].append((p.start, p.length, p.ids_crc32))
        sequences[p.sequence_id].append((p.offset, p.length))
    pad = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    for doc_id, texts in ids.items():
        if len(texts) == 1:
            at = 0
            for start, length, crc in sorted(got[doc_id]):
                assert start == at and crc == zlib.crc32(texts[0][4 * start : 4 * (start + length)])
                at += length
            assert at == len(texts[0]) // 4
    assert sum(p.length for p in pieces) == sum(len(x) // 4 for v in ids.values() for x in v)
    return pad


def test_packing(spark, docs, texts):
    pad = check_pieces(texts.items(), packing.packed(docs, queries.TOKENIZER).collect())
    assert pad <= 4096 * docs.rdd.getNumPartitions()
    check_pieces(ODD, packing.packed(frame(spark, ODD), queries.TOKENIZER).collect())
    check_pieces(texts.items(), packing.packed(docs, queries.TOKENIZER, block_tokens=5000).collect())
    assert packing.packed(docs.where("false"), queries.TOKENIZER).count() == 0


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 900) for _ in range(500)]
    cost = collections.Counter()
    for _, _, n, s, _ in packing.pack(lengths):
        cost[s] += n + n * n / 4096
    full = sorted(cost.values())[6:]
    assert full[-1] / full[0] < 1.2


# ------------------------------------------------------------------ 8 decontamination
def test_containment(spark, docs, texts):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    sets = {r.item_id: shingles(r.text) for r in items.collect()}
    long = " ".join(f"f{i}" for i in range(30_000))
    some = items.first()
    words = some.text.split()
    extra = {9001: long + " " + some.text, 9002: " ".join(words[: len(words) // 2]) + " gap " + long + " " + " ".join(words[len(words) // 2 :]), 9003: None, 9004: ""}
    rows = {**texts, **extra}
    want = sorted((i, k, len(s & v), len(v)) for i, t in rows.items() for s in [shingles(t)] for k, v in sets.items() if len(s & v) >= 0.8 * len(v))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows.items()], "doc_id bigint, text string, item_id int")
    assert sorted(map(tuple, decontaminate.contained(df, items).collect())) == want and any(w[0] == 9001 for w in want)
    assert sorted(map(tuple, decontaminate.contained(df, items, max_broadcast_shingles=300).collect())) == want
    joined = decontaminate.clean(df, items, max_broadcast_shingles=300)
    assert joined.columns == df.columns and {r.doc_id for r in joined.collect()} == set(rows) - {w[0] for w in want}
    clean = decontaminate.clean(df, items)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == set(rows) - {w[0] for w in want}


def test_short_items_are_never_missed(spark):
    items, docs, want = [], [], []
    for i in range(1200):
        n = (1, 3, 5, 6, 7, 9, 13)[i % 7]  # one to nine shingles
        item = [f"q{i}_{j}" for j in range(n)]
        items.append((i, " ".join(item)))
        size = (3, 20, 60, 200, 1000, 2050)[i % 6] if n >= 5 else 0  # an item under five words is one shingle: the whole text
        docs.append((i, " ".join([*(f"a{i}_{j}" for j in range(size)), *item, *(f"b{i}_{j}" for j in range(size // 3))])))
        want.append((i, i, max(1, n - 4), max(1, n - 4)))
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for bound in (1_000_000, 0):
        assert sorted(map(tuple, decontaminate.contained(docs, items, max_broadcast_shingles=bound).collect())) == want
        assert decontaminate.clean(docs, items, max_broadcast_shingles=bound).count() == 0


def test_containment_of_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "one"), (3, "one"), (3, "one"), (4, "one two three")], "item_id bigint, text string")
    for bound in (1_000_000, 0):
        got = sorted(map(tuple, decontaminate.contained(frame(spark, ODD), items, max_broadcast_shingles=bound).collect()))
        assert got == [(4, 3, 1, 1), (5, 3, 1, 1), (5, 3, 1, 1)]
        assert decontaminate.clean(frame(spark, ODD), items, max_broadcast_shingles=bound).count() == len(ODD) - 3
    assert decontaminate.contained(frame(spark, ODD), items.where("false")).count() == 0
    assert decontaminate.clean(frame(spark, ODD).where("false"), items).count() == 0


# ------------------------------------------------------------------ 9 chat formatting
def chat_digest(rows):
    turns = collections.defaultdict(list)
    for c, n, role, text in rows:
        turns[c].append((n, role or "", text or ""))
    out = {}
    for c, own in turns.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


CHAT = [
    *((1, i, ("system", "user", "assistant")[0 if i == 0 else 1 + (i + 1) % 2], f"turn {i} " + "words in it " * (i % 7)) for i in range(60)),
    (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"),
    (2, 0, "a:b\\### </turn>", "x\\"), (2, 1, "assistant", "\\"), (2, 2, "assistant", None), (2, 3, None, "### user: hi</turn>\n"),
    (3, 0, "user", "q"), (3, 1, "assistant", "long " * 5000), (3, 2, "user", "q"), (3, 3, "assistant", "é漢́"), (None, 0, "user", "no id"), (4, 0, "user", "t"), (4, 0, "user", "t"),
]


@pytest.mark.parametrize("budget,history", [(64, 24), (2048, 512), (1, 0)])
def test_chat_round_trip(spark, budget, history):
    df = spark.createDataFrame([(*r, "w") for r in CHAT], "conv_id bigint, turn bigint, role string, text string, window string").repartition(5)
    windows = common.staged(chat_format.formatted(df, queries.TOKENIZER, budget, history), "t")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(windows).collect()}
    assert got == chat_digest(CHAT)
    for r in windows.collect():
        assert r.n_tokens <= budget or (r.over_budget and r.n_new == 1)
        turns = chat_format.read_turns(r.text)
        assert len(turns) == r.n_context + r.n_new
        if r.conv_id == 1 and budget > 20:
            assert turns[0][0] == "system"
    assert chat_format.formatted(df.where("false"), queries.TOKENIZER).count() == 0


def test_chat_of_the_test_conversations(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(chat_format.formatted(rows, queries.TOKENIZER)).collect()}
    assert got == chat_digest([tuple(r) for r in rows.collect()])


def test_chat_turn_of_many_million_characters():
    """Writing and reading a turn of 20 million characters takes a small multiple of its size."""
    import tracemalloc

    text = ("word " * 40 + r"a < b \### c </turn> \\ ") * 90_000
    tracemalloc.start()
    turn, start, end = chat_format.format_turn("user", text)
    [(role, read)] = chat_format.read_turns(turn)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (role, read) == ("user", text) and chat_format.unescape(turn[start:end]) == text and len(text) > 20_000_000
    assert peak < 8 * len(text)


@pytest.mark.parametrize("role,text", [("a:\\", "\\"), ("", ""), (":", "</turn>"), ("\\:", "\\</turn>\n### x: "), ("###", "\\\\"), ("a", "x\\\n</turn>\n"), ("a: b", ": ")])
def test_chat_turns_of_controls(role, text):
    window = "".join(chat_format.format_turn(*x)[0] for x in ((role, text), (text, role)))
    assert chat_format.read_turns(window) == [(role, text), (text, role)]


# ------------------------------------------------------------------ 10 quality classifier
def test_classifier_ranks_held_out_texts(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_classifier.scored(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, r.quality) for r in rows if r.held_out and r.quality is not None]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x == 1 for b, y in held if y == 0]
    assert sum(pairs) / len(pairs) > 0.95


def test_classifier_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (99, 1), (6, None)], "doc_id bigint, quality int")
    got = quality_classifier.scored(frame(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_classifier.scored(frame(spark, ODD), labels.where("false")).collect()} == {0.5}


def brute_score(model, text):
    """A text's score from the plain definition: a feature at a time."""
    words, total, n = (text or "").split(), 0.0, 0
    for i, w in enumerate(words):
        rows, _ = quality_classifier.word_features([w])
        total, n = total + sum(float(model.numbers[r]) for r in rows), n + len(rows)
        if i and words[i - 1] == w:
            total, n = total + float(model.numbers[quality_classifier.REPEAT]), n + 1
    return 1 / (1 + math.exp(-(model.bias + (total / n if n else 0.0))))


def test_classifier_against_brute_force(spark):
    # The whole query: texts learned from whole, however many features they have, and scored.
    draw = np.random.default_rng(3)
    word = lambda: "".join(map(chr, draw.integers(97, 123, 6)))
    texts = [(i, " ".join(["fine" if i % 2 else "junk junk", *(word() for _ in range(6_000 if i in (6, 7) else 12))])) for i in range(60)]
    docs = spark.createDataFrame([*texts, (100, None), (101, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    learned = [(i, t) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    data = [quality_classifier.text_features(t) for _, t in learned]
    assert max(len(rows) for rows, _ in data) > 20_000
    y = np.array([i % 2 for i, _ in learned])
    shares = np.array([(y == q).sum() for q in y])
    weights = shares / shares
    model = quality_classifier.train(data, y, weights)
    got = {r.doc_id: r.score for r in quality_classifier.scored(docs, labels).collect()}
    assert len(got) == 62
    for i, t in [*texts, (100, None), (101, "")]:
        assert abs(got[i] - brute_score(model, t)) < 1e-6, i


def test_classifier_bounds_what_it_learns_from(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(i, ("good words here", "bad ### junk")[1 - i % 2]) for i in range(40)] + [(1, "x")] * 500, "doc_id bigint, text string")
    assert quality_classifier.scored(docs, labels).count() == 540
    assert quality_classifier.scored(docs.where("false"), labels).count() == 0


def test_folded_model_equals_embedding_mean():
    texts = ["a b c c", "abc déf abc", "", "x " * 50]
    data = [quality_classifier.text_features(t) for t in texts]
    model = quality_classifier.train(data, np.array([0, 1, 1, 0]), np.ones(4), epochs=3)
    for t, (rows, counts) in zip(texts, data):
        mean = model.numbers[rows] @ counts / counts.sum() if len(rows) else 0.0
        assert abs(model.score(t) - 1 / (1 + np.exp(-(mean + model.bias)))) < 1e-9


def test_hashes_and_minimizers_by_doubled_windows():
    """Window hashes and minimizers are those that going through the words one by one gives, equal hashes in a window included."""
    from auditloom.llm import common

    draw = np.random.default_rng(3)
    for n in (1, 6, 7, 12, 13, 50, 300):
        for most in (2, 4, 2**63):
            words = draw.integers(0, most, n).astype(np.uint64)
            for size in (1, 2, 7, 50, 64):
                one = [0] * max(1, n - size + 1)
                for i in range(len(one)):
                    for x in words[i : i + size]:
                        one[i] = (one[i] * int(common._BASE) + int(x)) % (1 << 64)
                assert np.array_equal(common.window_hashes(words, size), common.mix64(np.array(one, dtype=np.uint64)))
            for w in (1, 2, 5, 12, 40):
                wide = min(w, n)
                least = [min(words[i : i + wide]) for i in range(n - wide + 1)]
                assert substring_dedup.window_best(words, wide).tolist() == least
                at = sorted({i + int(np.argmin(words[i : i + wide])) for i in range(n - wide + 1)})
                assert substring_dedup.minimizers(words, w).tolist() == [p for j, p in enumerate(at) if not (j and words[at[j - 1]] == words[p] and p - at[j - 1] <= wide)]
