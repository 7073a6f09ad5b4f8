"""Global order, link graph by key, addresses as numbers, network prefixes and the trigram index, against plain ways."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text
from auditloom.operators import crawl, crosspage, guard, networks, ranking, reports
from auditloom.operators.audit import audited
from auditloom.operators.linkgraph import LinkGraph
from auditloom.operators.search_index import TextIndex
from auditloom.sources import crawl_view
from tests.conftest import SMALL
from tests.test_audit import links
from tests.test_functions import page, responses


@pytest.fixture(scope="module")
def pages(spark):
    return crawl.written(crosspage.checked(crawl.written(audited(crawl_view.read(spark, SMALL)), "pages")), "checked")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ order
def test_places_in_a_global_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "é", "E", "e", "Zebra", "10", "9", " 9", "-1.5", "ähre", "Ahre", "ahre b"])) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, v string")
    want = [r.page_id for r in reports.sorted_by(df, "v").collect()]
    got = ranking.ranked(df, [*ranking.column_keys("v"), F.col("page_id").asc()], partitions=7)
    assert [r.page_id for r in got.orderBy("place").collect()] == want and [r.place for r in got.orderBy("place").collect()] == list(range(1, 401))
    down = ranking.ranked(df, [*ranking.column_keys("v", False), F.col("page_id").asc()], partitions=3)
    assert [r.page_id for r in down.orderBy("place").collect()] == [r.page_id for r in reports.sorted_by(df, "v", False).collect()]
    assert ranking.ranked(df.limit(0), [F.col("page_id").asc()]).count() == 0


def test_text_order_knows_neither_case_nor_accents(spark):
    df = spark.createDataFrame([(1, "été"), (2, "Ete"), (3, "etd"), (4, "7"), (5, "f")], "page_id bigint, v string")
    assert [r.page_id for r in reports.sorted_by(df, "v").collect()] == [4, 3, 1, 2, 5]


def test_text_order_of_the_sql(spark):
    """Blanks, signs and letters that languages order in their own ways stand as DuckDB places them."""
    import duckdb

    texts = ["Achst enbeer", "Achßß enber", "Anorti. Thed", "Anorti. | Ly.", "Anorti.", "été", "Ete", "etd", "a-b", "a b", "ab", "a_b", "æ", "az", "Σας", "σασ", "İx", "iy", "Å", "A", "e\u0301z", "ez", "_", "Z", "", "\u4e00", "\U0001f600", "～"]
    rows = list(enumerate(texts))
    db = duckdb.connect()
    db.execute("CREATE TABLE t (n BIGINT, v VARCHAR)")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = [r[0] for r in db.execute("SELECT n FROM t ORDER BY v COLLATE NOCASE.NOACCENT, n").fetchall()]
    got = ranking.ranked(spark.createDataFrame(rows, "n bigint, v string"), [*ranking.column_keys("v", text_key=text.plain), F.col("n").asc()], partitions=3)
    assert [r.n for r in got.orderBy("place").collect()] == want


def test_pages_of_rows_by_key(spark, pages, tmp_path):
    path = str(tmp_path / "ranked")
    ranking.ranked(pages.select("page_id", "page_score", "url"), [F.col("page_score").asc(), F.col("page_id").asc()], partitions=4).write.parquet(path)
    table, keys = spark.read.parquet(path), ["page_score", "page_id"]
    seen, last = [], None
    while got := ranking.page_after(table, keys, last, 7).collect():
        seen += [r.page_id for r in got]
        last = got[-1].page_score, got[-1].page_id
    assert seen == [r.page_id for r in table.orderBy(*keys).collect()]
    assert "GreaterThanOrEqual(page_score,50)" in ranking.page_after(table, keys, (50, 3), 7)._jdf.queryExecution().toString()


# ------------------------------------------------------------------ links
def test_checks_of_a_laid_out_graph_shuffle_nothing(spark, pages, tmp_path):
    graph = LinkGraph(spark, "test_graph", buckets=4, path=str(tmp_path / "graph")).lay_out(pages)
    assert rows_of(graph.broken_links()) == rows_of(crosspage.broken_links(pages)) != []
    for df in (graph.broken_links(), graph.unlinked(), graph.targets()):
        plan = plan_of(df)
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan, plan


def test_a_graph_counts_the_best_page_of_a_url(spark, tmp_path):
    rows = [
        {"url": "https://h.com/s", "html": links("/b", "/b/", "/none", "/s")},
        {"url": "https://h.com/b", "status_code": 404, "html": page()},
        {"url": "https://h.com/b?2", "html": page(title="a better one", meta="k" * 60)},
        {"url": "https://h.com/d", "fetch_error": "x"},
        {"url": "https://h.com/e", "html": links("/d")},
    ]
    made = crawl.written(audited(responses(spark, rows)), "pages")
    graph = LinkGraph(spark, "test_best", buckets=2, path=str(tmp_path / "graph")).lay_out(made)
    assert rows_of(graph.broken_links()) == rows_of(crosspage.broken_links(made)) == [(1, 4, 0, "https://h.com/d")]
    assert [r.page_id for r in graph.unlinked().orderBy("page_id").collect()] == [0, 4]
    graph.lay_out(made.where("page_id < 3"))
    assert graph.broken_links().count() == 0


# ------------------------------------------------------------------ addresses
def random_v6(rng):
    n = rng.choice([rng.getrandbits(128), rng.getrandbits(64), rng.getrandbits(16), (0xFE80 << 112) | rng.getrandbits(40), (0xFFFF << 32) | rng.getrandbits(32), (0xFC << 120) | rng.getrandbits(100), (0x20010DB8 << 96) | rng.getrandbits(16)])
    a = ipaddress.IPv6Address(n)
    return rng.choice([str(a), a.exploded, str(a).upper(), ":".join(f"{(n >> (112 - 16 * k)) & 0xFFFF:x}" for k in range(8))])


ODD = ":: ::1 1:: ::: 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 1:2:3:4:5:6:7:8:9 ::1:2:3:4:5:6:7:8 1::2::3 12345:: g:: 1:2:3:4:5:6:1.2.3.4 ::1.2.3.4 ::1.2.3.256 ::01.2.3.4 1.2.3.4 : 1: ::ffff:10.0.0.1 ::FFFF:10.0.0.1 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 x 1.2.3.4:: fe80::1.2.3.4".split()


def test_ipv6_equals_the_standard_library(spark):
    rng = random.Random(1)
    values = [*(random_v6(rng) for _ in range(2000)), *ODD, "", " ::1", "::1 ", None]
    nets = [ipaddress.ip_network(n) for n in guard.IPV6]

    def want(v):
        try:
            a = ipaddress.IPv6Address(v or "")
        except ValueError:
            return None
        return any(a in n for n in nets)

    df = spark.createDataFrame(list(enumerate(values)), "i int, ip string").select("i", guard.blocked_ipv6(F.col("ip")).alias("b"))
    assert {r.i: r.b for r in df.collect()} == {i: want(v) for i, v in enumerate(values)}
    assert not re.search("Python|Arrow", df._jdf.queryExecution().toString())


def test_smallest_networks_equal_the_standard_library(spark):
    rng = random.Random(2)
    low = lambda bits, size: rng.getrandbits(bits) >> (bits - size) << (bits - size)
    names = {str(ipaddress.IPv6Network((low(128, n), n))) for n in (rng.randint(0, 20) for _ in range(60))} | {str(ipaddress.IPv4Network((low(32, n), n))) for n in (rng.randint(1, 12) for _ in range(200))}
    names |= {"8000::/1", "::1/128", "ffff:ffff:ffff:ffff:8000::/65", "1.1.1.1/32"}
    nets = [ipaddress.ip_network(n) for n in names]
    ips = [*(random_v6(rng) for _ in range(500)), *(str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(500)), None, "x", "1.1.1.1", "1.1.1.1", "::1", "ffff:ffff:ffff:ffff:9000::1"]

    def want(v):
        try:
            a = ipaddress.ip_address(v or "")
        except ValueError:
            return None
        return max((str(n) for n in nets if n.version == a.version and a in n), key=lambda n: int(n.split("/")[1]), default=None)

    known = spark.createDataFrame([(n,) for n in [*names, "bad", "1.2.3.4/40", "::/129"]], "network string")
    got = networks.matched(spark.createDataFrame(list(enumerate(ips)), "i int, ip string"), known)
    assert rows_of(got.select("i", "network")) == sorted(((i, want(v)) for i, v in enumerate(ips)), key=repr)
    assert networks.matched(spark.createDataFrame([(1, "::1")], "i int, ip string"), known.limit(0)).first().network is None


# ------------------------------------------------------------------ search
def test_searches_by_index_equal_reading_all(spark, pages, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), shelves=8).build(pages.select("page_id", "url", "page_title"), F.concat_ws("\n", "url", "page_title"))
    texts = {r.page_id: f"{r.url}\n{r.page_title}".lower() for r in pages.collect()}
    rng = random.Random(3)
    needles = ["SITE2", "ab", "zzz", "site2.example.com/p/1", "%"]
    for text in rng.sample(sorted(texts.values()), 2):
        a = rng.randrange(len(text) - 4)
        needles.append(text[a : a + rng.choice([3, 4, 9, 20])])
    for needle in needles:
        assert sorted(r.page_id for r in index.containing(needle).collect()) == sorted(i for i, t in texts.items() if needle.lower() in t), needle
    plan = plan_of(index.candidates("site2"))
    assert re.search(r"PartitionFilters: \[.*shelf", plan) and "PushedFilters: [" in plan and "In(gram" in plan


def test_index_of_odd_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "aaaa"), (5, "ÄÖÜ x"), (5, "äöü x"), (6, "long " * 50_000 + "needle")]
    index = TextIndex(spark, str(tmp_path / "index"), shelves=4).build(spark.createDataFrame(rows, "page_id int, t string"), F.col("t"))
    found = lambda n: sorted(r.page_id for r in index.containing(n).collect())
    assert found("aaa") == [4] and found("ÖÜ X") == [5, 5] and found("needle") == [6] and found("aaaaa") == [] and found("ab") == [3] and len(found("")) == 7
    empty = TextIndex(spark, str(tmp_path / "none")).build(spark.createDataFrame([], "page_id int, t string"), F.col("t"))
    assert empty.containing("abc").count() == 0
