"""URL, text and rule boundaries, each as a small table."""

import json
import math

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.functions import html as H
from auditloom.functions import text as T
from auditloom.functions import urls as U
from auditloom.operators import extract_dom, guard, reports, rules, scoring, sitechecks
from auditloom.operators.audit import audited

BASE = "https://h.com/a/b"


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in rows.select("i", expr(F.col("c")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    cases = {"https://h.com": "https://h.com/", "https://h.com/x/?q=1#f": "https://h.com/x", "http://u:p@h.com:8080/x": "http://h.com/x", "#top": None, "/x/": "https://h.com/x", "c": "https://h.com/a/c", "": None, " \t/y\n": "https://h.com/y", "//": None, "HTTP://h.com/z": "https://h.com/a/HTTP://h.com/z"}
    assert column(spark, list(cases), lambda c: U.normalize(c, F.lit(BASE))) == list(cases.values())


def test_resolve(spark):
    cases = {"//cdn.com/x": "https://cdn.com/x", "../c": "https://h.com/a/../c", "?p=2": "https://h.com/a/?p=2", "/z": "https://h.com/z"}
    assert column(spark, list(cases), lambda c: U.resolve_relative(c, F.lit(BASE))) == list(cases.values())
    assert column(spark, ["c"], lambda c: U.resolve_relative(c, F.lit("https://h.com/a/"))) == ["https://h.com/c"]
    assert column(spark, ["c"], lambda c: U.resolve_relative(c, F.lit("https://h.com"))) == ["https://h.com/c"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/.?#:htps", max_size=20), min_size=20, max_size=20))
def test_normalize_is_idempotent(spark, values):
    once = column(spark, values, lambda c: U.normalize(c, F.lit(BASE)))
    known = [v for v in once if v is not None]
    if known:
        assert column(spark, known, lambda c: U.normalize(c, c)) == known


def test_skipped_extensions(spark):
    urls = [f"https://h.com/f.{e.upper()}" for e in U.SKIPPED] + ["https://h.com/f.html", "https://h.com/a.b/c", "https://h.com/", "https://h.pdf"]
    assert len(U.SKIPPED) == 27 and column(spark, urls, U.is_skipped) == [True] * 27 + [False] * 4


def test_links_that_lead_nowhere(spark):
    assert column(spark, ["mailto:x", "tel:1", "javascript:0", "#x", "", "JavaScript:0", "/a"], U.is_eligible_link) == [False] * 5 + [True] * 2


def test_html_type(spark):
    rows = spark.createDataFrame([("", "https://h/a"), ("", "https://h/a.pdf"), ("Text/HTML; charset=x", "u"), ("application/pdf", "u"), ("application/xhtml+xml", "u")], "h string, u string")
    assert [r.x for r in rows.select(U.is_html_type(U.content_type(F.col("h")), F.col("u")).alias("x")).collect()] == [True, False, True, False, True]


def test_robots(spark):
    body = "Sitemap: /s.xml\r\n SITEMAP : https://h.com/t.xml\rsitemap:  \nDisallow: /\nSitemap:/s.xml\nsitemapx: no"
    assert column(spark, [body, None, ""], lambda c: U.robots_sitemaps(c, F.lit("https://h.com/robots.txt"))) == [["https://h.com/s.xml", "https://h.com/t.xml"], [], []]


def test_words(spark):
    cases = {"für a - b don't x-y 12": 7, "": 0, "--a b-": 2, "'tis": 1, "a": 1, "a  b\nc": 3}
    assert column(spark, list(cases), T.word_count) == list(cases.values())
    assert column(spark, ["<body><li>a</li><li>b</li></body>", "<body>a <!-- x y -->b<script>var c</script>", "no body", "<BODY class=x>a&amp;b"], lambda c: H.text_words(H.body_text(H.body_source(c)))) == [1, 3, 2, 2]


def test_slug_and_escapes(spark):
    assert column(spark, ["My Report: 2026!", "", None], T.slug) == ["my-report-2026-", "report", "report"]
    assert column(spark, ["a", "a b", 'q"q', "x,y", "back\\slash", ""], T.csv_field) == ["a", '"a b"', '"q""q"', '"x,y"', '"back\\slash"', ""]
    assert column(spark, ["<a href='x'>&\"</a>"], T.escape_html) == ["&lt;a href=&#039;x&#039;&gt;&amp;&quot;&lt;/a&gt;"]
    headers = spark.createDataFrame([(["A: 1", "b:2 ", "A:  3", "junk", "c:x:y"],)], "c array<string>")
    assert headers.select(T.parse_header_lines(F.col("c"))).first()[0] == {"a": ["1", "3"], "b": ["2"], "c": ["x:y"]}
    assert column(spark, ["cURL error 28: x", "SSL connection timeout", "Operation timed out", "refused"], T.is_timeout) == [True, True, True, False]


def responses(spark, rows):
    base = {"report": 1, "url": "https://h.com/p", "status_code": 200, "content_type_header": "text/html", "html": "", "redirect_hops": 0, "redirect_target": "", "redirect_final_url": "", "load_time": 5, "fetch_error": ""}
    return spark.createDataFrame([tuple({**base, "page_id": i, **r}[f.name] for f in schemas.RESPONSE) for i, r in enumerate(rows)], schemas.RESPONSE)


def kinds(spark, rows):
    return [[i.type for i in r.issues] for r in audited(responses(spark, rows)).orderBy("page_id").collect()]


def page(title="A good title", meta="m" * 60, h1=1, words=300, more=""):
    return f'<html><head><title>{title}</title><meta name="description" content="{meta}"><link rel="canonical" href="x"><meta property="og:title" content=""><meta property="og:description" content="d">{more}</head><body>{"<h1>h</h1>" * h1}{" w" * (words - (h1 > 0))}</body></html>'


@pytest.mark.parametrize("name,cases", [
    ("title", [(page(title="t" * n), want) for n, want in ((0, ["missing_title"]), (1, ["title_too_short"]), (9, ["title_too_short"]), (10, []), (60, []), (61, ["title_too_long"]))]),
    ("meta", [(page(meta="t" * n), want) for n, want in ((0, ["missing_meta_description"]), (1, ["meta_description_too_short"]), (49, ["meta_description_too_short"]), (50, []), (160, []), (161, ["meta_description_too_long"]))]),
    ("h1", [(page(h1=n), want) for n, want in ((0, ["missing_h1"]), (1, []), (2, ["multiple_h1"]))]),
    ("words", [(page(words=299), ["thin_content"]), (page(words=300), [])]),
    ("robots", [(page(more=f'<meta name="robots" content="{c}">'), want) for c, want in (("NOINDEX, follow", ["noindex"]), ("none", []), ("nofollow", []))]),
    ("images", [(page(more=i), want) for i, want in (("<img src=a>", ["images_missing_alt"]), ('<img alt="">', ["images_missing_alt"]), ('<img alt=" ">', ["images_missing_alt"]), ('<img alt="x"/>', []), ("<imgx>", []))]),
])
def test_rule_boundaries(spark, name, cases):
    assert kinds(spark, [{"html": h} for h, _ in cases]) == [want for _, want in cases]


def test_classes_and_their_scores(spark):
    rows = [
        {"status_code": 404, "html": page(words=299)},
        {"content_type_header": "application/pdf"},
        {"content_type_header": "application/pdf", "status_code": 404},
        {"redirect_hops": 1, "status_code": 301, "redirect_target": "t"},
        {"redirect_hops": 3, "status_code": 301},
        {"fetch_error": "boom", "status_code": 0, "html": None},
        {"url": "https://h.com/a.pdf", "content_type_header": ""},
        {"html": None, "content_type_header": None, "url": "https://h.com/"},
    ]
    got = audited(responses(spark, rows)).orderBy("page_id").collect()
    assert [[i.type for i in r.issues] for r in got[:7]] == [["http_error"], ["non_html_resource"], ["http_error", "non_html_resource"], ["redirect"], ["redirect"], ["fetch_error"], ["non_html_resource"]]
    assert [r.page_score for r in got[:7]] == [85, 100, 0, 100, 100, 0, 100]
    assert [got[i].issues[0].message for i in (3, 4, 5, 6)] == ["URL responded with a redirect", "URL redirected 3 times before reaching the final target", "Failed to fetch page: boom", "Skipped HTML checks for non-HTML resource (unknown content type)"]
    assert [r.page_type for r in got] == ["html", "resource", "resource", "redirect", "redirect", "resource", "resource", "html"] and got[5].status_code == 0
    assert all(6 <= r.page_score <= 100 for r in got if r.page_type == "html")


def test_score_and_labels(spark):
    issues = [("a", s, "m") for s in ("error", "warning", "notice", "odd", None)]
    rows = spark.createDataFrame([(issues,), ([("a", "error", "m")] * 9,), ([],)], "i array<struct<type:string,severity:string,message:string>>")
    assert [r[0] for r in rows.select(scoring.page_score(F.col("i"))).collect()] == [74, 0, 100]
    assert column(spark, ["html", "redirect", "", "otherType"], scoring.page_type_label) == ["HTML", "Redirect", "Unknown", "OtherType"]
    assert column(spark, ["", "{bad", None, '[{"type":"t","severity":"error","message":"m"}]'], lambda c: F.size(scoring.issues_from_json(c))) == [0, 0, 0, 1]
    assert column(spark, [0, 199, 200, 301, 404, 500], scoring.http_class, "int") == ["success", "success", "success", "info", "warning", "danger"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(-5, 250)), min_size=20, max_size=20))
def test_progress(spark, pairs):
    rows = spark.createDataFrame(pairs, "p int, m int")
    want = [0 if m <= 0 else max(0, min(100, math.floor(100 * p / m + 0.5))) for p, m in pairs]
    assert [r[0] for r in rows.select(scoring.progress_percent(F.col("p"), F.col("m"))).collect()] == want


def test_append_if_missing_keeps_the_first(spark):
    rows = spark.createDataFrame([([("a", "error", "m")],), ([],)], "i array<struct<type:string,severity:string,message:string>>")
    assert [[tuple(i) for i in r[0]] for r in rows.select(rules.append_if_missing(F.col("i"), "a", "notice", F.lit("n"))).collect()] == [[("a", "error", "m")], [("a", "notice", "n")]]


def test_guard(spark):
    cases = {
        "": guard.REQUIRED, "nothing": guard.INVALID, "ftp://h.com/": guard.BAD_SCHEME, "http://localhost/": guard.PRIVATE_NAME, "http://intranet/": guard.PRIVATE_NAME, "http://x.local/": guard.PRIVATE_NAME, "http://10.0.0.1/": guard.PRIVATE_NAME,
        "http://[::1]/": guard.PRIVATE_NAME, "http://[fe80::1]": guard.PRIVATE_NAME, "http://inside.org/": guard.PRIVATE_ADDRESS, "http://six.org/": guard.PRIVATE_ADDRESS, "http://[2606:4700::1111]/": "", "http://93.184.216.34/": "", " https://h.com/a// ": "",
    }
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, base_url string")
    dns = spark.createDataFrame([("inside.org", ["8.8.8.8", "192.168.0.5"]), ("six.org", ["fd00::1"]), ("h.com", ["8.8.8.8"])], "host string, ips array<string>")
    got = {r.base_url: (r.error, r.url) for r in guard.guarded(urls, dns).collect()}
    assert {u: e for u, (e, _) in got.items()} == cases and got[" https://h.com/a// "][1] == "https://h.com/a"


def test_sitemap_counts(spark):
    cases = {"<urlset><url/><url/><url/></urlset>": 3, '<x:urlset xmlns:x="urn:a"><x:url/></x:urlset>': 1, "<sitemapindex><sitemap/></sitemapindex>": 0, "<urlset><url></urlset>": 0, "  ": 0, None: 0}
    assert column(spark, list(cases), sitechecks.sitemap_url_count) == list(cases.values())


def test_stale_runs(spark):
    rows = [(1, 1000 - 31, 0, 0, ""), (1, 1000 - 29, 0, 0, ""), (1, 1000 - 31, 1, 0, ""), (1, 0, 5, 5, "x"), (4, 0, 0, 0, ""), (1, 900, 0, 0, " \t")]
    df = spark.createDataFrame(rows, "status int, started_at long, pages_crawled long, progress_pages long, last_crawled_url string")
    assert [r[0] for r in df.select(reports.is_stale(F.lit(1000))).collect()] == [True, False, False, True, False, True]


def test_json_of_the_issue_schema(spark):
    assert json.loads(schemas.ISSUES.json())["elementType"]["fields"][0]["name"] == "type"


def test_plans_write_no_pattern_out_again_and_again(spark):
    """normalize() and decode_entities() compute what they mention several times once."""
    df = spark.createDataFrame([("http://h.com/a/?x#y", "a &amp; b")], "u string, t string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(U.normalize_stored(F.col("u"))).count("#.*$") == 1
    assert plan(T.decode_entities(F.regexp_replace("t", "q+", ""))).count("q+") == 1
    assert df.select(U.normalize_stored(F.col("u")), T.decode_entities(F.col("t"))).first() == ("http://h.com/a", "a & b")


def test_parsed_facts_leave_by_few_rows():
    """A batch of many documents is neither held as text at once nor answered as a whole."""
    batch = pa.record_batch({"page_id": range(450), "html": [None if i == 7 else f"<title>t{i}</title><a href='/x'>" for i in range(450)]})
    found = list(extract_dom.fact_batches(batch))
    assert [b.num_rows for b in found] == [200, 200, 50]
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(450)) and rows[7]["page_title"] == "" and rows[449]["page_title"] == "t449" and rows[449]["hrefs"] == ["/x"]
