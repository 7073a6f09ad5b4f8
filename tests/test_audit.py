"""Cross-page checks, reports, exports, crawl and streams on small sites; queries against their SQL on the small tables."""

import csv
import io
import json
import os
import socket
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from auditloom import schemas
from auditloom.functions import urls as U
from auditloom.operators import crawl, crosspage, export, extract_dom, guard, reports
from auditloom.operators.audit import audited, classified, extracted
from auditloom.plans import catalogue
from auditloom.plans import worker as queue
from auditloom.sources import crawl_view, derived, dns, http
from auditloom.streaming import worker
from tests.conftest import SMALL
from tests.test_functions import page, responses


@pytest.fixture(scope="module")
def small_pages(spark):
    """The checked pages of the small crawl, written once."""
    return crawl.written(crosspage.checked(crawl.written(audited(crawl_view.read(spark, SMALL)), "pages")), "checked")


def links(*urls):
    return page().replace("</body>", "".join(f'<a href="{u}">x</a>' for u in urls) + "</body>")


def checked(spark, rows):
    return {r.page_id: r for r in crosspage.checked(audited(responses(spark, rows))).collect()}


def test_duplicates_within_a_report_only(spark):
    rows = [
        {"url": "https://h.com/1", "html": page(title="Home page A", meta="a" * 60)},
        {"url": "https://h.com/2", "html": page(title=" home PAGE a ", meta="b" * 60)},
        {"url": "https://h.com/3", "html": page(title="Home page A", meta="B" * 60), "report": 2},
        {"url": "https://h.com/4", "html": page(title="", meta="c" * 60)},
        {"url": "https://h.com/5", "html": page(title="", meta="d" * 60)},
    ]
    got = checked(spark, rows)
    assert [[i.type for i in got[i].issues] for i in range(5)] == [["duplicate_title"], ["duplicate_title"], [], ["missing_title"], ["missing_title"]]
    assert [got[i].page_score for i in range(5)] == [92, 92, 100, 85, 85]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_broken_links(spark, n):
    targets = [{"url": f"https://h.com/b{i}", "status_code": 404, "html": page(title=f"broken number {i}", meta=str(i) * 60)} for i in range(n)]
    more = [{"url": "https://h.com/r", "status_code": 301, "redirect_hops": 1}, {"url": "https://h.com/dead", "fetch_error": "x"}]
    urls = [f"/b{i}?q#f" for i in range(n)] + ["/b0", "/r", "/not-crawled"]
    got = checked(spark, [{"url": "https://h.com/s", "html": links(*urls)}, *targets, *more])
    shown = ", ".join(f"https://h.com/b{i}" for i in range(min(n, 3))) + (f" (+{n - 3} more)" if n > 3 else "")
    assert [i.message for i in got[0].issues] == [f"Page contains {n} broken internal link{'s' * (n > 1)}: {shown}"] and got[0].page_score == 85


def test_overall_score_rounds_up(spark):
    pages = spark.createDataFrame([(1, 100), (1, 75), (2, 1)], "report long, page_score int")
    assert sorted(map(tuple, crosspage.overall_scores(pages).collect())) == [(1, 88), (2, 1)]


def test_summary_counts_every_issue(small_pages):
    pages = small_pages
    rows = pages.collect()
    summary = reports.issue_summary(pages).collect()
    assert sum(r["count"] for r in summary) == sum(len(r.issues) for r in rows)
    assert [r["count"] for r in summary] == sorted((r["count"] for r in summary), reverse=True)
    kinds = reports.page_type_summary(pages).collect()
    assert sum(r.html + r.redirect + r.resource for r in kinds) == len(rows)


FACTS = "page_title meta_description h1_count h1_text h2_count canonical_url robots_noindex robots_nofollow images_total images_missing_alt links_internal links_external word_count has_og_title has_og_description".split()
MARKUP = [
    """<html><head><title>A &#8211; B &eacute;&amp;lt; &copy</title></head><body><img title="a > b" alt="c"><a title="1>0" href="/x">l</a> two words</body></html>""",
    """<head><meta data-x=" name=y" name="description" content="d &hellip; &bogus; &#x41;"><meta name=robots content=noindex></head><body>x</body>""",
    "no body tag at all, <b>six</b> words",
    "<title>t</title><p>one <!-- <h1>no</h1> --> two",
    "<body><h1 class='a>b'>Head &lt;i&gt; line</h1>a < b and 5<6 it's</body>",
    """<body><p data-a='<a href="/no">'>it's &amp; R&amp;D</p><a href = /y>m</a><a href='/z?a=1&amp;b=2'>n</a><a name=q>o</a></body>""",
    """<body><IMG ALT='x'><img alt=""><img alt=" &#32; "><img src="data:x;a=b>c"><h2>a</h2><H2 title="<h2>">b</H2></body>""",
    "<body><script>var a = '<p>' + \"b\";</script>after</body>",
    "", "<", "<body", "plain &#0; &#99999999; &#xD800; &#128512; text",
]


def test_dom_and_pattern_tiers_agree(spark):
    made = responses(spark, [{"url": f"https://h.com/{i}", "html": h} for i, h in enumerate(MARKUP)])
    for view in (crawl_view.read(spark, SMALL), crawl_view.odd(spark, SMALL), made):
        dom = {r.page_id: r for r in extract_dom.extracted(view).collect()}
        rows = extracted(classified(view)).where("kind = 'html'").collect()
        assert rows
        for r in rows:
            assert {c: r[c] for c in FACTS} == {c: dom[r.page_id][c] for c in FACTS}, r.page_id


def test_a_page_of_very_many_attributes_and_marks(spark):
    """Loops of patterns are bounded: no page fails a job, whatever it is made of."""
    tricky = ["<a " + "x=y " * 200_000, "<a " + 'x="y>" ' * 5_000 + ">t</a>", "<" * 200_000, "&#65;" * 100_000, "<p><b>" * 100_000, '<img alt="' + "a" * 2_000_000 + '">', "<body>" + "word " * 400_000]
    rows = {r.page_id: r for r in extracted(classified(responses(spark, [{"url": f"https://h.com/{i}", "html": h} for i, h in enumerate(tricky)]))).collect()}
    assert rows[5].images_total == 1 and rows[5].images_missing_alt == 0 and rows[6].word_count == 400_000 and rows[3].word_count == 1


def test_exports_parse_back(spark, small_pages, tmp_path):
    pages = small_pages
    want = {r.page_id: list(map(str, r[3:])) for r in export.page_rows(pages).collect()}
    lines = {r.page_id: r.line for r in export.page_lines(pages).collect()}
    assert all(next(csv.reader(io.StringIO(lines[i]))) == want[i] for i in want) and len(export.PAGE_HEADER) == 29 == len(want[0])
    issues = export.issues_csv(pages)
    assert issues.startswith("﻿" + '"Issue Type",Severity,Message,"Affected Pages"\n')
    assert len(list(csv.reader(io.StringIO(issues)))) == reports.issue_summary(pages).count() + 1
    all_reports = derived.reports(spark, SMALL)
    documents = {r.uid: json.loads(r.document) for r in export.json_documents(all_reports.where("uid between 1 and 9"), pages).collect()}
    for uid, d in documents.items():
        own = reports.pages_of(pages, uid).collect()
        assert [p["url"] for p in d["pages"]] == [r.url for r in own] and set(d) == {"report", "issuesSummary", "pages"}
        assert sum(s["count"] for s in d["issuesSummary"]) == sum(len(r.issues) for r in own)
    lines = export.json_lines(all_reports.where("uid between 1 and 9"), pages).orderBy("uid", "page_score", "page_id").collect()
    for uid, d in documents.items():
        head, *parts = (json.loads(r.json) for r in lines if r.uid == uid)
        assert {**head, "pages": parts} == d
    assert export.json_documents(all_reports.where("uid between 1 and 9"), pages, most_pages=5).where("uid < 8").count() == 0
    export.write_pages(pages, str(tmp_path / "pages"))
    export.write_pages(pages.where("report = 2").limit(1), str(tmp_path / "pages"))
    again = spark.read.parquet(str(tmp_path / "pages"))
    assert again.where("report = 2").count() == 1 and again.where("report <> 2").count() == pages.where("report <> 2").count()
    export.write_pages_csv(pages, "file://" + str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).count() == pages.count()


def test_state_machine(spark):
    now = F.lit(derived.NOW)
    rows = derived.reports(spark, SMALL)
    queued = reports.queue(rows, F.col("uid") < 20, now)
    assert {r.status for r in queued.where("uid < 20").collect()} <= {schemas.QUEUED, schemas.RUNNING}
    started = reports.start(queued, F.lit(True), now)
    assert started.where("status = 4").count() == 0 and started.schema == rows.schema
    failed = reports.fail(started, F.col("uid") == 4, F.lit("boom"), now)
    assert failed.where("uid = 4").first().error_message == "boom"
    assert reports.search(rows, "SITE1", ["title", "base_url"]).count() > 0 and not reports.is_empty(rows)
    assert reports.queued(rows, 0).count() == 1


def brute_crawl(site, base, budget):
    """A first-in-first-out queue over {url: [targets]}."""
    queue, visited = [base], []
    while queue and len(visited) < budget:
        url = queue.pop(0)
        if url in visited:
            continue
        visited.append(url)
        for t in site.get(url, []):
            if t not in visited and t not in queue:
                queue.append(t)
    return visited


@pytest.mark.parametrize("budget", [1, 5, 100])
def test_crawl_follows_the_queue(spark, budget):
    graph = {0: [3, 1, 3, 2], 1: [4, 0], 2: [5, 6], 3: [6, 7, 1], 6: [8], 8: [9, 0]}
    u = lambda i: f"https://h.com/{i}"
    rows = [{"url": u(i), "html": links(*(f"/{t}?x=1" for t in graph.get(i, [])), "/f.pdf", "https://other.org/")} for i in range(9)]
    rows[7] |= {"status_code": 301, "redirect_hops": 2, "redirect_target": "https://h.com/mid", "redirect_final_url": "https://h.com/10", "html": ""}
    rows[5] |= {"status_code": 301, "redirect_hops": 1, "redirect_target": "https://h.com/11", "html": ""}
    site = responses(spark, rows)
    bases = spark.createDataFrame([(1, u(0), budget), (2, u(2), budget), (3, "https://h.com/x.pdf", budget)], "report long, base_url string, max_pages int")
    got = crawl.crawl(bases, crawl.from_site_map(site))
    graph[7], graph[5] = [10], [11]
    for report, start in ((1, 0), (2, 2)):
        own = [r.url for r in got.where(F.col("report") == report).orderBy("crawl_order").collect()]
        assert own == brute_crawl({u(i): [u(t) for t in v] for i, v in graph.items()}, u(start), budget)
    assert got.where("report = 3").count() == 0
    last = reports.progress(got.where("report = 1")).first()
    assert last.progress_pages == got.where("report = 1").count()


def test_queue_worker(spark):
    rows = [{"url": "https://h.com/", "html": links("/1", "/2")}, {"url": "https://h.com/1", "html": page()}, {"url": "https://h.com/2", "status_code": 404, "html": page()}]
    site = responses(spark, rows)
    base = {f.name: "" if f.dataType.simpleString() == "string" else 0 for f in schemas.REPORT} | {"deleted": False, "max_pages": 50, "status": schemas.QUEUED, "title": "t"}
    rows = [{"uid": 1, "base_url": "https://h.com/", "queued_at": 5}, {"uid": 2, "base_url": "http://localhost/", "queued_at": 6}, {"uid": 3, "base_url": "https://h.com", "queued_at": 7}, {"uid": 4, "base_url": "https://h.com", "status": schemas.RUNNING, "started_at": 9}]
    table = spark.createDataFrame([tuple({**base, **r}[f.name] for f in schemas.REPORT) for r in rows], schemas.REPORT)
    probes = spark.createDataFrame([("https://h.com/robots.txt", 200, "Sitemap: /s.xml"), ("https://h.com/s.xml", 200, "<urlset><url/></urlset>")], "url string, status int, body string")
    done = queue.process_queue(table, crawl.from_site_map(site), F.lit(100), limit=2, probes=probes)
    got = {r.uid: r for r in done.reports.collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == [schemas.COMPLETED, schemas.FAILED, schemas.QUEUED, schemas.RUNNING]
    assert got[1].pages_crawled == 3 and got[1].sitemap_url_count == 1 and got[1].finished_at == 100 and got[2].error_message == "Private or local network targets are not allowed."
    assert got[1].overall_score == round(sum(r.page_score for r in done.pages.collect()) / 3) and got[4] == table.where("uid = 4").first()
    assert {r.uid: r.ends for r in done.lines.collect()}[1] == f"Status: Completed, pages crawled: 3, score: {got[1].overall_score}/100"
    again = queue.process_queue(done.reports, crawl.from_site_map(site), F.lit(200), uid=4)
    assert again.reports.where("uid = 4").first().status == schemas.COMPLETED


def test_queue_worker_fails_a_report_whose_crawl_fails(spark):
    base = {f.name: "" if f.dataType.simpleString() == "string" else 0 for f in schemas.REPORT} | {"deleted": False, "max_pages": 5, "status": schemas.QUEUED, "title": "t"}
    rows = [{"uid": 1, "base_url": "https://good.example"}, {"uid": 2, "base_url": "https://bad.example"}, {"uid": 3, "base_url": "https://inside.example"}]
    table = spark.createDataFrame([tuple({**base, **r}[f.name] for f in schemas.REPORT) for r in rows], schemas.REPORT)
    fetch = crawl.from_site_map(responses(spark, [{"url": "https://good.example/", "html": page()}]))

    def breaking(wanted):
        return fetch(wanted).withColumn("html", F.when(F.col("url").contains("bad"), F.raise_error(F.lit("broken site"))).otherwise(F.col("html")))

    found = {"inside.example": ["10.0.0.1"], "good.example": ["93.184.216.34"], "bad.example": []}
    done = queue.process_queue(table, breaking, F.lit(100), dns=lambda hosts: dns.looked_up(hosts, found.__getitem__))
    got = {r.uid: r for r in done.reports.collect()}
    assert [got[i].status for i in (1, 2, 3)] == [schemas.COMPLETED, schemas.FAILED, schemas.FAILED]
    assert "broken site" in got[2].error_message and got[2].finished_at == 100 and "private or reserved" in got[3].error_message
    assert got[1].pages_crawled == 1 and {r.report for r in done.pages.collect()} == {1}


def test_inserted_reports(spark):
    table = derived.reports(spark, SMALL)
    new = table.limit(3).withColumn("base_url", F.element_at(F.array(F.lit(" https://h.com/a// "), F.lit("http://localhost"), F.lit("https://inside.example")), F.row_number().over(Window.orderBy("uid"))))
    rows, refused = guard.inserted(table, new, spark.createDataFrame(derived.DNS, "host string, ips array<string>"))
    assert rows.count() == table.count() + 1 and rows.columns == table.columns and rows.where("base_url = 'https://h.com/a'").count() == 1
    assert sorted(r.error for r in refused.collect()) == sorted([guard.PRIVATE_NAME, guard.PRIVATE_ADDRESS])


def test_redirect_locations_as_columns_resolve_them(spark):
    pairs = [(u, b) for u in [*derived.URLS, "/a/../b", "../c", "x y"] for b in (derived.BASE, "https://h.com", "http://h.com/", "https://h.com/a/", "nothing")]
    df = spark.createDataFrame(pairs, "u string, b string")
    for r in df.select("u", "b", U.absolute(F.col("u"), F.col("b")).alias("full")).collect():
        if r.b != "nothing":
            assert http.resolved(r.u, r.b) == r.full, (r.u, r.b)


def test_three_attempts_after_timeouts():
    def send(answers, calls):
        def run(url, accept, private=False, family=0):
            calls.append(family)
            answer = answers[len(calls) - 1]
            if isinstance(answer, str):
                raise OSError(answer)
            return answer

        return run

    good, v4 = (200, {}, b""), socket.AF_INET
    for answers, families, result in [
        ([good], [0], good),
        ([http.TIMEOUT, good], [0, v4], good),
        (["SSL connection timeout", "operation timed out", good], [0, v4, v4], good),
        (["refused"], [0], "refused"),
        ([http.TIMEOUT, "refused"], [0, v4], "refused"),
        ([http.TIMEOUT, http.TIMEOUT, http.TIMEOUT], [0, v4, v4], f"Native cURL fallback failed: [28] {http.TIMEOUT}"),
        (["timed out"], [0], "timed out"),
    ]:
        calls = []
        try:
            got = http.attempt("http://a/", "x", send=send(answers, calls))
        except OSError as e:
            got = str(e)
        assert (calls, got) == (families, result)


def test_slow_servers_time_out(monkeypatch):
    import threading

    server = socket.create_server(("127.0.0.1", 0))
    monkeypatch.setattr(http, "TOTAL_SECONDS", 1)

    def drip():
        conn, _ = server.accept()
        conn.recv(1000)
        try:
            conn.sendall(b"HTTP/1.1 200 OK\r\n\r\n")
            for _ in range(50):
                conn.sendall(b"x")
                time.sleep(0.1)
        except OSError:
            pass

    threading.Thread(target=drip, daemon=True).start()
    began = time.monotonic()
    with pytest.raises(OSError, match="Operation timed out"):
        http.request(f"http://127.0.0.1:{server.getsockname()[1]}/", http.ACCEPT_PAGE, allow_private=True)
    assert time.monotonic() - began < 4
    server.close()


def test_fetch_records_redirects_and_failures():
    site = {"http://a/1": (301, {"location": "/2"}, b""), "http://a/2": (302, {"location": "http://b/x"}, b""), "http://b/x": (404, {"content-type": "text/html"}, b"no"), "http://a/loop": (301, {"location": "/loop"}, b""), "http://a/none": (301, {}, b"body")}

    def get(url, accept, private):
        if url not in site:
            raise OSError("refused")
        return site[url]

    assert http.fetch_one("http://a/1", get=get)[:6] == (301, "text/html", "no", 2, "http://a/2", "http://b/x")
    assert http.fetch_one("http://b/x", get=get)[:6] == (404, "text/html", "no", 0, "", "")
    assert http.fetch_one("http://a/none", get=get)[:6] == (301, "", "body", 0, "", "")
    assert http.fetch_one("http://a/loop", get=get)[-1] == "Too many redirects while fetching URL."
    assert http.fetch_one("http://a/x", get=get)[0] == 0 and http.fetch_one("http://a/x", get=get)[-1] == "refused"
    with pytest.raises(OSError):
        http.request("http://127.0.0.1:1/", http.ACCEPT_PAGE)


def test_http_source_reports_blocked_targets(spark):
    http.register(spark)
    rows = spark.read.format("audit_http").option("urls", "http://127.0.0.1/ http://localhost/x").load().collect()
    assert [r.status_code for r in rows] == [0, 0] and all("not allowed" in r.fetch_error for r in rows)


def test_streams(spark, tmp_path):
    view = crawl_view.read(spark, SMALL)
    view.write.parquet(str(tmp_path / "in"))
    stream = worker.responses(spark, str(tmp_path / "in"))
    query = worker.audited_stream(stream).writeStream.format("memory").queryName("audited").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("audited").count() == view.count()
    query = worker.issue_counts(stream).writeStream.format("memory").outputMode("complete").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    want = {(r.report, r.type, r.severity): r["n"] for r in reports.issue_rows(audited(view)).groupBy("report", "type", "severity").agg(F.count("*").alias("n")).collect()}
    assert {(r.report, r.type, r.severity): r["n"] for r in spark.table("counts").collect()} == want
    timed = stream.withColumn("fetched_at", F.timestamp_seconds(F.col("page_id") * 20))
    query = worker.fetch_health(timed).writeStream.format("memory").outputMode("append").queryName("health").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("health").columns == ["window", "report", "n", "bad", "load_time"]


def test_plans_prune_and_push_down(spark, tmp_path):
    pages = audited(crawl_view.read(spark, SMALL))
    export.write_pages(pages, str(tmp_path / "p"))
    plan = reports.pages_of(spark.read.parquet(str(tmp_path / "p")), 3).select("page_id", "url", "page_score")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(report" in plan and "html" not in plan.split("ReadSchema")[1]
    assert "ArrowEvalPython" not in crosspage.checked(pages)._jdf.queryExecution().toString()


DATA = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in DATA:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    some = os.environ.get("ALL_QUERIES") and list(catalogue.QUERIES) or ["url_normalize", "page_issues", "issue_summary", "broken_links", "export_pages_lines", "robots_sitemaps", "sitemap_url_count", "redirect_chain_fold", "url_guard", "finish_reports", "extract_odd_markup", "frontier_bfs", "export_json_documents", "insert_reports"]
    for name in some:
        if name in catalogue.ORACLE_SQL:
            df = catalogue.QUERIES[name](spark, SMALL)
            result = con.execute(catalogue.ORACLE_SQL[name])
            names = [c[0] for c in result.description]
            want = sorted(repr(tuple(dict(zip(names, r))[c] for c in sorted(names))) for r in result.fetchall())
            assert sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == want, name


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["type", "severity", "message", "count"] and rows.count() > 10
