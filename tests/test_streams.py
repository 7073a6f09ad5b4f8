"""Keyed crawl state, committed pages, duplicates as they arrive and roll-ups, against the batch operators, over restarts too."""

import itertools
import os
import random

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from auditloom.operators import crawl, crosspage, reports
from auditloom.operators.audit import audited
from auditloom.sources import crawl_view, page_table
from auditloom.streaming import duplicates, frontier, rollup
from tests.conftest import SMALL
from tests.test_audit import brute_crawl, links
from tests.test_functions import page, responses


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return crawl.written(audited(crawl_view.read(spark, SMALL)), "pages")


# ------------------------------------------------------------------ the crawl
GRAPH = {0: [3, 1, 3, 2], 1: [4, 0], 2: [5, 6], 3: [6, 7, 1], 6: [8], 8: [9, 0]}


def site(spark):
    u = lambda i: f"https://h.com/{i}"
    rows = [{"url": u(i), "html": links(*(f"/{t}?x=1" for t in GRAPH.get(i, [])), "/f.pdf", "https://other.org/")} for i in range(9)]
    rows[7] |= {"status_code": 301, "redirect_hops": 2, "redirect_target": "https://h.com/mid", "redirect_final_url": "https://h.com/10", "html": ""}
    graph = {u(i): [u(t) for t in v] for i, v in (GRAPH | {7: [10]}).items()}
    return responses(spark, rows), graph


@pytest.mark.parametrize("budget", [5, 50])
def test_keyed_state_crawls_like_a_queue(spark, tmp_path, budget):
    answers, graph = site(spark)
    bases = spark.createDataFrame([(1, "https://h.com/0", budget), (2, "https://h.com/2", budget), (3, "https://h.com/x.pdf", budget)], "report long, base_url string, max_pages int")
    run = frontier.Crawl(spark, str(tmp_path / "crawl"), crawl.from_site_map(answers))
    run.begin(bases)
    got = run.run()
    for report, start in ((1, 0), (2, 2)):
        own = [r.url for r in got.where(F.col("report") == report).orderBy("crawl_order").collect()]
        assert own == brute_crawl(graph, f"https://h.com/{start}", budget)
    assert got.where("report = 3").count() == 0
    done = {r.report: (r.progress_pages, r.last_crawled_url) for r in run.progress().collect()}
    assert done == {r.report: (r.progress_pages, r.last_crawled_url) for r in reports.progress(got).collect()}


def test_a_crawl_goes_on_after_a_failure(spark, tmp_path):
    answers, graph = site(spark)
    fetch, calls = crawl.from_site_map(answers), itertools.count(1)

    def failing(wanted):
        if next(calls) == 2:
            raise OSError("lost")
        return fetch(wanted)

    bases = spark.createDataFrame([(1, "https://h.com/0", 50)], "report long, base_url string, max_pages int")
    run = frontier.Crawl(spark, str(tmp_path / "crawl"), failing)
    run.begin(bases)
    with pytest.raises(StreamingQueryException, match="lost"):
        run.run()
    assert [r.url for r in run.pages().collect()] == ["https://h.com/0"]  # what was committed before stays
    again = frontier.Crawl(spark, str(tmp_path / "crawl"), fetch).run()
    assert [r.url for r in again.orderBy("crawl_order").collect()] == brute_crawl(graph, "https://h.com/0", 50)
    assert frontier.Crawl(spark, str(tmp_path / "crawl"), fetch).run().count() == again.count()


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Mapping(dict):
    containsKey, removeKey = dict.__contains__, dict.__delitem__

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value


def test_state_takes_answers_in_any_order_and_twice():
    graph = {i: [(i * 7 + k) % 60 for k in range(1, 4)] for i in range(60)}
    for seed in range(30):
        rng = random.Random(seed)
        state = frontier.Frontier()
        state.head, state.places, state.waiting = Value(), Mapping(), Mapping()
        row = lambda parent, links, budget=None: frontier.Row(report=1, parent=parent, budget=budget, links=links)
        waiting, order, told = [row(0, ["0"], 25)], {}, []
        while waiting:
            rng.shuffle(waiting)
            some, waiting = waiting[: rng.randint(1, 4)], waiting[4:] if len(waiting) > 4 else []
            some += rng.sample(told, min(len(told), 2))
            for r in state.handleInputRows((1,), iter(some), None):
                assert r.crawl_order not in order
                order[r.crawl_order] = r.url
                waiting.append(row(r.crawl_order, [str(t) for t in graph[int(r.url)]]))
            told += some
        # Rows that were cut off above never came, so the order is a beginning of the queue's.
        want = brute_crawl({str(i): [str(t) for t in v] for i, v in graph.items()}, "0", 25)
        assert [order[i] for i in sorted(order)] == want[: len(order)]


# ------------------------------------------------------------------ the page table
def test_pages_and_progress_come_back_as_written(spark, pages, tmp_path):
    path = str(tmp_path / "table")
    page_table.append(pages.where("page_id < 20"), path, order="page_id")
    page_table.append(pages.where("page_id >= 20"), path, order="page_id")
    assert rows_of(page_table.pages(spark, path)) == rows_of(pages)
    want = reports.progress(pages.withColumn("crawl_order", F.col("page_id"))).join(pages.groupBy("report").count(), "report").select("report", "count", "last_crawled_url")
    assert rows_of(page_table.progress(spark, path)) == rows_of(want)
    plan = page_table.pages(spark, path).where("page_score > 50").select("url")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(page_score), GreaterThan(page_score,50)]" in plan and "ReadSchema: struct<url:string,page_score:int>" in plan
    page_table.append(pages.where("page_id = 3"), path, order="page_id", overwrite=True)
    assert [r.page_id for r in page_table.pages(spark, path).collect()] == [3]
    assert page_table.progress(spark, path).first().progress_pages == 1
    page_table.append(pages.limit(0), path, order="page_id")
    assert page_table.pages(spark, path).count() == 1


def test_a_failed_write_leaves_no_rows(spark, pages, tmp_path):
    path = str(tmp_path / "table")
    page_table.append(pages.where("page_id < 5"), path, order="page_id")
    before = page_table.Folder(path).commits()
    broken = pages.repartition(4, "page_id").withColumn("url", F.when(F.col("page_id") == 30, F.raise_error(F.lit("bad page"))).otherwise(F.col("url")))
    with pytest.raises(PySparkException, match="bad page"):
        page_table.append(broken, path, order="page_id")
    assert page_table.Folder(path).commits() == before
    assert page_table.pages(spark, path).count() == pages.where("page_id < 5").count()
    stray = tmp_path / "table" / "pages" / "killed.parquet"
    stray.write_bytes(b"x")  # of a task that was killed
    folder = page_table.Folder(path)
    assert page_table.pages(spark, path).count() == pages.where("page_id < 5").count()
    assert folder.vacuum() == 0 and folder.vacuum(older_than_s=0) >= 1 and not stray.exists()
    assert page_table.pages(spark, path).count() == pages.where("page_id < 5").count()


def test_an_epoch_is_committed_once(spark, pages, tmp_path):
    path = str(tmp_path / "table")
    for epoch in (0, 1, 1, 0):
        page_table.append(pages.where(F.col("page_id") % 2 == epoch), path, query="q", epoch=epoch, order="page_id")
    assert rows_of(page_table.pages(spark, path)) == rows_of(pages)
    named = {os.path.basename(p) for c in page_table.Folder(path).held() for p in c["pages"]}
    assert set(os.listdir(f"{path}/pages")) == named  # files of the repeated epochs are gone
    page_table.append(pages.limit(1), path, query="other", epoch=0, order="page_id")
    assert page_table.pages(spark, path).count() == pages.count() + 1


def test_a_stream_commits_each_batch_with_its_progress(spark, pages, tmp_path):
    page_table.register(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    pages.repartition(3, "page_id").write.parquet(source)
    stream = lambda: spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    start = lambda: stream().writeStream.format("audit_pages").options(path=path, order="page_id", checkpointLocation=str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    start()
    assert rows_of(page_table.pages(spark, path)) == rows_of(pages) and len(page_table.Folder(path).commits()) == 3
    pages.where("page_id < 3").write.mode("append").parquet(source)
    start()  # a restart goes on behind what is committed
    assert page_table.pages(spark, path).count() == pages.count() + pages.where("page_id < 3").count()
    assert page_table.progress(spark, path).agg(F.sum("progress_pages")).first()[0] == page_table.pages(spark, path).count()


# ------------------------------------------------------------------ duplicates
@pytest.mark.parametrize("seed", [1])
def test_duplicates_in_any_order_and_over_a_restart(spark, pages, tmp_path, seed):
    want = reports.issue_rows(crosspage.checked(pages)).where("type like 'duplicate%'").select("report", "page_id", "type", "severity", "message")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):
        pages.where(F.pmod(F.xxhash64("page_id", F.lit(seed)), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(source)
        if part in (1, 3):  # the second run finds first pages waiting in state
            found = duplicates.duplicates(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source))
            found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    assert rows_of(spark.read.parquet(out)) == rows_of(want) and want.count() > 0


# ------------------------------------------------------------------ roll-ups
def held_to_batch(spark, roll, seen):
    final = crawl.written(crosspage.checked(crawl.written(seen, "seen")), "final")
    own = reports.page_type_summary(final).join(reports.severity_totals(final), "report").join(crosspage.overall_scores(final), "report")
    assert rows_of(roll.reports()) == rows_of(own.select(*roll.reports().columns))
    assert roll.issue_summary().collect() == reports.issue_summary(final).collect()
    assert rows_of(roll.issue_summary(["report"])) == rows_of(reports.issue_summary(final, ["report"]))
    assert rows_of(roll.current().select("report", "page_id", "page_type", "issues", "page_score")) == rows_of(final.select("report", "page_id", "page_type", "issues", "page_score"))


def test_roll_ups_equal_the_batch_after_each_epoch(spark, pages, tmp_path):
    roll, seen = rollup.Rollup(spark, str(tmp_path / "roll"), buckets=4), pages.limit(0)
    for epoch in range(3):
        batch = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(3)) == epoch)
        roll.add(batch, epoch)
        if epoch == 1:
            roll.add(batch, epoch)  # an epoch that runs again
        seen = seen.unionByName(batch)
        held_to_batch(spark, roll, seen)


def test_later_pages_change_earlier_ones(spark, tmp_path):
    rows = [
        {"url": "https://h.com/s", "html": links("/b", "/c", "/s")},  # links to what comes later
        {"url": "https://h.com/b", "status_code": 404, "html": page(title="one title")},
        {"url": "https://h.com/c", "status_code": 500, "html": page(title="One Title ", meta="n" * 60)},
        {"url": "https://h.com/b?again", "html": page(title="another one", meta="k" * 60)},  # a better page at the same URL: no longer broken
        {"url": "https://h.com/s", "html": page(title="better page", meta="j" * 60)},  # takes the place of the first one, whose links count no more
        {"url": "https://h.com/x", "report": 2, "html": page(title="one title")},
        {"url": "https://h.com/d", "redirect_hops": 1, "status_code": 301},
    ]
    pages = crawl.written(audited(responses(spark, rows)), "pages")
    roll = rollup.Rollup(spark, str(tmp_path / "roll"), buckets=2)
    for epoch in range(len(rows)):
        roll.add(pages.where(F.col("page_id") == epoch), epoch)
        if epoch in (2, 3, 4, 6):
            held_to_batch(spark, roll, pages.where(F.col("page_id") <= epoch))
    roll.add(pages.limit(0), len(rows))
    held_to_batch(spark, roll, pages)
