"""Silent runs found by timers and the queue that several workers take from, against the batch operators, over restarts too."""

import random
import threading
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from auditloom.operators import reports as R
from auditloom.schemas import QUEUED, REPORT, RUNNING
from auditloom.sources import report_queue
from auditloom.streaming import stale

NOW = 1_700_000_000
FIELDS = [f.split()[0] for f in stale.CHANGE.split(", ")]


def report_rows(spark, rows):
    blank = {f.name: {"string": "", "boolean": False}.get(f.dataType.simpleString(), 0) for f in REPORT}
    return spark.createDataFrame([tuple((blank | r)[f.name] for f in REPORT) for r in rows], REPORT)


def change(uid, seen, status=RUNNING, started=NOW - 100, pages=0, progress=0, url=""):
    return uid, seen, status, started, pages, progress, url


def told(spark, folder, batches, **how):
    """Rows that come out if each of the batches of changes arrives by itself, the stream being started anew for each."""
    out = []
    for i, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, stale.CHANGE.replace("seen_at timestamp", "seen_at bigint")) if batch else spark.createDataFrame([], stale.CHANGE.replace("seen_at timestamp", "seen_at bigint"))
        rows.withColumn("seen_at", F.timestamp_seconds("seen_at")).select(*FIELDS).coalesce(1).write.parquet(f"{folder}/in/{i}")
        schema = spark.createDataFrame([], stale.CHANGE).schema
        found = stale.silent(spark.readStream.schema(schema).parquet(f"{folder}/in/*"), **how)
        writer = found.writeStream.foreachBatch(lambda df, _: out.extend((r.uid, r.queued_at) for r in df.collect())).option("checkpointLocation", f"{folder}/state")
        if how:
            assert writer.trigger(availableNow=True).start().awaitTermination(120)
            continue
        query, end = writer.trigger(processingTime="2 seconds").start(), time.time() + 60
        while not out and time.time() < end:
            time.sleep(1)
        query.stop()
    return out


def test_timers_find_silent_runs_over_restarts(spark, tmp_path):
    batches = [
        [change(1, NOW, started=NOW), change(2, NOW, started=NOW), change(3, NOW, started=0), change(4, NOW, started=NOW), change(5, NOW, started=NOW), change(6, NOW, started=NOW)],
        [change(2, NOW + 20, started=NOW, progress=1), change(4, NOW + 25, started=NOW, status=2), change(5, NOW + 10, started=NOW, url=" \t"), change(3, NOW + 25, started=0), change(None, NOW + 29, started=None)],
        [change(6, NOW + 29, started=NOW, url="https://h.com/"), change(None, NOW + 45)],  # 40 is the time now: 1 and 5 have been silent for 30 seconds
        [change(1, NOW + 50, started=NOW), change(1, NOW + 60, started=NOW + 60), change(7, NOW + 60, started=NOW + 20), change(None, NOW + 70)],
        [change(None, NOW + 200)],
    ]
    got = told(spark, str(tmp_path), batches, late="5 seconds")
    assert sorted(got) == [(1, NOW + 40), (1, NOW + 195), (3, NOW), (5, NOW + 40), (7, NOW + 65)]


def test_timers_agree_with_the_batch_reset(spark, tmp_path):
    draw = random.Random(5)
    rows = [{"uid": i, "status": draw.choice([RUNNING, RUNNING, QUEUED, 2]), "started_at": draw.choice([0, -1, NOW - draw.randrange(60)]), "pages_crawled": draw.choice([0, 0, 3]), "progress_pages": draw.choice([0, 0, 2]), "last_crawled_url": draw.choice(["", " ", "https://a/"]), "overall_score": 7} for i in range(200)]
    reports = report_rows(spark, rows)
    begun = [change(r["uid"], r["started_at"], started=r["started_at"]) for r in rows if r["status"] == RUNNING and r["started_at"] > 0]
    stand = [change(r["uid"], NOW, r["status"], r["started_at"], r["pages_crawled"], r["progress_pages"], r["last_crawled_url"]) for r in rows]
    draw.shuffle(stand)
    found = told(spark, str(tmp_path), [begun, stand[:90], stand[90:], stand[:50], [change(None, NOW + 60)]], late="60 seconds")
    assert len({u for u, _ in found}) == len(found) and {t for _, t in found} == {NOW}
    again = stale.requeued(reports, spark.createDataFrame(found, stale.SILENT))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(again) == key(R.reset_stale(reports, F.lit(NOW))) and len(found) > 40


def test_reports_side_by_side_share_a_key(spark, tmp_path):
    rows = [change(i, NOW, started=NOW - i % 20) for i in range(3000)] + [change(-i, NOW, status=2) for i in range(1, 3000)]
    spark.createDataFrame(rows, stale.CHANGE.replace("seen_at timestamp", "seen_at bigint")).withColumn("seen_at", F.timestamp_seconds("seen_at")).select(*FIELDS).write.parquet(f"{tmp_path}/in")
    found = stale.silent(spark.readStream.schema(spark.createDataFrame([], stale.CHANGE).schema).parquet(f"{tmp_path}/in"), late="5 seconds")
    query = found.writeStream.foreachBatch(lambda df, _: df.collect()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) < 100


def test_timers_by_the_clock(spark, tmp_path):
    now = int(time.time())
    got = told(spark, str(tmp_path), [[change(1, now, started=now - 40), change(2, now, started=now - 40, progress=1), change(3, now, started=now + 1000)]])
    assert [u for u, _ in got] == [1] and now <= got[0][1] <= now + 120


def test_an_empty_stream_of_changes(spark, tmp_path):
    assert told(spark, str(tmp_path), [[]], late="5 seconds") == []


# ------------------------------------------------------------------ the queue
def queued_rows(n, start=0, at=NOW):
    draw = random.Random(n)
    return [{"uid": start + i, "status": QUEUED if i % 4 else 1, "deleted": i % 9 == 2, "queued_at": at + draw.randrange(20), "crdate": draw.randrange(3), "title": None if i == 5 else f"r{i}"} for i in range(n)]


def wanted(rows):
    return [r["uid"] for r in sorted((r for r in rows if r["status"] == QUEUED and not r["deleted"]), key=lambda r: (r["queued_at"], r["crdate"], r["uid"]))]


def worker(spark, path, name, folder, seen, size=5, fail_at=None):
    def step(df, epoch):
        rows = [(r.ticket, r.uid) for r in df.collect()]
        if fail_at is not None and len(seen) >= fail_at:
            raise OSError("lost")
        seen.append(rows)

    return report_queue.taken(spark, path, name, size).writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/{name}").start()


def test_two_workers_take_each_report_once_over_a_restart(spark, tmp_path):
    path, rows = str(tmp_path / "queue"), queued_rows(70)
    report_queue.enqueue(report_rows(spark, rows), path)
    a, b = [], []
    with pytest.raises(StreamingQueryException, match="lost"):
        query = worker(spark, path, "a", tmp_path, a, fail_at=2)
        query.processAllAvailable()
    other = worker(spark, path, "b", tmp_path, b)
    back = worker(spark, path, "a", tmp_path, a, size=7)  # goes on with what it had claimed
    for q in (other, back):
        q.processAllAvailable()
    later = queued_rows(40, start=1000, at=NOW - 500)  # these come last all the same
    report_queue.enqueue(report_rows(spark, later), path)
    for q in (other, back):
        q.processAllAvailable()
        q.stop()
    got = sorted(x for batch in a + b for x in batch)
    assert [t for t, _ in got] == list(range(len(got)))
    assert [u for _, u in got] == wanted(rows) + wanted(later)
    assert all(sorted(batch) == batch for batch in a + b) and a


def test_claims_of_many_threads_do_not_overlap(tmp_path):
    queue = report_queue.Queue(str(tmp_path))
    queue.append("s", [["f1", 1, 300], ["f2", 301, 500]])
    queue.append("t", [["g", 1, 100]])

    def take(name):
        own = report_queue.Queue(str(tmp_path))
        while own.claims.last() == 0 or own.claims.read(own.claims.last())["to"] < 600:
            own.claim(name, 3)

    threads = [threading.Thread(target=take, args=(f"w{i}",)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = queue.claims.last()
    claims = [queue.claims.read(n) for n in range(1, last + 1)]
    assert [c["from"] for c in claims] == [0, *(c["to"] for c in claims[:-1])] and claims[-1]["to"] == 600
    slices = [s for w in {c["worker"] for c in claims} for s in queue.slices(w, 0, last)]
    assert sorted(s.before + p - 1 for s in slices for p in range(s.low, s.high + 1)) == list(range(600))
    assert queue.claim("w0", 5) == max(n for n, c in enumerate(claims, 1) if c["worker"] == "w0") if any(c["worker"] == "w0" for c in claims) else True


def test_an_empty_queue_and_stores_without_links(spark, tmp_path):
    path, seen = str(tmp_path / "queue"), []
    report_queue.enqueue(report_rows(spark, [{"uid": 1, "status": 2}]), path)
    assert report_queue.Queue(path).size() == 0
    query = worker(spark, path, "a", tmp_path, seen)
    query.processAllAvailable()
    query.stop()
    assert [r for batch in seen for r in batch] == []
    with pytest.raises(ValueError, match="mounted"):
        report_queue.Queue("s3://bucket/queue")
