"""One commit for what a crawl had and what it couldn't have, and the pace that a host is asked at."""

import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.sources import records
from textquarry.sources.sink import FILE, CrawlLog, CrawlSink, CrawlWriter, committed

ROWS = "year string, month string, title string, url string, text string, error string"


def rows(spark, *of):
    return spark.createDataFrame([("1996", "Jan", None if e else f"t{u}", u, None if e else f"x{u}", e) for u, e in of], ROWS)


def seen(log):
    return sorted(r.url for r in log.records.collect()), sorted(r.url for r in log.done.collect()), sorted(map(tuple, log.failed.collect()))


def batch(*of):
    return pa.RecordBatch.from_pydict({c: [None if c == "error" and not e else e if c == "error" else u for u, e in of] for c in FILE.names if c != "tried"}, schema=pa.schema([f for f in FILE if f.name != "tried"]))


def test_what_was_had_and_what_failed_appear_together(spark, tmp_path):
    folder = f"file://{tmp_path}/crawl"
    assert seen(CrawlLog(spark, folder)) == ([], [], [])
    assert seen(committed(rows(spark, ("a", None), ("b", "500"), ("c", "404")).repartition(3), folder)) == (["a"], ["a"], [("b", "500"), ("c", "404")])
    # b is had now; c fails in another way; a is met again and stays as it was.
    again = rows(spark, ("b", None), ("c", "410"), ("a", None)).withColumn("title", F.lit("later"))
    log = committed(again, folder)
    assert seen(log) == (["a", "b"], ["a", "b"], [("c", "410")])
    assert {r.url: r.title for r in log.records.collect()} == {"a": "ta", "b": "later"}
    before = len(log.files)
    assert len(committed(rows(spark).limit(0), folder).files) == before  # nothing to commit


def test_crashes_leave_all_or_nothing(spark, tmp_path):
    folder = f"{tmp_path}/crawl"
    committed(rows(spark, ("a", None)), folder)
    # A task that fails when others are through.
    bad = rows(spark, ("b", None), ("c", "500"), ("d", None)).repartition(3, "url").withColumn("title", F.when(F.col("url") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        committed(bad, folder)
    assert seen(CrawlLog(spark, folder)) == (["a"], ["a"], [])
    # A driver that dies when all tasks are through; then one that dies before its list has its name.
    left = CrawlWriter(folder).write(iter([batch(("e", None), ("f", "500"))]))
    assert (left.records, left.failed) == (1, 1) and seen(CrawlLog(spark, folder)) == (["a"], ["a"], [])
    (tmp_path / "crawl" / "commits" / ".1-x.json").write_text('{"files": ["' + left.file + '"]}')
    assert seen(CrawlLog(spark, folder)) == (["a"], ["a"], [])
    # A task that ran twice: one of its files is named.
    writer = CrawlWriter(folder)
    first, second = (writer.write(iter([batch(("g", None)), batch(), batch(("h", "500"))])) for _ in range(2))
    writer.commit([second, None])
    log = CrawlLog(spark, folder)
    assert seen(log) == (["a", "g"], ["a", "g"], [("h", "500")])
    assert set(log.leftovers()) >= {left.file, first.file} and second.file not in log.leftovers()
    log.leftovers(delete=True)
    assert seen(CrawlLog(spark, folder)) == seen(log) and CrawlLog(spark, folder).leftovers() == []
    writer.abort([writer.write(iter([batch(("i", None))])), None])
    assert CrawlLog(spark, folder).leftovers() == []


def test_columns_and_modes_that_dont_fit(spark, tmp_path):
    spark.dataSource.register(CrawlSink)
    with pytest.raises(Exception, match="no column error"):
        rows(spark, ("a", None)).drop("error").write.format("crawl_commit").option("folder", str(tmp_path)).mode("append").save()
    with pytest.raises(Exception, match="appended"):
        rows(spark, ("a", None)).write.format("crawl_commit").option("folder", str(tmp_path)).mode("overwrite").save()


@pytest.fixture
def server():
    asked, busy = [], {}

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.monotonic(), self.headers["Host"].split(":")[0], self.path))
            wait = busy.pop(self.path, None)
            self.send_response(503 if wait else 200)
            if wait:
                self.send_header("Retry-After", str(wait))
            self.end_headers()
            self.wfile.write(b"page")

        def log_message(self, *_):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    Thread(target=running.serve_forever, daemon=True).start()
    yield running.server_port, asked, busy
    running.shutdown()


def gaps(asked, host):
    at = sorted(t for t, h, _ in asked if h == host)
    return [b - a for a, b in zip(at, at[1:])]


def test_one_host_keeps_its_pace_over_eight_tasks(spark, server):
    port, asked, _ = server
    df = spark.createDataFrame([(f"http://127.0.0.1:{port}/{i}",) for i in range(7)] * 2, "url string").repartition(8)
    got = records.fetched(df, tasks=8, make=lambda: records.Session(delay=0.4)).collect()
    assert len(got) == len(asked) == 7 and all(r.html == "page" and r.error is None for r in got)
    assert min(gaps(asked, "127.0.0.1")) >= 0.4


def test_hosts_take_turns_in_one_task(spark, server):
    port, asked, _ = server
    hosts = [f"127.0.0.{i}" for i in range(1, 2)] + ["localhost"]
    began = time.monotonic()
    list(records.Session(delay=0.5).rows([f"http://{h}:{port}/{i}" for h in hosts for i in range(4)]))
    assert time.monotonic() - began < 2.8  # four pages of each at once, not eight in turn
    assert all(min(gaps(asked, h)) >= 0.5 for h in hosts)


def test_a_host_that_asks_to_wait(server):
    port, asked, busy = server
    busy["/a"] = 2
    session = records.Session(delay=0.1, backoff=0)
    got = list(session.rows([f"http://127.0.0.1:{port}/a", f"http://localhost:{port}/b"]))
    assert {u[-1]: (p, e) for u, p, e in got} == {"a": ("page", None), "b": ("page", None)}
    assert [u[-1] for u, _, _ in got] == ["b", "a"] and gaps(asked, "127.0.0.1")[0] >= 2
    assert records.Session(tries=1, patience=1).rows([]) is not None
    busy["/c"] = 5000
    short = records.Session(tries=2, delay=0, patience=0.2)
    assert next(short.rows([f"http://127.0.0.1:{port}/c"]))[1] == "page"


def test_host_of_an_address(spark):
    want = {"http://A.example:80/x": "a.example:80", "https://u:p@b.example?q": "b.example", "/d/1": "", "mailto:x@y": ""}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.h for r in df.select("u", records.host("u").alias("h")).collect()} == want


def test_pages_that_share_an_address_stay_apart_by_a_key(spark, tmp_path):
    folder, key = f"file://{tmp_path}/crawl", ("title", "url")
    pages = spark.createDataFrame([("1996", "Jan", t, "same", f"x{t}", e) for t, e in (("1", None), ("2", None), ("3", "503"), ("4", "503"))], ROWS)
    committed(pages, folder, key)
    log = committed(pages.where("title = '3'").withColumn("error", F.lit(None).cast("string")), folder, key)
    assert sorted(r.text for r in log.records.collect()) == ["x1", "x2", "x3"] and log.done.count() == 3
    assert [tuple(r) for r in log.failed.collect()] == [("4", "same", "503")]
    assert seen(CrawlLog(spark, folder)) == (["same"], ["same"], [])  # without a key an address is one entry


def test_crawl_commits_keeps_each_page_of_an_address(spark, tmp_path):
    from textquarry.plans import registry

    spark.createDataFrame([(i, "https://a.example/x" if i < 6 else f"https://a.example/{i}", f"<p>{i}") for i in range(12)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.crawl_commits(spark, str(tmp_path)).collect()
    assert len(got) == 12 and sum(r.url.endswith("/x") for r in got) == 6 and sum(r.error == "503" for r in got) == 2
