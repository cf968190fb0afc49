"""JSON-lines records, done lists and cursors, and pages over HTTP."""

from __future__ import annotations

import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("year", "month", "title", "url", "text")])
CORRUPT = "_corrupt_record"
REQUIRED = ("title", "url", "text")


def read_jsonl(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """Records by a fixed schema. Tolerant: a line that isn't JSON is kept in _corrupt_record; else it is an error."""
    if not tolerant:
        return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*RECORD.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def usable(records: DataFrame) -> DataFrame:
    """Records that could be parsed, with empty year and month where they have none, and seq if they have it; a record without title, url or text is an error."""
    missing = F.raise_error(F.lit("a record lacks title, url or text")).cast("string")
    checked = {c: F.when(F.col(c).isNull(), missing).otherwise(F.col(c)) for c in REQUIRED}
    good = records.where(F.col(CORRUPT).isNull()) if CORRUPT in records.columns else records
    return good.select(F.coalesce("year", F.lit("")).alias("year"), F.coalesce("month", F.lit("")).alias("month"), *(x.alias(c) for c, x in checked.items()), *(["seq"] if "seq" in records.columns else []))


def parse_jsonl(lines: DataFrame, line: str = "value") -> DataFrame:
    """The same for lines that are a column already."""
    schema = T.StructType([*RECORD.fields, T.StructField(CORRUPT, T.StringType())])
    return lines.select("*", F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("tq_r")).select(*[c for c in lines.columns if c != line], "tq_r.*")


def write_jsonl(records: DataFrame, path: str) -> None:
    records.select([f.name for f in RECORD]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("url")).where("url <> ''")


def host(url: Column | str) -> Column:
    """The server of an address, in small letters; what stands before @ is left out."""
    return F.lower(F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


class Session:
    """One opener for all pages of a task, with its cookies and agent, and one pace for each host.

    A page has `tries` tries. A host is left alone for `delay` seconds after a page,
    `backoff` * i after try i has failed, or as long as it asks for (Retry-After, no
    longer than `patience`). Meanwhile the pages of other hosts have their turn.
    """

    def __init__(self, tries: int = 3, timeout: float = 20.0, delay: float = 1.0, backoff: float = 1.5, agent: str = "textquarry", patience: float = 600.0):
        self.tries, self.timeout, self.delay, self.backoff, self.patience = tries, timeout, delay, backoff, patience
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor())
        self.opener.addheaders = [("User-Agent", agent)]
        self.ready: dict[str, float] = {}

    def once(self, url: str, server: str, n: int) -> tuple[str | None, Exception | None]:
        """(page, error) of the n-th try, when the host is ready for it."""
        time.sleep(max(0.0, self.ready.get(server, 0.0) - time.monotonic()))
        pause = self.delay
        try:
            with self.opener.open(url, timeout=self.timeout) as got:
                return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace"), None
        except Exception as e:
            asked = getattr(e, "headers", None) and e.headers.get("Retry-After")
            pause = min(self.patience, float(asked)) if asked and asked.strip().isdigit() else self.backoff * n
            return None, e
        finally:
            self.ready[server] = time.monotonic() + pause

    def rows(self, urls: Iterable[str]) -> Iterator[tuple[str, str | None, str | None]]:
        """(url, page, error) of each address, in the order in which hosts are ready."""
        queues: dict[str, deque] = {}
        for url in urls:
            queues.setdefault(urlsplit(url).netloc.rpartition("@")[2].lower(), deque()).append((url, 1))
        turns = [(self.ready.get(h, 0.0), h) for h in queues]
        heapify(turns)
        while turns:
            _, h = heappop(turns)
            url, n = queues[h].popleft()
            page, error = self.once(url, h, n)
            if error is not None and n < self.tries:
                queues[h].appendleft((url, n + 1))
            else:
                yield url, page, None if error is None else str(error) or type(error).__name__
            if queues[h]:
                heappush(turns, (self.ready[h], h))


def fetched(addresses: DataFrame, url: str = "url", tasks: int | None = None, make: Callable[[], Session] = Session) -> DataFrame:
    """(url, html, error) of the addresses of a DataFrame, each once; html is null where all tries failed.

    Addresses are dealt by host over `tasks` tasks (one a core by default), so that
    one task keeps a host's pace whatever their number, and mixed within the task, so
    that its hosts take turns. Each has a session of its own, and a page leaves its
    task as soon as it is there. A lost task fetches its own addresses again and no others.
    """
    tasks = tasks or addresses.sparkSession.sparkContext.defaultParallelism
    rows = addresses.select(F.col(url).alias("url")).where("url <> ''").distinct()
    rows = rows.repartition(tasks, host("url")).sortWithinPartitions(F.xxhash64("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = make()
        for batch in batches:
            for row in session.rows(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["url", "html", "error"])

    return rows.mapInArrow(run, "url string, html string, error string")


class PageSource(DataSource):
    """`spark.read.format("pages").option("urls", "...")`: (url, html, error) of a few pages, some addresses to a task. `fetched` takes a DataFrame of them.

    Options: urls (one a line), tries (3), timeout (20 s), delay (1 s after each
    page), backoff (1.5 s times the try), perTask (50), agent.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> "PageReader":
        return PageReader(dict(self.options))


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d: options.get(k, options.get(k.lower(), d))
        self.urls = [u for u in get("urls", "").split("\n") if u]
        self.how = {"tries": int(get("tries", 3)), "timeout": float(get("timeout", 20)), "delay": float(get("delay", 1)), "backoff": float(get("backoff", 1.5)), "agent": get("agent", "textquarry")}
        self.per_task = int(get("perTask", 50))

    def partitions(self) -> list[Urls]:
        return [Urls(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)] or [Urls([])]

    def read(self, partition: Urls) -> Iterator[tuple]:
        yield from Session(**self.how).rows(partition.urls)
