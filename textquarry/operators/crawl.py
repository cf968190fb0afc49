"""A crawl as joins: index page, month pages, decision pages, records."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import text_of, url_key
from ..sources.records import fetched
from ..sources.sink import CrawlLog, committed
from ..sources.tables import written_table
from .links import decision_links, fan_out, month_links
from .resume import skip_done

RECORD = ["year", "month", "title", "url", "text"]
log = logging.getLogger(__name__)


def frontier(pages: DataFrame, index_url: str, root: str, most: int | None = None) -> DataFrame:
    """(year, month, url, pos) of all decisions that the index page leads to. pages: (url, html)."""
    index = pages.where(F.col("url") == index_url)
    months = month_links(index, "url", "html", root).select("month_key", "url")
    found = decision_links(pages.join(months.select("url").distinct(), "url", "left_semi"), "url", "html", root)
    return fan_out(months, found, most)


def crawled(todo: DataFrame, pages: DataFrame) -> DataFrame:
    """Records of the addresses (year, month, url) whose page is there."""
    fresh = todo.select("year", "month", "url").join(pages.select("url", "html").where("html is not null"), "url").withColumn("p", text_of("html"))
    return fresh.select("year", "month", F.col("p.title").alias("title"), "url", F.col("p.text").alias("text"))


def crawl(pages: DataFrame, index_url: str, root: str, done: DataFrame | None = None, cache: DataFrame | None = None, stored: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Records (year, month, title, url, text) of the decisions, and those stored before.

    pages: (url, html), html null where a page couldn't be had: its decision is
    left out and met again by the next crawl. done: (url) of decisions that are
    stored already. cache: (url_key, year, month, title, url, text), which spares
    the page.
    """
    todo = frontier(pages, index_url, root, most)
    todo = skip_done(todo, done) if done is not None else todo
    known = None
    if cache is not None:
        keyed = todo.withColumn("url_key", url_key("url"))
        known = keyed.select("url_key").join(cache.dropDuplicates(["url_key"]), "url_key").select(RECORD)
        todo = keyed.join(cache.select("url_key"), "url_key", "left_anti")
    out = crawled(todo, pages)
    for more in (known, stored):
        out = out if more is None else out.unionByName(more.select(RECORD))
    return out


def cache_of(records: DataFrame) -> DataFrame:
    return records.select(url_key("url").alias("url_key"), *RECORD)


def _there(pages: DataFrame) -> DataFrame:
    """pages whose absence ends the crawl, written once."""
    told = F.raise_error(F.concat(F.lit("no page at "), "url", F.lit(": "), "error")).cast("string")
    return written_table(pages.select("url", F.when(F.col("error").isNull(), F.col("html")).otherwise(told).alias("html")), "crawl-pages")


def crawl_site(spark: SparkSession, index_url: str, root: str, folder: str, fetch: Callable[[DataFrame], DataFrame] = fetched, most: int | None = None, commits: int = 1) -> DataFrame:
    """Records of a site's decisions, of this crawl and of earlier ones in the same folder. Fetches only what it hasn't yet.

    The folder is a `CrawlLog`: what a part of the crawl had and what it couldn't
    have are committed together, and the next crawl tries the latter again. An index
    or month page that can't be had is an error. Pages are committed in `commits`
    parts by address, so that a crawl that ends early keeps those before.
    """
    index = _there(fetch(spark.createDataFrame([(index_url,)], "url string")))
    months = written_table(month_links(index, "url", "html", root).select("month_key", "url"), "crawl-months")
    listed = decision_links(_there(fetch(months.select("url"))), "url", "html", root)
    every = written_table(fan_out(months, listed, most), "crawl-todo")
    for r in every.groupBy("year", "month").count().orderBy("year", "month").toLocalIterator():
        log.info("%s %s: %d candidates", r.year, r.month, r["count"])
    log_ = CrawlLog(spark, folder)
    for part in range(commits):
        todo = skip_done(every.where(F.pmod(F.xxhash64("url"), F.lit(commits)) == part), log_.done)
        # One address met in several months is one record, of its first month.
        todo = todo.groupBy("url").agg(F.min(F.struct("year", "month")).alias("at")).select("url", "at.*")
        pages = written_table(fetch(todo), "crawl-pages")
        lost = pages.where("html is null").select(*(F.col(c) if c == "url" else F.lit(None).cast("string").alias(c) for c in RECORD), F.coalesce("error", F.lit("no page")).alias("error"))
        log_ = committed(crawled(todo, pages).withColumn("error", F.lit(None).cast("string")).unionByName(lost), folder)
        log.info("part %d of %d: %d pages, %d failed", part + 1, commits, *pages.agg(F.count("html"), F.count("error")).first())
    return log_.records.select(RECORD)
