"""Links of index pages, and the fan-out of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import LABEL, MONTHS, YEAR_IN_URL, YEAR_TAGS, YEAR_TEXT, anchors_of, url_join

MONTH_PLACES = ("#content", "body")
DECISION_PLACES = ("#content", "div.content", "div.inner", "body")


def month_links(pages: DataFrame, page: str, html: str, root: str) -> DataFrame:
    """(page, month_key, url, first_pos): of equal keys the last link counts, at the first one's position.

    A link without a year in its address takes the last year heading above it on its page.
    """
    rows = pages.select(F.col(page).alias("page"), F.explode(anchors_of(html, MONTH_PLACES)).alias("a")).select("page", "a.*")
    heading = F.when(F.col("tag").isin(*YEAR_TAGS) & F.col("text").rlike(rf"\A{YEAR_TEXT}\z"), F.col("text"))
    above = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("year", F.last(heading, ignorenulls=True).over(above))
    rows = rows.where((F.col("tag") == "a") & (F.col("href") != "") & F.col("text").isin(*MONTHS)).withColumn("url", url_join("href", root))
    year = F.coalesce(F.nullif(F.regexp_extract("url", YEAR_IN_URL, 1), F.lit("")), F.col("year"), F.lit("unknown"))
    rows = rows.withColumn("month_key", F.concat_ws("-", year, "text"))
    return rows.groupBy("page", "month_key").agg(F.max_by("url", "pos").alias("url"), F.min("pos").alias("first_pos"))


def decision_links(pages: DataFrame, page: str, html: str, root: str) -> DataFrame:
    """(page, url, first_pos) of the links whose label looks like a case number, each address once."""
    rows = pages.select(F.col(page).alias("page"), F.explode(anchors_of(html, DECISION_PLACES, " ")).alias("a")).select("page", "a.*")
    rows = rows.where((F.col("tag") == "a") & (F.col("text") != "") & ~F.col("text").isin(*MONTHS) & ~F.contains(F.lower("href"), F.lit("printer")) & F.col("text").rlike(LABEL))
    return ordered_distinct(rows.withColumn("url", url_join("href", root)), ["page"], "url", "pos")


def ordered_distinct(rows: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """Each value once, at its first position."""
    return rows.groupBy(*by, value).agg(F.min(pos).alias("first_pos"))


def cap(rows: DataFrame, by: list[str], pos: str, most: int | None) -> DataFrame:
    """At most `most` rows of each group, by position; all of them without a limit."""
    if most is None:
        return rows
    return rows.withColumn("tq_rank", F.row_number().over(Window.partitionBy(*by).orderBy(pos))).where(F.col("tq_rank") <= most).drop("tq_rank")


def fan_out(months: DataFrame, decisions: DataFrame, most: int | None = None) -> DataFrame:
    """(year, month, url, pos) of all decisions of all months. months: (month_key, url); decisions: (page, url, first_pos), page being a month's url."""
    rows = months.select("month_key", F.col("url").alias("page")).join(decisions, "page")
    parts = F.split("month_key", "-")
    rows = rows.select(parts[0].alias("year"), parts[1].alias("month"), "url", F.col("first_pos").alias("pos"))
    return cap(rows, ["year", "month"], "pos", most)
