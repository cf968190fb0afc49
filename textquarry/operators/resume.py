"""What has been done already: done sets, caches and cursors as joins and positional filters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import url_key


def skip_done(rows: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def cache_lookup(rows: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    """rows with the cache's columns, by the digest of the address; null where nothing is cached."""
    return rows.withColumn("url_key", url_key(key)).join(cache, "url_key", "left")


def cursor(spark: SparkSession, path: str, key: str = "url") -> DataFrame:
    """The address in a cursor file, as one row; no row where there is no file or it can't be read as one."""
    try:
        rows = spark.read.schema(f"{key} string").json(path).where(f"{key} is not null").limit(1)
        return spark.createDataFrame(rows.collect(), rows.schema)  # one row at most
    except AnalysisException:
        return spark.createDataFrame([], f"{key} string")


def write_cursor(spark: SparkSession, path: str, value: str, key: str = "url") -> None:
    spark.createDataFrame([(value,)], f"{key} string").coalesce(1).write.mode("overwrite").json(path)


def resume_after(rows: DataFrame, cursor: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """Rows after the first one whose address is the cursor's.

    cursor has one row (key) or none. None: all rows; an address that doesn't
    occur: no row. The aggregates are of one row, whatever rows is.
    """
    at = rows.join(F.broadcast(cursor.select(key).limit(1)), key, "left_semi").agg(F.min(seq).alias("tq_at"))
    some = cursor.limit(1).agg(F.count(F.lit(1)).alias("tq_some"))
    state = at.crossJoin(some)
    return rows.crossJoin(F.broadcast(state)).where((F.col("tq_some") == 0) | (F.col(seq) > F.col("tq_at"))).drop("tq_at", "tq_some")
