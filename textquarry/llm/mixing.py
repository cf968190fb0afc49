"""Mixing sources to target weights by systematic sampling.

All documents of a source have the same number of expected copies: the source's
target over its size in words. Within a source the documents stand in one fixed
order; the prefix sum of their expected copies is their rank times that number.
One random offset is added for each source, and a document is emitted once for
each integer boundary that its interval crosses. The order is by size, so the
words taken differ from the target by about one document's size.

Ranks need no sort of a whole source: documents fall into cells of a source
(size class, then a digest of the id); the number of rows before a cell comes
from the small table of cell counts, and only the rank within a cell from a
window. A hot source spreads over all its cells.

Null texts have size 0; null sources are one source, the last. A source whose
sizes are all 0 has target 0 and takes nothing. Equal rows are ranked each for
itself. Everything is a function of the rows, so reruns agree. The number of cells
doubles with the table, so that a cell, the one task of a window, stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free, read, written

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Digest cells of each size class at least, and rows of the table for each of them: their number doubles with the table.
CELLS, CELL_ROWS = 64, 1_000_000
SEED = "mix-1"


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of a digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(by: DataFrame) -> DataFrame:
    """(tq_source, tq_source_size) with tq_target: shares by weight, stopped at MOST_COPIES times the source's size, the excess shared again.

    In order of cap over weight the sources that are stopped come first. With
    the first k stopped, the others get (total - their caps) / weight left for
    each unit of weight; the first k at which the next source stays within its
    cap gives the level for all that are left. One row a source: its windows
    stand over a table of aggregates.
    """
    number = F.row_number().over(Window.orderBy("tq_source")) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.pmod(number, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    by = by.withColumn("w", weight).withColumn("cap", F.col("tq_source_size") * MOST_COPIES).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "tq_source")
    stopped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("tq_source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("level", (total - stopped).cast("double") / left)
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("tq_source", "tq_source_size", F.least(F.col("cap").cast("double"), level * F.col("w")).alias("tq_target"))


def mixture(docs: DataFrame, size: Column, source: str = "source", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """docs with tq_size, tq_source_size, tq_target and tq_copies, the times that the mix takes the document.

    The caller's columns travel in one struct, so none can clash with those used here; where
    docs has a column of an output's name, the output gets underscores.
    """
    names = [free(docs, c) for c in ("tq_size", "tq_source_size", "tq_target", "tq_copies")]
    cells_of = CELLS * (1 << max(0, (docs.count() - 1) // (CELLS * CELL_ROWS)).bit_length())
    bits = F.length(F.bin("tq_size"))
    docs = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        size.alias("tq_size"),
        F.coalesce(F.concat(F.lit("a"), F.col(source).cast("string")), F.lit("b")).alias("tq_source"),  # by code point, null last
        (F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % cells_of).alias("tq_cell"),
    ).withColumn("tq_class", (bits * 8 + F.floor(F.col("tq_size") * 8 / F.pow(F.lit(2.0), bits - 1))).cast("int"))  # eight to a doubling
    key = ["tq_source", "tq_class", "tq_cell"]
    # Written, since both the targets and the ranks need it: the texts are read once for it.
    cells = written(docs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("tq_size").alias("words")), "cells")
    goal = targets(cells.groupBy("tq_source").agg(F.sum("words").alias("tq_source_size")))
    before = F.sum("n").over(Window.partitionBy("tq_source").orderBy("tq_class", "tq_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("tq_before", F.coalesce(before, F.lit(0))).drop("n", "words").join(goal, "tq_source")
    # Rows that also agree in the last digest are equal in all that is mixed.
    order = ["tq_size", F.col(f"row.{doc_id}").asc_nulls_first(), F.xxhash64("row")]
    docs = docs.withColumn("tq_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(cells, key)
    each = F.least(F.lit(float(MOST_COPIES)), F.coalesce(F.try_divide("tq_target", "tq_source_size"), F.lit(0.0)))
    offset = _unit(F.concat(F.lit(seed + ":"), F.col("tq_source")))
    upto = F.col("tq_before") + F.col("tq_rank")
    copies = F.least(F.floor(offset + upto * each) - F.floor(offset + (upto - 1) * each), F.lit(MOST_COPIES)).cast("long")
    made = (F.col("tq_size"), F.col("tq_source_size"), F.col("tq_target"), copies)
    return docs.select("row.*", *(c.alias(n) for c, n in zip(made, names)))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its tq_size, numbered by tq_copy from 1."""
    size, copies, number = free(docs, "tq_size"), free(docs, "tq_copies"), free(docs, "tq_copy")
    got = mixture(docs, size_of(text), source, doc_id, seed).where(F.col(copies) > 0)
    return got.select(*(f"`{c}`" for c in docs.columns), size, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(number))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = written(docs.select("doc_id", "source", size_of("text").alias("size")), "sizes")
    got = mixture(docs, F.col("size"))
    return got.select("doc_id", "source", "size", F.col("tq_source_size").alias("source_size"), F.col("tq_target").alias("target"), (F.col("tq_copies") * F.col("size")).alias("taken"))


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
             coalesce('a' || source, 'b') as s, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % 64 as cell from documents), -- 64 cells up to 64 million rows
e as (select *, length(bin(size)) * 8 + floor(size * 8 / pow(2.0, length(bin(size)) - 1))::int as class from d),
t as (select s, sum(size)::bigint as source_size from d group by s),
n as (select *, ((row_number() over (order by s) - 1) % 3 + 1)::bigint as w, source_size * 3 as cap from t),
o as (select *, cap / w as ratio from n),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, s rows between unbounded preceding and 1 preceding), 0))::double
             / sum(w) over (order by ratio, s rows between current row and unbounded following) as level from o),
v as (select min_by(level, (ratio, s)) filter (where level <= ratio) as level from l),
g as (select s, source_size, least(cap::double, v.level * w) as target from l, v),
r as (select doc_id, source, size, source_size, target, row_number() over (partition by s order by class, cell, size, doc_id nulls first) as k,
        ('0x' || substr(md5('mix-1:' || s), 1, 8))::bigint / 4294967296.0::double as u,
        least(3.0::double, case when source_size = 0 then 0 else target / source_size end) as each from e join g using (s))
select doc_id, source, size, source_size, target, (least(floor(u + k * each) - floor(u + (k - 1) * each), 3)::bigint * size)::bigint as taken from r
"""
