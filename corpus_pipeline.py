"""The corpus pipeline: five operators, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written and read again as the next one's docs. All but the last return the
columns of `documents`. No stage's result is expressible in SQL as a whole (the
first is a trained model), so ORACLE_SQL is None and the tests compare the
stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm import decontam, mixing, neardup, secrets, toxicity
from textquarry.llm.common import Scratch, free, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold."""
    machine, score = toxicity.learned(docs, read(spark, sf_dir, "labels")), free(docs, "score")
    return toxicity.toxicity(docs, machine, out=score).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, and rows without an id.

    Rows with one id are one document: it stays or goes with all its texts. Of
    the one that stays, each different text stays once.
    """
    marked = neardup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept")
    marked = written(marked, "marked")  # what goes, and ids that repeat
    single = docs.join(marked.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = docs.join(marked.where("kept").select("doc_id"), "doc_id", "left_semi")
    number = free(docs, "number")
    row = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns)))
    return single.unionAll(again.withColumn(number, row).where(F.col(number) == 1).select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = free(docs, "found")
    return decontam.decontamination(docs, read(spark, sf_dir, "benchmark"), out=found).where(~F.col(f"{found}.contaminated")).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    name = free(docs, "found")
    found = secrets.secrets(docs, out=name, redact=True)
    changed = {"text": F.col(f"{name}.redacted"), "n_chars": F.when(F.col(f"{name}.spans") != "", F.length(f"{name}.redacted")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
    return found.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with its number of words (tq_size) and the copy's number (tq_copy)."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("neardup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.__exit__()  # the next stage's table is whole
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
