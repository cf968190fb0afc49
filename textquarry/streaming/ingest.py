"""Records as they arrive: chunked, stored and embedded in micro-batches, resumed from a checkpoint."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import division_cut
from ..operators.chunker import rag_chunks
from ..operators.embed import Embedder
from ..operators.resume import cursor, resume_after, write_cursor
from ..operators.store import Store, rejects
from ..sources.records import CORRUPT, RECORD, read_jsonl, usable
from ..sources.stream import RecordStream
from ..sources.tables import Observed

log = logging.getLogger(__name__)


def stored_chunks(records: DataFrame, clean: bool = True) -> DataFrame:
    """Chunks of records with their ingest order `seq`: that of the records (their seq, else their address), section, chunk."""
    text, first = division_cut("text") if clean else F.col("text"), "seq" if "seq" in records.columns else "url"
    rows = rag_chunks(records.select("url", F.col(first).alias("record"), text.alias("text")))
    return rows.withColumn("seq", F.struct("record", "section_pos", "chunk_index"))


def ingest(store: Store, records: DataFrame, make: Callable[[], Embedder] | None = None, rejected: str | None = None) -> dict[str, int]:
    """One batch. Documents without a case number go to `rejected`, where they can be taken up again. Returns the numbers of chunks and of those without a case number."""
    figures = {"chunks": F.count(F.lit(1)), "rejected": F.count_if(F.col("case_no").isNull())}
    with Observed(stored_chunks(usable(records)), "chunks", **figures) as done:
        store.ingest(done.table, make=make)
        if rejected and done.figures["rejected"]:
            rejects(done.table).select("url").distinct().write.mode("append").json(rejected)
        log.info("%(chunks)d chunks, %(rejected)d of them without a case number", done.figures)
        return done.figures


def ingest_file(store: Store, path: str, cursor_path: str, make: Callable[[], Embedder] | None = None, rejected: str | None = None) -> dict[str, int]:
    """A JSON-lines file from after the cursor on: cleaned, cut, stored and embedded, then the cursor moved to its last record.

    Records follow each other as they lie in the file. A run that failed changes
    nothing before the commit, and runs again from the same cursor; what is stored
    already stays as it is. Returns the numbers of records, unusable lines, chunks and chunks without a case number.
    """
    spark = store.spark
    place = ("_metadata.file_path", "_metadata.file_block_start")
    rows = read_jsonl(spark, path).select("*", F.struct(*(F.col(c) for c in place), F.monotonically_increasing_id().alias("at")).alias("seq"))
    good = F.col(CORRUPT).isNull()
    figures = {"records": F.count_if(good), "unusable": F.count_if(~good), "url": F.max_by("url", F.when(good, F.col("seq")))}
    with Observed(resume_after(rows, cursor(spark, cursor_path)), "records", **figures) as read:
        url, told = read.figures.pop("url"), read.figures
        done = {"chunks": 0, "rejected": 0}
        if told["records"]:
            done = ingest(store, read.table.where(good), make, rejected)
            write_cursor(spark, cursor_path, url)
        log.info("%(records)d records, %(unusable)d unusable lines", told)
        return told | done


def stream(spark: SparkSession, source: str, store: Store, checkpoint: str, make: Callable[[], Embedder] | None = None, rejected: str | None = None) -> StreamingQuery:
    """Takes in all new files under source once, then stops; a run that failed goes on where it was.

    A batch that runs again changes nothing: decisions merge to the same values, and a chunk that is stored stays.
    """
    records = spark.readStream.schema(RECORD).json(source)
    write = records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return write.foreachBatch(lambda batch, _: ingest(store, batch, make, rejected) and None).start()


def stream_records(spark: SparkSession, source: str, store: Store, checkpoint: str, progress: str, make: Callable[[], Embedder] | None = None, rejected: str | None = None, unusable: str | None = None, most_bytes: int | None = None, seconds: float | None = None, growing: bool = False) -> StreamingQuery:
    """The same from offsets in bytes: batches of at most `most_bytes`, in the order of files and lines, no record met by its address.

    With `seconds` a batch starts that often until the query is stopped; without, one
    run takes what is there (or one batch of `most_bytes`). Lines that can't be
    used go to `unusable` as (file, at, line), a folder a batch, so that a batch that
    runs again writes its own folder again.
    """
    spark.dataSource.register(RecordStream)
    options = {"path": source, "progress": progress, "growing": str(growing).lower()} | ({"maxBytes": str(most_bytes)} if most_bytes else {})
    rows = spark.readStream.format("record_stream").options(**options).load()

    def take(batch: DataFrame, number: int) -> None:
        if unusable:
            batch.where(F.col(CORRUPT).isNotNull()).select("file", "at", F.col(CORRUPT).alias("line")).write.mode("overwrite").json(f"{unusable}/batch={number}")
        ingest(store, batch.withColumn("seq", F.struct("file", "at")), make, rejected)

    write = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (write.trigger(processingTime=f"{seconds} seconds") if seconds else write.trigger(availableNow=True)).start()


def new_urls(spark: SparkSession, source: str, watermark: str | None = None) -> DataFrame:
    """Addresses of a stream of records, each once.

    With a watermark ("7 days") an address is remembered for that time after the file
    that brought it was changed, which bounds the state; without one, for good.
    """
    rows = spark.readStream.schema(RECORD).json(source).select("url", F.col("_metadata.file_modification_time").alias("seen"))
    if watermark:
        return rows.withWatermark("seen", watermark).dropDuplicatesWithinWatermark(["url"]).select("url")
    return rows.select("url").dropDuplicates(["url"])
