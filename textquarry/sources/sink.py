"""The pages of a crawl, kept under one commit a write: records, done addresses and failures appear together.

    spark.dataSource.register(CrawlSink)
    rows.write.format("crawl_commit").option("folder", folder).mode("append").save()

rows: year, month, title, url, text, error; a row with an error is an address that
couldn't be had. A task writes one file under folder/files, with a name of its own,
and tells the driver that name. When all tasks are through, the driver writes one
list of them and renames it into folder/commits; only what a list names is ever
read. So a task that fails or runs twice, or a driver that dies at any moment,
leaves either all of a write or nothing of it, and two writers don't meet. Files
that no list names are `leftovers`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .records import RECORD
from .stream import opened

COLUMNS = [f.name for f in RECORD]
FILE = pa.schema([(c, pa.string()) for c in [*COLUMNS, "error"]] + [("tried", pa.int64())])
ROW = ", ".join(f"{f.name} {'long' if f.name == 'tried' else 'string'}" for f in FILE)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    records: int
    failed: int


class CrawlSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_commit"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in [*COLUMNS, "error"])

    def writer(self, schema, overwrite: bool) -> "CrawlWriter":
        if overwrite:
            raise ValueError("a crawl is appended to")
        missing = {*COLUMNS, "error"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return CrawlWriter(self.options["folder"])


class CrawlWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        files, top = opened(self.folder)
        name, out, records, failed = f"{uuid.uuid4().hex}.parquet", None, 0, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(f"{top}/files", recursive=True)
                out = pq.ParquetWriter(f"{top}/files/{name}", FILE, filesystem=files, compression="zstd")
            error = batch.column("error")
            tried = pa.array([time.time_ns()] * batch.num_rows, pa.int64())
            out.write_batch(pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.string()) for c in [*COLUMNS, "error"]), tried], schema=FILE))
            records, failed = records + error.null_count, failed + len(error) - error.null_count
        if out is None:
            return Written(None, 0, 0)
        out.close()
        return Written(name, records, failed)

    def commit(self, messages: list[Written | None]) -> None:
        named = [m for m in messages if m and m.file]
        if not named:
            return
        files, top = opened(self.folder)
        files.create_dir(f"{top}/commits", recursive=True)
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{top}/commits/.{name}") as out:
            out.write(json.dumps({"files": [m.file for m in named], "records": sum(m.records for m in named), "failed": sum(m.failed for m in named)}).encode())
        files.move(f"{top}/commits/.{name}", f"{top}/commits/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, top = opened(self.folder)
        for m in messages:
            if m and m.file:
                files.delete_file(f"{top}/files/{m.file}")


def _names(folder: str, part: str) -> list[str]:
    from pyarrow import fs

    files, top = opened(folder)
    found = files.get_file_info(fs.FileSelector(f"{top}/{part}", allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "._")


class CrawlLog:
    """What the commits of a folder hold, as of now.

    An entry is one address; where one address may stand for several pages, `key`
    names the columns that tell entries apart.
    """

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...] = ("url",)):
        self.folder, self.key = folder.rstrip("/"), key
        commits = [f"{self.folder}/commits/{n}" for n in _names(folder, "commits")]
        # No more names than there were tasks.
        self.files = [r.f for r in spark.read.schema("files array<string>").json(commits).select(F.explode("files").alias("f")).collect()] if commits else []
        self.rows = spark.read.schema(ROW).parquet(*(f"{self.folder}/files/{f}" for f in self.files)) if self.files else spark.createDataFrame([], ROW)

    @property
    def records(self) -> DataFrame:
        """Each entry once, as it was had first."""
        rows = self.rows.where("error is null")
        return rows.groupBy(*self.key).agg(F.min_by(F.struct(*COLUMNS), "tried").alias("r")).select("r.*")

    @property
    def done(self) -> DataFrame:
        return self.rows.where("error is null").select(*self.key).distinct()

    @property
    def failed(self) -> DataFrame:
        """(url, error): the last error of each entry that was never had."""
        last = self.rows.groupBy(*self.key).agg(F.count_if(F.col("error").isNull()).alias("had"), F.max_by("error", "tried").alias("error"))
        return last.where("had = 0").select(*self.key, "error")

    def leftovers(self, delete: bool = False) -> list[str]:
        """Files that no commit names; they may be deleted while no write runs."""
        files, top = opened(self.folder)
        found = sorted(set(_names(self.folder, "files")) - set(self.files))
        for name in found if delete else []:
            files.delete_file(f"{top}/files/{name}")
        return found


def committed(rows: DataFrame, folder: str, key: tuple[str, ...] = ("url",)) -> CrawlLog:
    """rows written to the folder under one commit, and the log with it."""
    rows.sparkSession.dataSource.register(CrawlSink)
    rows.select(*COLUMNS, "error").write.format("crawl_commit").option("folder", folder).mode("append").save()
    return CrawlLog(rows.sparkSession, folder, key)
