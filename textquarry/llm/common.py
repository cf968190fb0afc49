"""What the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word patterns: U+0020 and U+0009 to U+000D. bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    """The session with settings changed for what runs inside, and as it was afterwards."""
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches are cut by bytes, so that a run of very long texts doesn't fill a worker.

    It stays set: what the operators return is run later, and would lose it otherwise.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as spark.checkpoint.dir or the context names it.

    One of our own only where the master is local and none is set, as in tests: on
    a cluster no executor could read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver collects its garbage, which may otherwise be long after."""
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables in the shared folder that a step needs for a while; `with` deletes them at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def folder(self, name: str) -> str:
        self.paths.append(scratch(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.folder(name))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation.

    What a returned DataFrame reads has to stay; it lies in the checkpoint folder until
    that is emptied. All else is written through a Scratch.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(docs: DataFrame, name: str) -> str:
    """name, or with underscores added until docs has no such column: a caller's column is never overwritten."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; null ids count as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % by
