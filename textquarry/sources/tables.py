"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. A folder of our own only where the master is local and none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch path and read again, so that its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Observed:
    """df written once to a scratch path, with figures that Spark gathers while it writes; `with` deletes the table at its end.

    What a step needs several times is computed once, its lineage ends, and no
    executor's memory holds it.
    """

    def __init__(self, df: DataFrame, name: str, **figures: Column):
        from pyspark.sql import Observation

        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        seen = Observation(name)
        df.observe(seen, *(v.alias(k) for k, v in figures.items())).write.parquet(self.path)
        self.figures = seen.get
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def __enter__(self) -> "Observed":
        return self

    def __exit__(self, *_) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
