"""What is current of a folder of files: numbered manifests, of which the last counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Manifested:
    """Manifests under path/manifests. A number belongs to whoever renames a file to it first; readers keep what their manifest names."""

    #: Commits that meet another try again so often.
    TRIES = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _empty(self) -> dict:
        raise NotImplementedError

    def _manifests(self) -> list[int]:
        top = self.Path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit())

    def _manifest(self, number: int | None = None) -> dict:
        """The current manifest, or that of a number; an empty one if there is none."""
        known = self._manifests()
        if number is None and not known:
            return {"number": -1, **self._empty()}
        number = known[-1] if number is None else number
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{number}.json").first()[0])

    def _named(self, change: Callable[[dict], dict]) -> dict:
        """The next manifest, which is the current one with what `change` makes of it; again from the new one where another commit was first."""
        for _ in range(self.TRIES):
            now = self._manifest()
            number = now["number"] + 1
            new = now | change(now) | {"number": number}
            part, whole = self.Path(f"{self.path}/manifests/.{number}-{uuid.uuid4().hex}"), self.Path(f"{self.path}/manifests/{number}.json")
            out = self.fs.create(part)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            if not self.fs.exists(whole) and self.fs.rename(part, whole):
                return new
            self.fs.delete(part, False)
        raise RuntimeError(f"{self.TRIES} other commits were first")
