"""An inverted file that follows its table: rows are added to lists as they come, lists that grow too long are split.

The lists' centroids are learned once, on a bounded sample. After that a batch is
assigned in one pass and appended to the lists that it meets, by a commit of its own
(see `Manifested`); nothing that is there is written again. A removed row is a line
in a list of removals. A list that holds more than `SPLIT` times an equal share is
split: two centroids are learned within it, and its rows and those of the lists
around it are dealt anew.
Manifests keep, of each list, its files, rows and summed distances to its centroid,
so that `drift` tells how much worse new rows fit than the first ones did.

A query reads the files of its nearest lists only, with the columns that came with
the rows. How many lists it looks at (`probes`) is measured within a sample when the
lists are made, and again after a split.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine_distance
from .manifest import Manifested
from .search import K, LISTS, _matrix, exact, ivf_many, nearest_lists, sampled, trained_centroids, tuned_probes

#: A list of more than so many equal shares is split; lists of fewer rows than LEAST never are.
SPLIT, LEAST = 4, 1_000
#: Lists around a split one whose rows are dealt anew with it.
NEAR = 8
CENTROIDS = "list_id long, centroid array<double>"


class VectorIndex(Manifested):
    def __init__(self, spark: SparkSession, path: str, embedding: str = "embedding", key: str = "id"):
        super().__init__(spark, path)
        self.embedding, self.key = embedding, key

    def _empty(self) -> dict:
        return {"lists": {}, "removed": [], "probes": 1, "schema": None, "first": None}

    def create(self, rows: DataFrame, lists: int = LISTS, target: float = 0.95) -> "VectorIndex":
        """An index of rows (key, embedding, and what results are to show)."""
        learned = trained_centroids(rows, lists, embedding=self.embedding, key=self.key)
        probes = tuned_probes(rows, learned, target, embedding=self.embedding, key=self.key)
        found = {str(r.list_id): {"centroid": list(r.centroid), "files": [], "rows": 0, "far": 0.0} for r in learned.collect()}  # as many as there are lists
        self._named(lambda now: {**self._empty(), "lists": found, "probes": probes, "schema": rows.schema.json()})
        self.add(rows)
        self._named(lambda now: {"first": self._mean(now["lists"].values())})
        return self

    @staticmethod
    def _mean(lists) -> float | None:
        rows = sum(x["rows"] for x in lists)
        return sum(x["far"] for x in lists) / rows if rows else None

    def centroids(self, manifest: dict | None = None) -> DataFrame:
        lists = (manifest or self._manifest())["lists"]
        return self.spark.createDataFrame([(int(k), v["centroid"]) for k, v in lists.items()], CENTROIDS)

    def _write(self, rows: DataFrame, centroids: DataFrame) -> tuple[str, dict[str, tuple[int, float]]]:
        """rows dealt to their lists as a folder; (its name, rows and summed distances of each list in it)."""
        folder = uuid.uuid4().hex
        dealt = nearest_lists(rows, centroids, 1, self.embedding).join(F.broadcast(centroids), "list_id")  # a row for each list
        dealt = dealt.withColumn("tq_far", cosine_distance(self.embedding, "centroid")).drop("centroid")
        dealt.repartition("list_id", F.pmod(F.xxhash64(self.key), F.lit(8))).write.partitionBy("list_id").parquet(f"{self.path}/lists/{folder}")
        schema = T.StructType([*dealt.drop("list_id").schema.fields, T.StructField("list_id", T.LongType())])
        there = self.spark.read.schema(schema).parquet(f"{self.path}/lists/{folder}").groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tq_far"), F.lit(0.0)).alias("far"))
        return folder, {str(r.list_id): (r.n, r.far) for r in there.collect()}

    def add(self, rows: DataFrame, replace: bool = False) -> None:
        """A batch. With `replace` rows of the same keys that are there go."""
        now = self._manifest()
        rows = rows.where(F.col(self.embedding).isNotNull()).select(self._schema(now).names)
        folder, there = self._write(rows, self.centroids(now))
        gone = self._gone(rows) if replace and there else None

        def change(now: dict) -> dict:
            lists = {k: dict(v) for k, v in now["lists"].items()}
            for k, (n, far) in there.items():
                if k not in lists:
                    raise RuntimeError(f"list {k} was split by another commit")
                lists[k] |= {"files": [*lists[k]["files"], [folder, now["number"] + 1]], "rows": lists[k]["rows"] + n, "far": lists[k]["far"] + far}
            return {"lists": lists} | ({"removed": [*now["removed"], [gone, now["number"] + 1]]} if gone else {})

        if there:
            self._named(change)

    def _gone(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.select(self.key).distinct().write.parquet(f"{self.path}/removed/{folder}")
        return folder

    def remove(self, keys: DataFrame) -> None:
        gone = self._gone(keys)
        self._named(lambda now: {"removed": [*now["removed"], [gone, now["number"] + 1]]})

    @staticmethod
    def _schema(manifest: dict) -> T.StructType:
        import json

        return T.StructType.fromJson(json.loads(manifest["schema"]))

    def rows(self, lists: list[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of some lists, or all, with list_id; nothing but their files is read."""
        now = manifest or self._manifest()
        named = [(k, f, n) for k, v in now["lists"].items() if lists is None or k in lists for f, n in v["files"]]
        fields = [T.StructField(f.name, f.dataType) for f in self._schema(now)]
        if not named:
            return self.spark.createDataFrame([], T.StructType([*fields, T.StructField("list_id", T.LongType())]))
        df = self.spark.read.schema(T.StructType(fields)).parquet(*(f"{self.path}/lists/{f}/list_id={k}" for k, f, _ in named))
        place = F.col("_metadata.file_path")
        df = df.select(*(f.name for f in fields), F.regexp_extract(place, r"/list_id=([^/]+)/", 1).cast("long").alias("list_id"), F.regexp_extract(place, r"/lists/([^/]+)/list_id=", 1).alias("tq_folder"))
        if now["removed"]:
            numbers = {f: n for _, f, n in named}
            seq = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))[F.col("tq_folder")]
            gone = [self.spark.read.schema(T.StructType([f for f in fields if f.name == self.key])).parquet(f"{self.path}/removed/{f}").withColumn("tq_n", F.lit(n)) for f, n in now["removed"]]
            every = gone[0]
            for more in gone[1:]:
                every = every.unionByName(more)
            every = every.groupBy(F.col(self.key).alias("tq_key")).agg(F.max("tq_n").alias("tq_n"))
            df = df.join(every, (F.col(self.key) == F.col("tq_key")) & (seq < F.col("tq_n")), "left_anti")
        return df.drop("tq_folder")

    def search(self, query: list[float], k: int = K, probes: int | None = None) -> DataFrame:
        """The k nearest rows of the nearest lists, with distance and similarity."""
        now = self._manifest()
        keys = list(now["lists"])
        if not keys:
            return exact(self.rows([], now), query, k, self.embedding, self.key).drop("list_id")
        table, q = np.array([now["lists"][x]["centroid"] for x in keys], np.float64), np.array(query, np.float64)
        near = np.argsort(-(table @ q) / np.maximum(np.linalg.norm(table, axis=1), 1e-300), kind="stable")[: probes or now["probes"]]
        return exact(self.rows([keys[i] for i in near], now), query, k, self.embedding, self.key).drop("list_id")

    def search_many(self, queries: DataFrame, k: int = K, probes: int | None = None) -> DataFrame:
        """(query_id, id, distance, rank) for any number of queries (query_id, embedding)."""
        now = self._manifest()
        return ivf_many(self.rows(manifest=now), self.centroids(now), queries, k, probes or now["probes"], self.embedding, self.key)

    def drift(self) -> float:
        """The mean distance of all rows to their centroids over that of the first ones; 1 where nothing has changed."""
        now = self._manifest()
        mean = self._mean(now["lists"].values())
        return mean / now["first"] if mean and now["first"] else 1.0

    def split(self, target: float = 0.95, times: int = SPLIT, least: int = LEAST) -> int:
        """Lists that are too long are split in two; how many there were. Further calls split further.

        Rows of the NEAR lists around a split one may lie nearer to its halves than to
        their own centroid, so they are dealt anew with it. No other files are written.
        """
        now = self._manifest()
        lists = now["lists"]
        share = sum(v["rows"] for v in lists.values()) / max(1, len(lists))
        long = [k for k, v in lists.items() if v["rows"] > max(least, times * share)]
        if not long:
            return 0
        table = {k: v["centroid"] for k, v in lists.items() if k not in long}
        for k in long:
            halves = trained_centroids(self.rows([k], now).drop("list_id"), 2, embedding=self.embedding, key=self.key)
            table |= {str(r.list_id): list(r.centroid) for r in halves.collect()}
        keys = list(lists)
        unit = np.array([lists[k]["centroid"] for k in keys], np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        around = {keys[i] for k in long for i in np.argsort(-(unit @ unit[keys.index(k)]), kind="stable")[: NEAR + 1]} | set(long)
        centroids = self.spark.createDataFrame([(int(k), v) for k, v in table.items()], CENTROIDS)
        folder, there = self._write(self.rows(sorted(around), now).drop("list_id"), centroids)

        def change(now_: dict) -> dict:
            if any(now_["lists"].get(k) != lists[k] for k in around):
                raise RuntimeError("a list was changed by another commit")
            new = {k: now_["lists"].get(k, {}) for k in table}
            for k, centroid in table.items():
                old = {"files": [], "rows": 0, "far": 0.0} if k in around or not new[k] else new[k]
                n, far = there.get(k, (0, 0.0))
                # Removals that were applied don't apply again: the new files come after them.
                new[k] = {"centroid": centroid, "files": [*old["files"], *([[folder, now["number"]]] if n else [])], "rows": old["rows"] + n, "far": old["far"] + far}
            return {"lists": new}

        self._named(change)
        rows = sampled(self.rows().drop("list_id"), 5_000, self.embedding, self.key)
        probes = tuned_probes(rows, self.centroids(), target)
        self._named(lambda now: {"probes": max(now["probes"], probes)})
        return len(long)
