"""Decision and chunk tables: upsert, first write wins, keys, and versions of a table on files.

Spark tables on plain files have no keys, triggers or updates. The functions here are
the merges themselves; `Store` appends what a batch brings and merges when it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .embed import Embedder, embed_in_place
from .manifest import Manifested

DECISIONS = T.StructType([T.StructField(n, t, null) for n, t, null in (
    ("id", T.LongType(), False), ("case_no", T.StringType(), False), ("division", T.StringType(), True), ("title", T.StringType(), True),
    ("created_at", T.TimestampType(), True), ("updated_at", T.TimestampType(), True))])
CHUNKS = T.StructType([T.StructField(n, t, null) for n, t, null in (
    ("id", T.LongType(), False), ("decision_id", T.LongType(), False), ("case_no", T.StringType(), False), ("section", T.StringType(), True),
    ("chunk_index", T.IntegerType(), False), ("text", T.StringType(), False), ("token_count", T.IntegerType(), True),
    ("embedding", T.ArrayType(T.FloatType(), False), True), ("created_at", T.TimestampType(), True), ("updated_at", T.TimestampType(), True))])
CHUNK_KEY = ["case_no", "section", "chunk_index"]


def decision_id(case_no: Column | str) -> Column:
    """Ids are opaque: a digest of the key, equal in every run."""
    return F.xxhash64(case_no)


def chunk_id() -> Column:
    return F.xxhash64(*CHUNK_KEY)


def rejects(chunks: DataFrame) -> DataFrame:
    """Rows that no table takes, since they have no case number."""
    return chunks.where("case_no is null")


def decisions_of(chunks: DataFrame, seq: str | list[str] = "seq") -> DataFrame:
    """(case_no, division, title): for each case the last values that aren't null, in ingest order."""
    order = F.struct(*([seq] if isinstance(seq, str) else seq))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return chunks.where("case_no is not null").groupBy("case_no").agg(last("division"), last("title"))


def upsert_decisions(stored: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """stored with new merged in: new values that aren't null replace old ones; updated_at moves on what was met again."""
    now = F.current_timestamp() if now is None else now
    new = new.select(F.col("case_no"), F.col("division").alias("n_division"), F.col("title").alias("n_title"), F.lit(True).alias("n_new"))
    return stored.join(new, "case_no", "full").select(
        F.coalesce("id", decision_id("case_no")).alias("id"), "case_no",
        F.coalesce("n_division", "division").alias("division"), F.coalesce("n_title", "title").alias("title"),
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("n_new"), now).otherwise(F.col("updated_at")).alias("updated_at"))


def first_chunks(chunks: DataFrame, seq: str | list[str] = "seq", on_duplicate: str = "keep_first") -> DataFrame:
    """Of chunks with one key the first in ingest order; a null section equals none other. on_duplicate="error" fails instead."""
    rows = chunks.where("case_no is not null")
    order = [seq] if isinstance(seq, str) else seq
    # A row of a null section is a group of its own. A plain rank, since of such a one the tasks keep the first rows alone before the shuffle.
    rows = rows.withColumn("tq_own", F.when(F.col("section").isNull(), F.monotonically_increasing_id()))
    rows = rows.withColumn("tq_rank", F.row_number().over(Window.partitionBy(*CHUNK_KEY, "tq_own").orderBy(*order))).drop("tq_own")
    if on_duplicate == "error":
        told = F.raise_error(F.concat(F.lit("more than one chunk for "), F.concat_ws("/", *CHUNK_KEY))).cast("int")
        return rows.withColumn("tq_rank", F.when(F.col("tq_rank") > 1, told).otherwise(F.col("tq_rank"))).where("tq_rank = 1").drop("tq_rank")
    return rows.where("tq_rank = 1").drop("tq_rank")


def insert_chunks(stored: DataFrame, new: DataFrame, decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """stored and those of new whose key isn't there; what is stored never changes."""
    now = F.current_timestamp() if now is None else now
    fresh = new.join(stored.select(CHUNK_KEY), CHUNK_KEY, "left_anti").join(decisions.select("case_no", F.col("id").alias("decision_id")), "case_no")
    fresh = fresh.select(
        chunk_id().alias("id"), "decision_id", "case_no", "section", F.col("chunk_index").cast("int").alias("chunk_index"), "text",
        F.lit(None).cast("int").alias("token_count"), F.lit(None).cast("array<float>").alias("embedding"), now.alias("created_at"), now.alias("updated_at"))
    return stored.unionByName(fresh)


def orphans(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    return chunks.join(decisions.select(F.col("id").alias("decision_id")), "decision_id", "left_anti")


def delete_decisions(decisions: DataFrame, chunks: DataFrame, case_nos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given cases; their chunks go with them."""
    left = decisions.join(case_nos.select("case_no"), "case_no", "left_anti")
    return left, chunks.join(left.select(F.col("id").alias("decision_id")), "decision_id", "left_semi")


class Store(Manifested):
    """Both tables as Parquet in buckets of case numbers, merged on read, under manifests.

    A commit appends a folder of its own for each table, in proportion to what it
    brings, and one manifest that names, for every bucket, its folders in the order of
    their commits. What a reader sees of a bucket follows from that order: of a case
    the last values that aren't null, of chunks with one key the first, of a chunk
    the last vector written, and nothing that was there before its case was deleted.
    `compact` writes buckets of several folders anew as one; a bucket of one folder is
    read as it lies. The last manifest is current, so both tables change together
    or not at all, and a reader keeps the files that its manifest names until `vacuum`.

    Folders have names that nobody else has, and the manifest's name is taken by a
    rename: of two commits at once one gets it, and the other lists its folders after
    those of the first, since appending doesn't depend on what is there. Only a
    compaction of buckets that were compacted meanwhile fails; nobody's files change.

    Ids of cases are digests from which buckets are dealt, and rows lie by id within
    bounded row groups, whose least and greatest ids Parquet keeps: a look-up by id
    reads one bucket's few row groups. The model's name and the size of its vectors, where given, are kept in the
    manifest: another model's vectors are refused.
    """

    TABLES = {"decisions": (DECISIONS, ["id"]), "decision_chunks": (CHUNKS, ["decision_id", "section", "chunk_index"])}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, model: str | None = None, dimension: int | None = None, group_bytes: int = 16 << 20):
        super().__init__(spark, path)
        self.buckets, self.model, self.dimension, self.group_bytes = buckets, model, dimension, group_bytes

    def _empty(self) -> dict:
        return {"buckets": self.buckets, "tables": {t: {} for t in self.TABLES}}

    def init(self) -> "Store":
        """Tables that are there stay, with the number of buckets that they were made with."""
        if not self._manifests():
            self._listed(lambda now: now["tables"])
        kept = self._manifest()
        self.buckets = kept["buckets"]
        for name in ("model", "dimension"):
            asked, stored = getattr(self, name), kept.get(name)
            if None not in (asked, stored) and asked != stored:
                raise ValueError(f"the store's {name} is {stored}, not {asked}")
            setattr(self, name, stored if asked is None else asked)
        return self

    def _listed(self, change: Callable[[dict], dict]) -> None:
        """A commit of the tables as `change` makes them."""
        kept = lambda now: {n: now.get(n) if getattr(self, n) is None else getattr(self, n) for n in ("model", "dimension")}
        self._named(lambda now: {**kept(now), "tables": change(now)})

    def _appended(self, parts: list[tuple[str, str, DataFrame]]) -> None:
        """One commit of (table, kind, rows): a folder for each, listed behind those that are there."""
        new = [(name, folder, kind, self._write(name, folder, rows)) for name, kind, rows in parts for folder in [uuid.uuid4().hex]]

        def change(now: dict) -> dict:
            tables = {t: {b: list(v) for b, v in buckets.items()} for t, buckets in now["tables"].items()}
            for name, folder, kind, buckets in new:
                for b in buckets:
                    tables[name].setdefault(b, []).append([folder, kind, now["number"] + 1])
            return tables

        if any(buckets for *_, buckets in new):
            self._listed(change)

    def _write(self, name: str, folder: str, rows: DataFrame, spread: int | None = None) -> list[str]:
        """rows as a folder; the buckets that it has."""
        order = [c for c in self.TABLES[name][1] if c in rows.columns]
        top = f"{self.path}/{name}/v={folder}"
        rows = rows.withColumn("bucket", self.bucket()).repartition(min(self.buckets, spread or self.buckets), "bucket").sortWithinPartitions("bucket", *order)
        rows.write.partitionBy("bucket").option("parquet.block.size", self.group_bytes).parquet(top)
        return sorted(f.getPath().getName().removeprefix("bucket=") for f in self.fs.listStatus(self.Path(top)) if f.getPath().getName().startswith("bucket="))

    # Reading

    def bucket(self, case_no: Column | str = "case_no") -> Column:
        return F.pmod(decision_id(case_no), F.lit(self.buckets)).cast("int")

    def _lists(self, name: str, buckets: list[int] | None, manifest: dict | None) -> dict[str, list]:
        return {b: v for b, v in (manifest or self._manifest())["tables"][name].items() if v and (buckets is None or int(b) in buckets)}

    def _scan(self, name: str, lists: dict[str, list], *kinds: str) -> DataFrame | None:
        """Rows of the folders of some kinds, with the number of their commit."""
        schema, _ = self.TABLES[name]
        paths = [f"{self.path}/{name}/v={f}/bucket={b}" for b, v in lists.items() for f, kind, _ in v if kind in kinds]
        if not paths:
            return None
        numbers = {f: n for v in lists.values() for f, _, n in v}
        known = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
        fields = [T.StructField(f.name, f.dataType) for f in schema]
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/v=([^/]+)/bucket=", 1)
        return self.spark.read.schema(T.StructType(fields)).parquet(*paths).select("*", known[folder].alias("tq_seq"))

    def read(self, name: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        schema, _ = self.TABLES[name]
        lists = self._lists(name, buckets, manifest)
        whole = {b: v for b, v in lists.items() if len(v) == 1 and v[0][1] == "rows"}
        out = self._scan(name, whole, "rows")
        out = out.select(schema.names) if out is not None else None
        merged = self._merged(name, {b: v for b, v in lists.items() if b not in whole})
        both = [df for df in (out, merged) if df is not None]
        return both[0].unionByName(both[1]) if len(both) == 2 else both[0] if both else self.spark.createDataFrame([], schema)

    def _merged(self, name: str, lists: dict[str, list]) -> DataFrame | None:
        rows = self._scan(name, lists, "rows")
        if rows is None:
            return None
        gone = self._scan(name, lists, "gone")
        gone = None if gone is None else gone.groupBy("case_no").agg(F.max("tq_seq").alias("tq_gone"))

        def left(df: DataFrame) -> DataFrame:
            """df without what was there before its case was deleted."""
            return df if gone is None else df.join(gone, "case_no", "left").where("tq_gone is null or tq_seq > tq_gone").drop("tq_gone")

        rows = left(rows)
        seq = F.col("tq_seq")
        if name == "decisions":
            last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c)
            return rows.groupBy("id", "case_no").agg(last("division"), last("title"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
        names = CHUNKS.names
        rows = rows.groupBy("id").agg(F.min_by(F.struct(*names[1:]), seq).alias("r")).select("id", "r.*")
        vectors = self._scan(name, lists, "vectors")
        if vectors is None:
            return rows
        vectors = left(vectors).groupBy("id").agg(F.max_by(F.struct("embedding", "token_count", "updated_at"), seq).alias("tq_v"))
        new = lambda c: F.coalesce(F.col(f"tq_v.{c}"), F.col(c)).alias(c) if c in ("embedding", "token_count", "updated_at") else F.col(c)
        return rows.join(vectors, "id", "left").select(*(new(c) for c in names))

    def by_decision(self, name: str, decision: int) -> DataFrame:
        """A decision's rows by its id, from the one bucket that may have them."""
        return self.read(name, [decision % self.buckets]).where(F.col("id" if name == "decisions" else "decision_id") == decision)

    def case(self, name: str, case_no: str) -> DataFrame:
        """A case's rows."""
        own = self.spark.range(1).select(decision_id(F.lit(case_no)).alias("id")).first().id
        return self.by_decision(name, own).where(F.col("case_no") == case_no)

    # Changes

    def ingest(self, chunks: DataFrame, seq: str | list[str] = "seq", on_duplicate: str = "keep_first", make: Callable[[], Embedder] | None = None) -> None:
        """Decisions and chunks of one batch, and with `make` vectors for them and for what its cases lack. Bytes written are in proportion to the batch."""
        good, now = chunks.where("case_no is not null"), F.current_timestamp()
        cases = decisions_of(good, seq).select(decision_id("case_no").alias("id"), "case_no", "division", "title", now.alias("created_at"), now.alias("updated_at"))
        # A null section equals none other, so such chunks have an id of their own.
        fresh = F.when(F.col("section").isNull(), F.xxhash64("case_no", "chunk_index", F.uuid())).otherwise(chunk_id())
        rows = first_chunks(good, seq, on_duplicate).select(
            fresh.alias("id"), decision_id("case_no").alias("decision_id"), "case_no", "section", F.col("chunk_index").cast("int").alias("chunk_index"), "text",
            F.lit(None).cast("int").alias("token_count"), F.lit(None).cast("array<float>").alias("embedding"), now.alias("created_at"), now.alias("updated_at"))
        parts = [("decisions", "rows", cases), ("decision_chunks", "rows", rows)]
        if make:
            touched = [r.b for r in good.select(self.bucket().alias("b")).distinct().collect()]  # no more than there are buckets
            stored = self.read("decision_chunks", touched) if touched else self.read("decision_chunks").limit(0)
            stored = stored.join(good.select("case_no").distinct(), "case_no", "left_semi")
            rows = embed_in_place(rows.join(stored.select("id"), "id", "left_anti").select(CHUNKS.names), make, dimension=self.dimension)
            parts = [parts[0], ("decision_chunks", "rows", rows), ("decision_chunks", "vectors", self._vectors(stored, make))]
        self._appended(parts)

    def _vectors(self, chunks: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
        """Vectors of the chunks that have none and could be encoded."""
        rows = embed_in_place(chunks.where("embedding is null"), make, dimension=self.dimension).where("embedding is not null")
        return rows.select("id", "case_no", "token_count", "embedding", "updated_at")

    def embed(self, make: Callable[[], Embedder]) -> None:
        """Vectors for all chunks that have none, as after a model failed; they alone are written."""
        self._appended([("decision_chunks", "vectors", self._vectors(self.read("decision_chunks"), make))])

    def delete(self, case_nos: DataFrame) -> None:
        """Cases and their chunks; a line for each is written."""
        rows = case_nos.select("case_no").where("case_no is not null").distinct()
        self._appended([(name, "gone", rows) for name in self.TABLES])

    def compact(self, most: int = 8) -> int:
        """Buckets of more than `most` folders are written anew as one; how many there were."""
        now = self._manifest()
        todo = {t: {b: v for b, v in buckets.items() if len(v) > most} for t, buckets in now["tables"].items()}
        todo = {t: v for t, v in todo.items() if v}
        if not todo:
            return 0
        new = {t: uuid.uuid4().hex for t in todo}
        there = {t: self._write(t, new[t], self.read(t, [int(b) for b in todo[t]], now), len(todo[t])) for t in todo}

        def change(now: dict) -> dict:
            tables = {t: dict(v) for t, v in now["tables"].items()}
            for t, buckets in todo.items():
                for b, old in buckets.items():
                    current = tables[t].get(b, [])
                    if current[: len(old)] != old:
                        raise RuntimeError(f"bucket {b} of {t} was compacted by another")
                    tables[t][b] = ([[new[t], "rows", old[-1][2]]] if b in there[t] else []) + current[len(old) :]
            return tables

        self._listed(change)
        return sum(map(len, todo.values()))

    def vacuum(self, keep: int = 2) -> None:
        """Removes the files that none of the last `keep` manifests names. No commit may run meanwhile."""
        numbers = self._manifests()
        named = {(t, str(b), f) for n in numbers[-keep:] for t, buckets in self._manifest(n)["tables"].items() for b, v in buckets.items() for f, *_ in v}
        for n in numbers[:-keep]:
            self.fs.delete(self.Path(f"{self.path}/manifests/{n}.json"), False)
        for name in self.TABLES:
            top = self.Path(f"{self.path}/{name}")
            for folder in self.fs.listStatus(top) if self.fs.exists(top) else []:
                f = folder.getPath().getName().removeprefix("v=")
                for file in self.fs.listStatus(folder.getPath()):
                    b = file.getPath().getName()
                    if b.startswith("bucket=") and (name, b.removeprefix("bucket="), f) not in named:
                        self.fs.delete(file.getPath(), True)
