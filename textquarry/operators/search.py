"""Nearest vectors by cosine distance: exact, and by an inverted file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine_distance, normalised, similarity
from ..sources.tables import written_table

# Results by default, lists of the index, lists that a query looks at.
K, LISTS, PROBES = 5, 100, 1


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def exact(chunks: DataFrame, query: list[float] | DataFrame, k: int = K, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows nearest to the query, with distance and similarity; equal distances by key. Each task keeps k rows.

    A query given as a DataFrame is one row with one vector column.
    """
    rows = chunks.where(F.col(embedding).isNotNull())
    if isinstance(query, DataFrame):
        one = query.limit(1).select(F.col(query.columns[0]).alias("tq_query"))  # a single vector, by the limit
        rows = rows.crossJoin(F.broadcast(one)).withColumn("distance", cosine_distance(embedding, "tq_query")).drop("tq_query")
    else:
        rows = rows.withColumn("distance", cosine_distance(F.col(embedding), vector(query)))
    return rows.orderBy(F.col("distance").asc_nulls_last(), key).limit(k).withColumn("similarity", similarity("distance"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as unit rows; a null vector's row is 0."""
    rows = column.to_pylist()
    size = max((len(r) for r in rows if r is not None), default=0)
    out = np.array([r if r is not None else [0.0] * size for r in rows], np.float64).reshape(len(rows), size)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def centroids_by(rows: DataFrame, label: str, embedding: str = "embedding") -> DataFrame:
    """(list_id, centroid): element-wise means. Tasks give one row of sums a label; only these are taken apart."""
    kind = rows.schema[label].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, n = total.get(key, (0.0, 0))
                total[key] = (x + np.array(v, np.float64), n + 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), batch_type), pa.array([n for _, n in total.values()], pa.int64()), pa.array([x.tolist() for x, _ in total.values()], pa.list_(pa.float64()))], ["list_id", "n", "sums"])

    batch_type = to_arrow_type(rows.schema[label].dataType)
    part = rows.where(F.col(embedding).isNotNull()).select(label, embedding).mapInArrow(sums, f"list_id {kind}, n long, sums array<double>")
    flat = part.select("list_id", "n", F.posexplode("sums").alias("i", "v"))
    means = flat.groupBy("list_id", "i").agg((F.sum("v") / F.sum("n")).alias("v"))
    return means.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def nearest_lists(rows: DataFrame, centroids: DataFrame, n: int, embedding: str = "embedding") -> DataFrame:
    """rows with list_id, once for each of the n nearest lists. The centroids, the index's fixed number of lists, go to every task; a batch is one product of matrices."""
    table = centroids.orderBy("list_id").toArrow()  # as many rows as the index has lists
    ids, lists = table.column("list_id").to_pylist(), _matrix(table.column("centroid"))
    kind = centroids.schema["list_id"].dataType

    @F.arrow_udf(f"array<{kind.simpleString()}>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            distance = np.round(np.maximum(1 - _matrix(batch) @ lists.T, 0.0), 9) if len(batch) else np.zeros((0, len(ids)))
            yield pa.array([[ids[j] for j in row] for row in np.argsort(distance, axis=1, kind="stable")[:, :n]], pa.list_(to_arrow_type(kind)))

    found = rows.where(F.col(embedding).isNotNull()).withColumn("list_id", nearest(F.col(embedding)))
    return found.select(*rows.columns, F.explode_outer("list_id").alias("list_id")).where("list_id is not null")


def trained_centroids(rows: DataFrame, lists: int = LISTS, turns: int = 5, sample: int = 20_000, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """Spherical k-means on at most `sample` rows, chosen by digest of the key; all rows are assigned later."""
    chosen = written_table(sampled(rows, sample, embedding, key), "ivf-sample")
    first = chosen.orderBy(F.xxhash64("id", F.lit(1))).limit(lists)
    centroids = first.select(F.xxhash64("id").alias("list_id"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))
    centroids = written_table(centroids, "ivf-lists")
    for _ in range(turns):
        moved = centroids_by(nearest_lists(chosen, centroids, 1), "list_id")
        kept = centroids.join(moved.select("list_id"), "list_id", "left_anti")
        centroids = written_table(moved.select("list_id", normalised("centroid").alias("centroid")).unionByName(kept), "ivf-lists")
    return centroids


def sampled(rows: DataFrame, sample: int, embedding: str = "embedding", key: str = "id") -> DataFrame:
    return rows.where(F.col(embedding).isNotNull()).select(F.col(key).alias("id"), F.col(embedding).alias("embedding")).orderBy(F.xxhash64("id")).limit(sample)


def tuned_probes(rows: DataFrame, centroids: DataFrame, target: float = 0.95, k: int = 10, sample: int = 5_000, queries: int = 200, embedding: str = "embedding", key: str = "id") -> int:
    """The least number of lists that a query has to look at for a mean recall of target, measured by brute force within a sample of bounded size.

    Neighbours within a sample lie further apart than among all rows, so the number is on the safe side.
    """
    table = centroids.toArrow()
    lists = _matrix(table.column("centroid"))
    points = _matrix(sampled(rows, sample, embedding, key).toArrow().column("embedding"))
    if not len(points) or not len(lists):
        return 1
    own, asked = np.argmax(points @ lists.T, axis=1), points[:queries]
    best = np.argsort(-(asked @ points.T), axis=1)[:, :k]
    order = np.argsort(-(asked @ lists.T), axis=1)
    place = np.argsort(order, axis=1)  # how many lists come before each
    needed = place[np.arange(len(asked))[:, None], own[best]]
    shares = [(needed < p).mean() for p in range(1, len(lists) + 1)]
    return next((p for p, x in enumerate(shares, 1) if x >= target), len(lists))


def write_index(rows: DataFrame, centroids: DataFrame, path: str, embedding: str = "embedding", key: str = "id") -> None:
    """Rows by list in folders, so that a query reads the folders of its lists alone. Large lists make several files."""
    nearest_lists(rows, centroids, 1, embedding).repartition("list_id", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("list_id").parquet(path)


def ivf(indexed: DataFrame, centroids: DataFrame, query: DataFrame, k: int = K, probes: int = PROBES, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """The k nearest rows of the query's `probes` nearest lists. indexed has list_id; query is one row (embedding)."""
    one = query.limit(1).select(F.col(query.columns[0]).alias("tq_query"))
    lists = nearest_lists(one, centroids, probes, "tq_query").select("list_id")
    # `probes` rows at most.
    return exact(indexed.join(F.broadcast(lists), "list_id", "left_semi"), query, k, embedding, key)


#: Distances that a task holds at once.
CELLS = 1_000_000


def nearest_cells(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(rows, columns, both) of the k least distances of each row, equal ones by id. Only those up to a row's k-th least are sorted."""
    at, to = np.nonzero(~(distance > np.partition(distance, k - 1, axis=1)[:, k - 1 : k])) if k < len(ids) else (x.ravel() for x in np.indices(distance.shape))
    order = np.lexsort((ids[to], distance[at, to], at))
    at, to = at[order], to[order]
    first = np.searchsorted(at, at)  # of each row's cells
    kept = np.arange(len(at)) - first < k
    return at[kept], to[kept], (at[kept], to[kept])


def ivf_many(indexed: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = K, probes: int = PROBES, embedding: str = "embedding", key: str = "id", query_key: str = "query_id", part: int = 20_000) -> DataFrame:
    """(query_id, id, distance) of the k nearest rows of each query's lists, for any number of queries (query_id, embedding).

    A list is cut into parts of about `part` rows; a part meets the queries that
    look at it as products of matrices and gives k rows a query, so that no pair of a
    query and a row becomes one and no list is one task's.
    """
    parts = indexed.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))  # a row for each list
    left = indexed.join(F.broadcast(parts), "list_id").select("list_id", F.pmod(F.xxhash64(key), "parts").alias("part"), F.col(key).alias("id"), F.col(embedding).alias("v"))
    right = nearest_lists(queries.select(F.col(query_key).alias("query_id"), F.col(embedding).alias("q")), centroids, probes, "q").join(F.broadcast(parts), "list_id")
    right = right.select("list_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "query_id", "q")

    def best(key_: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, rows, found = own.column("id").to_numpy(), _matrix(own.column("v")), []
        step = max(1, CELLS // max(1, len(ids)))
        for at in range(0, len(asked) if len(ids) else 0, step):
            some = asked.slice(at, step)
            distance = np.maximum(1 - _matrix(some.column("q")) @ rows.T, 0.0)
            found.append(tuple(x[i] for x, i in zip((some.column("query_id").to_numpy(), ids, distance), nearest_cells(distance, ids, k))))
        columns = [np.concatenate(c) for c in zip(*found)] or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "distance"])

    some = left.groupBy("list_id", "part").cogroup(right.groupBy("list_id", "part")).applyInArrow(best, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))  # k rows for each part looked at
    return some.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, wanted: DataFrame, key: str = "id") -> float:
    n = wanted.count()
    return wanted.join(found.select(key), key, "left_semi").count() / n if n else 1.0


# ---- what a caller gets ----

def response(found: DataFrame) -> DataFrame:
    """Rows of a search response: the whole text as preview."""
    return found.select(F.col("id").cast("long").alias("id"), "case_no", "section", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("text").alias("preview"), F.col("distance").cast("double").alias("distance"), F.col("similarity").cast("double").alias("similarity"))


def result_table(found: DataFrame) -> DataFrame:
    """Display columns that exist, in a fixed order."""
    order = ("case_no", "section", "chunk_index", "similarity", "distance", "preview")
    return found.select(*(F.col(c) for c in order if c in found.columns))


def digits(x: Column | str, n: int) -> Column:
    """x with n digits, rounded from its exact binary value; Java's formatter rounds the shortest decimal form, so that halves differ."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if v is None else f"{v:.{n}f}" for v in batch.to_pylist()], pa.string())

    return run((F.col(x) if isinstance(x, str) else x).cast("double"))


def result_labels(found: DataFrame, key: str = "id") -> DataFrame:
    """(rank from 1, label): similarity with three and distance with four digits. found is a result of k rows."""
    rank = F.row_number().over(Window.orderBy(F.col("distance").asc_nulls_last(), key))
    return found.select(key, rank.alias("rank"), digits("similarity", 3).alias("similarity_label"), digits("distance", 4).alias("distance_label"))
