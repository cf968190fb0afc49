"""k-means over integer vectors by Sort-means: exact assignments with few distances.

Each round orders, for every centroid, the others by their distance from it. A
vector starts at its previous centroid `a` and goes through a's list; it stops at
the first centroid whose distance from a is strictly more than twice its own
distance to a, since none from there on can be as near. What ties goes to the
smaller number, so the result is that of a full scan.

Vectors are kept that have exactly `dim` components, none null or not finite; a
component x becomes floor(scale * x). Everything after that is integer, so runs
agree on any number of tasks. The first centroids are the kept rows with the
smallest sha256 of "<seed>:<id>"; of rows with one id, or none, that with the
smaller components. Fewer rows than k make fewer centroids. A cluster's new
centroid is the componentwise floor(sum / count); an empty one stays. Rows with
equal ids are separate vectors. Components of 2^26 and more in size would not
leave room for squared distances in 64 bits and raise an error.

Centroids are k rows, known to every task; the driver holds them and nothing
else. Vectors stand in a table in the shared folder, written once a round with
their assignment; sums are aggregated in the tasks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, delete, read, written

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 26


def quantised(df: DataFrame, vec_id: str, vector: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the rows that are kept; v has integer components."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    rows = df.where(F.coalesce((F.size(x) == dim) & sound, F.lit(False)))

    def whole(c):
        at = F.floor(c.cast("double") * scale)
        told = F.raise_error(F.concat(F.lit("a component is too large for 64-bit distances: "), c.cast("string"))).cast("int")
        return F.when(F.abs(c.cast("double") * scale) < LARGEST - 1, at.cast("int")).otherwise(told)

    return rows.select(F.col(vec_id).alias("vec_id"), F.transform(x, whole).alias("v"))


def first_centroids(table: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """k rows by hash; only rows among the lowest few thousand hashes are ordered, where there are that many."""
    hashed = table.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    n, zeros = table.count(), 0
    while n > 16 ** (zeros + 1) * 64 * k:
        zeros += 1
    found = []
    if zeros:
        found = hashed.where(F.col("h").startswith("0" * zeros)).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if len(found) < k:
        found = hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance from it (ties by number), and those squared distances."""
    between = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
    k = len(centroids)
    order = np.argsort(between, 1, kind="stable")
    order = order[order != np.arange(k)[:, None]].reshape(k, k - 1)
    return order, np.take_along_axis(between, order, 1)


def nearest(v: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, and how many distances were computed."""
    cluster, own = before.copy(), ((v - centroids[before]) ** 2).sum(1)
    best, computed = own.copy(), len(v)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        for j, d in zip(order[a].tolist(), apart[a].tolist()):
            rows = rows[4 * own[rows] >= d]  # a distance of more than twice one's own, in squares
            if not len(rows):
                break
            at = ((v[rows] - centroids[j]) ** 2).sum(1)
            better = (at < best[rows]) | ((at == best[rows]) & (j < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = at[better], j
            computed += len(rows)
    return cluster, best, computed


def assigned(table: DataFrame, centroids: np.ndarray, keep: bool = True) -> DataFrame:
    """table (vec_id, v, cluster) with the clusters that these centroids give, and distances; without v where it isn't kept."""
    bounded_batches(table.sparkSession)
    shipped = table.sparkSession.sparkContext.broadcast((centroids, *neighbours(centroids)))
    dim = centroids.shape[1]
    kind = table.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), *([T.StructField("v", T.ArrayType(T.IntegerType()))] if keep else []), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("v")
            v = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            cluster, distance, _ = nearest(v, batch.column("cluster").to_numpy().astype(np.int64), *shipped.value)
            columns = {"vec_id": batch.column("vec_id"), **({"v": own} if keep else {}), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return table.mapInArrow(scan, schema)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids of the next round: floor of the mean of each cluster's vectors, counted in the tasks first."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for r in table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows at most
        new[r.cluster] = [s // r.n for s in r[2:]]
    return new


OUT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): vec_id, cluster, distance and the clusters' figures for each kept vector, and the final centroids."""
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[vec_id].dataType.simpleString()
    with Scratch(spark) as temp:
        path = temp.folder("vectors")
        table = written(quantised(df, vec_id, vector, dim, scale).withColumn("cluster", F.lit(0)), "vectors", path)
        centroids = first_centroids(table, k, seed)
        if not len(centroids):
            return spark.createDataFrame([], f"vec_id {kind}, {OUT}"), centroids
        for _ in range(rounds):
            after = temp.folder("vectors")
            table = written(assigned(table, centroids), "vectors", after)
            delete(spark, path)  # two tables at most at a time
            path, centroids = after, moved(table, centroids)
        result = written(assigned(table, centroids, keep=False), "clusters")
    inertia = {r.cluster: r.s for r in result.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    figures = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    figures = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = result.join(F.broadcast(figures), "cluster")  # k rows
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op13_sortmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "embeddings"))[0]


def sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The same by full scans: every vector against every centroid, each round a pair of common table expressions."""
    sound = f"len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or isnan(x::double) or isinf(x::double))) = 0"
    steps = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where {sound})",
        "c0 as materialized (select row_number() over (order by sha256('" + f"{seed}:' || vec_id::varchar), v) - 1 as c, v as m from v qualify row_number() over (order by sha256('{seed}:' || vec_id::varchar), v) <= {k})",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
        steps.append(f"a{i} as materialized (select r, vec_id, v, c, d from (select v.r, v.vec_id, v.v, c.c, {distance} as d from v, c{i} c) qualify row_number() over (partition by r order by d, c) = 1)")
        if i < rounds:
            mean = f"(select c, list(m order by i) as m from (select c, i, floor(sum(x)::hugeint // count(*))::bigint - case when sum(x)::hugeint % count(*) < 0 then 1 else 0 end as m from (select c, unnest(v) as x, unnest(range({dim})) as i from a{i}) group by c, i) group by c)"
            steps.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(n.m, c{i}.m) as m from c{i} left join {mean} n on n.c = c{i}.c)")
    return (
        "with " + ",\n".join(steps) + f"""
select vec_id, a{rounds}.c::int as cluster, d as distance, (sum(d) over (partition by a{rounds}.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(m, lambda x: x::varchar), ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c)"""
    )


SQL = sql()
