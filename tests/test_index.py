"""An index that follows its table: recall after batches, what is written, removals, splits, and the service on it."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import embed, search
from textquarry.operators.index import NEAR, VectorIndex
from textquarry.service import SearchService


def vectors(spark, n, seed, center=None, first=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 16)) if center is None else np.array([center])
    v = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, 16)) * 0.4
    return spark.createDataFrame([(first + i, f"c{i % 7}", "S", i % 3, f"text {first + i}", x.tolist()) for i, x in enumerate(v.astype(np.float32))], "id long, case_no string, section string, chunk_index int, text string, embedding array<float>")


def recall(index, rows, k=10):
    """Mean share of the true k nearest of every row whose id is divisible by 20."""
    rows = rows.select("id", "embedding").collect()
    ids, m = np.array([r.id for r in rows]), np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = [i for i, x in enumerate(ids) if x % 20 == 0]
    queries = index.spark.createDataFrame([(int(ids[i]), m[i].tolist()) for i in asked], "query_id long, embedding array<double>")
    got = {}
    for r in index.search_many(queries, k).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    return np.mean([len(got.get(ids[i], set()) & set(ids[np.argsort(-(m @ m[i]), kind="stable")[:k]].tolist())) / k for i in asked])


def files(top):
    return {p: p.stat().st_mtime_ns for p in Path(top).rglob("*.parquet")}


def test_recall_after_ten_batches_and_splits(spark, tmp_path):
    rows = vectors(spark, 2000, 1)
    index = VectorIndex(spark, f"file://{tmp_path}/i").create(rows.where("id < 1000"), 24)
    for b in range(10):
        before = files(tmp_path)
        index.add(rows.where((F.col("id") >= 1000 + 100 * b) & (F.col("id") < 1100 + 100 * b)))
        after = files(tmp_path)
        assert all(after.get(p) == t for p, t in before.items())  # nothing is written again
    assert index.rows().count() == 2000 and recall(index, rows) >= 0.9 and 0.9 < index.drift() < 1.1
    # A batch of another kind in one place: its list is too long, and rows fit worse.
    far = vectors(spark, 1500, 2, center=[3.0] + [0.0] * 15, first=10_000)
    index.add(far)
    n, sizes = len(index._manifest()["lists"]), {k: v["rows"] for k, v in index._manifest()["lists"].items()}
    before = files(tmp_path / "i" / "lists")
    done = index.split(times=3, least=100)
    assert 1 <= done <= 2 and len(index._manifest()["lists"]) == n + done
    written = {p for p in files(tmp_path / "i" / "lists") if p not in before}
    assert len({p.parent for p in written}) <= (2 + NEAR) * done  # the split lists and those around them alone
    for _ in range(5):  # what gathers around a new centroid may be too long again
        if not index.split(times=3, least=100):
            break
    assert index.rows().count() == 3500 and sum(v["rows"] for v in index._manifest()["lists"].values()) == 3500
    assert max(v["rows"] for v in index._manifest()["lists"].values()) < max(sizes.values())
    assert recall(index, rows.unionByName(far)) >= 0.9


def test_removed_and_replaced_rows(spark, tmp_path):
    rows = vectors(spark, 300, 3)
    index = VectorIndex(spark, f"file://{tmp_path}/i").create(rows, 4)
    index.remove(rows.where("id < 10").select("id"))
    moved = rows.where("id between 5 and 20").withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("text", F.lit("moved"))
    index.add(moved, replace=True)
    got = {r.id: r.text for r in index.rows().collect()}
    assert set(got) == set(range(5, 300)) and index.rows().count() == 295 and {i for i, t in got.items() if t == "moved"} == set(range(5, 21))
    index.split(times=0, least=0)
    assert {r.id: r.text for r in index.rows().collect()} == got
    index.add(rows.where("id < 5"))  # added again after its removal
    assert index.rows().count() == 300
    index.add(rows.limit(0))
    assert index.rows().count() == 300


def test_service_searches_through_the_index(spark, tmp_path):
    texts = spark.createDataFrame([(i, "c", "S", i, f"alpha{i} beta{i % 5} gamma") for i in range(60)], "id long, case_no string, section string, chunk_index int, text string").withColumn("embedding", embed.embedded("text", lambda: embed.HashingEmbedder(32)))
    index = VectorIndex(spark, f"file://{tmp_path}/i").create(texts, 4)
    through, plain = SearchService(spark, None, embed.HashingEmbedder(32), index), SearchService(spark, texts, embed.HashingEmbedder(32))
    assert through.search("alpha7 beta2", 1)["results"] == plain.search("alpha7 beta2", 1)["results"]
    assert index.search([1.0] * 32, 60, probes=1).count() < 60 == index.search([1.0] * 32, 60, probes=4).count()
    # Only the lists looked at are read.
    assert len(index.search([1.0] * 32, 5, probes=1).inputFiles()) < len(index.rows().inputFiles())
    with pytest.raises(RuntimeError, match="no chunks"):
        SearchService(spark, None, embed.HashingEmbedder(32))
    assert search.recall(index.search([1.0] * 32, 5, probes=4), search.exact(texts, [1.0] * 32, 5)) == 1.0


def test_nearest_cells_are_those_of_a_full_sort():
    rng = np.random.default_rng(3)
    ids = rng.permutation(50).astype(np.int64)
    distance = rng.integers(0, 6, (40, 50)).astype(np.float64)  # many equal ones
    distance[0, :45], distance[1, 7] = np.nan, np.nan
    for k in (1, 10, 49, 50, 80):
        near = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
        at, to, both = search.nearest_cells(distance, ids, k)
        assert (to == near.ravel()).all() and (at == np.repeat(np.arange(40), near.shape[1])).all()
        assert np.array_equal(distance[both], np.take_along_axis(distance, near, 1).ravel(), equal_nan=True)


def test_a_task_holds_few_distances(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 64)  # some rows, and less than one where a list is long
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "id long, embedding array<double>")
    centroids = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0, 0.0])], "list_id long, centroid array<double>")
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r.id) for r in search.ivf_many(search.nearest_lists(rows, centroids, 1), centroids, queries, 3, 2).collect()}
    table = np.array([r.embedding for r in rows.orderBy("id").collect()])
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    assert got == {(q, int(i)) for q in range(0, 300, 20) for i in np.argsort(-(unit @ unit[q]))[:3]}
