"""The store's merges on read against a plain model, commits at once, bytes written, look-ups, compaction."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from textquarry.operators import embed, store

CHUNK = "case_no string, division string, title string, section string, chunk_index int, text string, seq int"


def rows_of(s):
    return ({(r.case_no, r.division, r.title) for r in s.read("decisions").collect()}, sorted((r.case_no, r.section or "", r.chunk_index, r.text, r.embedding is not None) for r in s.read("decision_chunks").collect()))


class Plain:
    """The same tables in dictionaries."""

    def __init__(self):
        self.cases, self.chunks = {}, {}

    def ingest(self, rows, vectors=False):
        met = set()
        for case, division, title, section, index, text, _ in sorted(rows, key=lambda r: r[-1]):
            if case is None:
                continue
            met.add(case)
            old = self.cases.get(case, (None, None))
            self.cases[case] = (division or old[0], title or old[1])
            key = (case, section, index) if section else (case, object(), index)
            self.chunks.setdefault(key, [text, False])
        for key in self.chunks:
            self.chunks[key][1] |= vectors and key[0] in met

    def delete(self, cases):
        self.cases = {c: v for c, v in self.cases.items() if c not in cases}
        self.chunks = {k: v for k, v in self.chunks.items() if k[0] not in cases}

    def rows(self):
        return {(c, *v) for c, v in self.cases.items()}, sorted((c, s if isinstance(s, str) else "", i, *v) for (c, s, i), v in self.chunks.items())


def test_merges_follow_the_order_of_commits(spark, tmp_path):
    rng = random.Random(4)
    s, plain, make = store.Store(spark, f"file://{tmp_path}/t", buckets=3).init(), Plain(), lambda: embed.HashingEmbedder(4)
    for step in range(7):
        kind = ["rows", "rows", "vectors", "gone", "rows", "embed", "rows"][step]
        if kind in ("rows", "vectors"):
            rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice(["D1", "D2", None]), rng.choice(["T", None]), rng.choice(["F", "G", "G", None]), rng.randrange(2), f"t{step}{k}", k) for k in range(6)]
            s.ingest(spark.createDataFrame(rows, CHUNK), make=make if kind == "vectors" else None)
            plain.ingest(rows, kind == "vectors")
        elif kind == "gone":
            s.delete(spark.createDataFrame([("a",), ("zz",)], "case_no string"))
            plain.delete({"a", "zz"})
        else:
            s.embed(make)
            for v in plain.chunks.values():
                v[1] = True
        assert rows_of(s) == plain.rows(), kind
    before = s.read("decision_chunks")
    assert s.compact(most=1) > 0 and rows_of(s) == plain.rows() and s.compact(most=1) == 0
    assert all(len(v) <= 1 for t in s._manifest()["tables"].values() for v in t.values())
    assert before.count() == len(plain.chunks)  # an open reader keeps its files
    s.vacuum(1)
    assert rows_of(s) == plain.rows()


def test_commits_at_once_keep_both(spark, tmp_path):
    """The second has read the manifest before the first commits; neither's rows are lost, and the first chunk stays."""
    path = f"file://{tmp_path}/t"
    one, two = store.Store(spark, path, buckets=2).init(), store.Store(spark, path, buckets=2).init()
    old, real = two._manifest(), two._manifest
    one.ingest(spark.createDataFrame([("c1", "A", "T", "F", 0, "first", 1)], CHUNK))
    calls = []
    two._manifest = lambda n=None: calls.append(n) or (old if len(calls) == 1 else real(n))
    two.ingest(spark.createDataFrame([("c1", None, "U", "F", 0, "second", 1), ("c2", "B", "T", "F", 0, "other", 2)], CHUNK))
    assert len(calls) == 2  # it met the first one's manifest, and came after it
    for s in (one, two):
        assert rows_of(s) == ({("c1", "A", "U"), ("c2", "B", "T")}, [("c1", "F", 0, "first", False), ("c2", "F", 0, "other", False)])
    # A compaction of what was compacted meanwhile fails and changes nothing.
    stale = one._manifest()
    two._manifest = real
    assert two.compact(most=1) > 0
    one._manifest, state = (lambda n=None, m=one._manifest, c=[]: stale if not c and not c.append(1) else m(n)), rows_of(two)
    with pytest.raises(RuntimeError, match="compacted by another"):
        one.compact(most=1)
    assert rows_of(store.Store(spark, path).init()) == state


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_a_batch_writes_in_proportion_and_look_ups_read_little(spark, tmp_path):
    rng, top = random.Random(3), tmp_path / "t"
    s = store.Store(spark, f"file://{top}", buckets=2, group_bytes=20_000).init()
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(f"c{i}", "A", "T", "F", k, text(), 10 * i + k) for i in range(600) for k in range(5)]
    s.ingest(spark.createDataFrame(rows, CHUNK))
    s.compact(most=0)
    s.vacuum(1)
    whole = size(top)
    s.ingest(spark.createDataFrame([(f"c{i}", "B", None, "NEW", 0, text(), i) for i in range(30)], CHUNK))  # 1 percent, all buckets
    assert size(top) - whole < 0.05 * whole
    decision = spark.range(1).select(store.decision_id(__import__("pyspark").sql.functions.lit("c7")).alias("i")).first().i
    assert sorted((r.section, r.chunk_index) for r in s.by_decision("decision_chunks", decision).collect()) == [("F", k) for k in range(5)] + [("NEW", 0)]
    # Of the compacted file of the decision's bucket few row groups can have it.
    bucket = decision % 2
    folder = s._manifest()["tables"]["decision_chunks"][str(bucket)][0][0]
    (file,) = (top / "decision_chunks" / f"v={folder}" / f"bucket={bucket}").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    column = meta.schema.names.index("decision_id")
    groups = [meta.row_group(i).column(column).statistics for i in range(meta.num_row_groups)]
    assert len(groups) > 5 and sum(g.min <= decision <= g.max for g in groups) == 1


def test_first_chunks_leave_tasks_before_the_shuffle(spark):
    rows = spark.createDataFrame([("c", s, 0, t, q) for s, t, q in (("S", "b", 2), ("S", "a", 1), (None, "x", 1), (None, "x", 1), ("T", "d", 3))] + [(None, "S", 0, "no case", 0)], "case_no string, section string, chunk_index int, text string, seq int").repartition(3)
    first = store.first_chunks(rows)
    assert sorted((r.section or "", r.text) for r in first.collect()) == [("", "x"), ("", "x"), ("S", "a"), ("T", "d")] and first.columns == rows.columns
    assert "WindowGroupLimit" in first._jdf.queryExecution().optimizedPlan().toString()


def test_merged_chunks_are_computed_once(spark):
    from textquarry.plans import registry

    for query in (registry.chunks_upsert, registry.chunk_decision_fk, registry.fk_check):
        assert "ArrowEvalPython" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
