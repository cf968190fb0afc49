"""The byte-offset stream of records: ranges, batches, bad lines, growth, and queries that are killed."""

import io
import json
import os
import random
import uuid

import pytest

from textquarry.operators.store import Store
from textquarry.sources.stream import RecordReader, RecordStream, lines_of, parsed
from textquarry.streaming.ingest import stream_records


def record(i, extra=""):
    return json.dumps({"year": "1996", "title": f"t{i}", "url": f"u{i}", "text": f"text {i} é😀{extra}"}, ensure_ascii=False)


def test_each_line_is_in_one_range():
    rng = random.Random(1)
    for _ in range(300):
        data = "\n".join(rng.choice(["", "a", "bcé", "x" * rng.randrange(9)]) for _ in range(rng.randrange(1, 12))).encode()
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in lines_of(io.BytesIO(data), a, b)]
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        assert got == [w for w in want if w[0] < len(data)]


def test_lines_that_are_no_records():
    assert parsed(b'{"url": 5, "text": null, "more": 1}')[0][2:] == [None, "5", None]
    for bad in (b"{", b"[1]", b"\xff{}", b"3"):
        assert parsed(bad)[1] is not None


def drained(spark, source, out, stop_after=None, **options):
    """One availableNow run into `out`, a folder a batch; with stop_after the batch of that number dies half way."""
    spark.dataSource.register(RecordStream)
    rows = spark.readStream.format("record_stream").options(path=str(source), progress=f"{out}/progress", **options).load()

    def save(batch, number):
        if number == stop_after:
            batch.limit(1).write.mode("overwrite").json(f"{out}/lost")
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = rows.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def rows_of(spark, out):
    return spark.read.parquet(f"{out}/rows").collect()


def test_batches_bad_lines_and_a_kill_in_mid_file(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    lines = [record(i, "y" * (i % 50)) for i in range(400)]
    lines[7], lines[200] = "{broken", "[]"
    (source / "a.jsonl").write_text("\n".join(lines[:250]) + "\n")
    (source / "b.jsonl").write_text("\n".join(lines[250:]))  # no end of line at the end
    (source / "_temporary").write_text("no record")
    size = sum((source / n).stat().st_size for n in ("a.jsonl", "b.jsonl"))
    options = {"maxBytes": str(size // 5), "perTask": str(size // 40)}
    for n in range(8):
        if n == 2:
            with pytest.raises(Exception, match="killed"):
                drained(spark, source, out, stop_after=2, **options)
        drained(spark, source, out, **options)
    got = rows_of(spark, out)
    assert sorted((r.file, r.at) for r in got) == sorted(set((r.file, r.at) for r in got))  # nothing twice
    assert len(got) == 400 and sorted(r.url for r in got if r.url) == sorted(f"u{i}" for i in range(400) if i not in (7, 200))
    assert sorted(r["_corrupt_record"] for r in got if r.url is None) == ["[]", "{broken"]
    assert len(os.listdir(out / "rows")) > 4


def test_files_that_grow(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a").write_text(record(1) + "\n" + record(2)[:10])
    drained(spark, source, out, growing="true")
    assert [r.url for r in rows_of(spark, out)] == ["u1"]
    (source / "a").write_text(record(1) + "\n" + record(2) + "\n" + record(3) + "\n{")
    (source / "b").write_text(record(4) + "\n")
    drained(spark, source, out, growing="true")
    drained(spark, source, out, growing="true")
    assert sorted(r.url for r in rows_of(spark, out)) == ["u1", "u2", "u3", "u4"]


def test_a_reader_that_dies_before_spark_knows_its_offset(tmp_path):
    """What was given out and never planned is in the next batch, and offsets never go back."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "a").write_text("".join(record(i) + "\n" for i in range(50)))
    options = {"path": str(source), "progress": str(tmp_path / uuid.uuid4().hex), "maxBytes": "700"}
    first = RecordReader(options)
    a = first.latestOffset()
    assert [r.start for r in first.partitions(first.initialOffset(), a)] == [0]
    lost = RecordReader(options).latestOffset()
    assert lost["bytes"] == a["bytes"] + 700
    again = RecordReader(options)
    b = again.latestOffset()
    seen = [at for p in (*again.partitions({"bytes": 0}, a), *again.partitions(a, b)) for batch in again.read(p) for at in batch.column("at").to_pylist()]
    assert seen == sorted(set(seen)) and again.partitions(b, b) == []
    while (c := again.latestOffset()) != b:
        seen += [at for p in again.partitions(b, c) for batch in again.read(p) for at in batch.column("at").to_pylist()]
        again.commit(b)
        b = c
    assert len(seen) == len(set(seen)) == 50


def test_stored_in_the_order_of_lines(spark, tmp_path):
    """The first chunk of a case stays, by file and line; unusable lines are kept apart."""
    source = tmp_path / "in"
    source.mkdir()
    text = lambda n, x: f"FIRST DIVISION\n[ G.R. No. {n} ]\n\nFACTS\n\nThe {x} facts."
    rows = [{"title": "t", "url": u, "text": text(n, x)} for u, n, x in (("z", 1, "first"), ("b", 2, "only"), ("a", 1, "second"))]
    (source / "a").write_text("\n".join([json.dumps(rows[0]), "{no", json.dumps(rows[1]), json.dumps(rows[2])]))
    store = Store(spark, str(tmp_path / "store"), buckets=2).init()
    stream_records(spark, str(source), store, str(tmp_path / "check"), str(tmp_path / "progress"), unusable=str(tmp_path / "bad")).awaitTermination()
    got = {r.case_no: r.text.split("\n")[-1] for r in store.read("decision_chunks").where("section = 'FACTS'").collect()}
    assert got == {"G.R. No. 1": "The first facts.", "G.R. No. 2": "The only facts."}
    assert [(r.at, r.line) for r in spark.read.json(str(tmp_path / "bad")).collect()] == [(len(json.dumps(rows[0])) + 1, "{no")]
