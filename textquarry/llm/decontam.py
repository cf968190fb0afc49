"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are all its runs of WINDOW words (an item of fewer words is
one window). A window is contained in a text only if all its shingles are, so
its prefix may be one single shingle, and the rarest is the best: shingles are
SHINGLE consecutive words, ordered by how often they occur in all documents. The
join looks up each text's shingles among the windows' prefixes; the shingle's
offset in its window fixes where the window would have to begin (positional
bound), which must lie inside the text with all its words (length bound); what
is left is compared word by word. A word in any occurrence of a window is hit.

The benchmark is a stated query set. Its windows are made and grouped in Spark and
dealt to blocks of about BLOCK_WINDOWS by a digest; the driver holds one block at a
time, and tasks look it up by the first and then the second word of its prefixes.
Each block is a pass over the texts, so no broadcast grows with the benchmark.
Documents never meet each other.

Null and empty texts have no words and hit nothing; null or wordless items have
no windows. Repeated rows are looked up each for itself; items with equal texts
are all reported. Items with a null id mark words but are not listed. A column of
docs named like the output stays, and the output gets underscores.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, free, read

WINDOW, SHINGLE = 10, 2
#: Windows of a block, about: 10 words each.
BLOCK_WINDOWS = 200_000
SEPARATE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Windows = dict[tuple[bytes, ...], set[str]]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(SEPARATE).split()


def windows_of(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(window, items): each different window, its words joined by blanks, with the ids of its items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                own = {b" ".join(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))} if w else ()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([item] * len(own), pa.string())], ["window", "item"])

    rows = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).mapInArrow(cut, "window binary, item string")
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))  # null ids are no items


def shingles_of(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    return list(zip(*(window[i:] for i in range(min(SHINGLE, len(window))))))


def frequencies(docs: DataFrame, text: str, shingles: set[tuple[bytes, ...]]) -> Counter:
    """How often each of the given shingles occurs in all texts. Counts of at most one block's shingles come to the driver."""
    ids = {s: i for i, s in enumerate(sorted(shingles))}
    known = docs.sparkSession.sparkContext.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = known.value, Counter()
        single = any(len(s) == 1 for s in own)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                w = words_of(t)
                pairs = zip(*(w[i:] for i in range(SHINGLE)))
                total.update(filter(own.__contains__, chain(pairs, zip(w)) if single else pairs))
        yield pa.RecordBatch.from_pydict({"s": pa.array([own[s] for s in total], pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    got = docs.select(text).mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    back = list(ids)
    return Counter({back[r.s]: r.n for r in got})


class Index:
    """Windows by the words of their rarest shingle: (offset, window, items) under its first and second word, or under a single one."""

    def __init__(self, windows: Windows, counts: Counter):
        self.single: dict[bytes, list] = {}
        self.by: dict[bytes, dict[bytes, list]] = {}
        for window, items in windows.items():
            at, prefix = min(enumerate(shingles_of(window)), key=lambda s: (counts[s[1]], s[1], s[0]))
            found = self.single if len(prefix) == 1 else self.by.setdefault(prefix[0], {})
            found.setdefault(prefix[-1], []).append((at, list(window), items))

    def hits(self, words: list[bytes]) -> tuple[bytearray, set[str]]:
        """A byte for each word, 1 where hit, and the items."""
        hit, items, n = bytearray(len(words)), set(), len(words)
        by, single = self.by, self.single
        found = [(i, own) for i, w in enumerate(words) if w in by and i + 1 < n and (own := by[w].get(words[i + 1]))]
        if single:
            found += [(i, single[w]) for i, w in enumerate(words) if w in single]
        for i, own in found:
            for at, window, listed in own:
                start, end = i - at, i - at + len(window)
                if start >= 0 and end <= n and words[start:end] == window:
                    hit[start:end] = b"\x01" * len(window)
                    items |= listed
        return hit, items


FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def found_in(hit: bytearray, items: set[str]) -> tuple:
    listed = sorted(items)
    n_hit = hit.count(1)
    return len(hit), n_hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), n_hit > 0


def decontamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "decontamination") -> DataFrame:
    """docs with a struct column `out` (or free(docs, out)) that says what of the benchmark each text contains."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out, state = free(docs, out), free(docs, "state")
    types = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def one(block, last: bool):
        """What is found so far (as bytes and items), or, after the last block, the result."""

        @F.arrow_udf(f"struct<{FIELDS.replace(', ', ',').replace(' ', ':')}>" if last else "struct<hit:binary,items:array<string>>")
        def look_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            index = Index(*block.value)
            for batch, before in batches:
                rows = []
                for t, b in zip(batch.to_pylist(), before.to_pylist()):
                    hit, items = index.hits(words_of(t))
                    if b is not None:
                        hit = bytearray(x | y for x, y in zip(hit, b["hit"]))
                        items |= set(b["items"])
                    rows.append(found_in(hit, items) if last else (bytes(hit), sorted(items)))
                kinds = types if last else [pa.binary(), pa.list_(pa.string())]
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names if last else ["hit", "items"])

        return look_up

    with Scratch(spark) as temp:
        windows = temp.written(windows_of(benchmark, item_id, item_text), "windows")
        n = max(1, -(-windows.count() // BLOCK_WINDOWS))
        found = F.lit(None).cast("struct<hit:binary,items:array<string>>")
        for i in range(n):
            # One block of a bounded number of windows at a time.
            part = {tuple(bytes(r.window).split()): set(r.items) for r in windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i).toLocalIterator()}
            counts = frequencies(docs, text, {s for w in part for s in shingles_of(w)}) if part else Counter()
            found = one(spark.sparkContext.broadcast((part, counts)), i == n - 1)(docs[text], found)
            docs = docs.withColumn(out if i == n - 1 else state, found)
            found = docs[state] if i < n - 1 else None
    return docs.drop(state) if n > 1 else docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "decontamination.*")


SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
w as (select distinct item_id, len(ws[i:i + 9]) as k, array_to_string(ws[i:i + 9], ' ') as g from b, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as u(i) where len(ws) > 0),
k as (select distinct k from w),
g as (select rid, k, i, array_to_string(ws[i:i + k - 1], ' ') as g from d, k, unnest(range(1, len(ws) - k + 2)) as u(i)),
m as (select rid, item_id, i, w.k from g join w on g.k = w.k and g.g = w.g),
h as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + k)) as p from m) group by rid),
t as (select rid, count(*) as n, string_agg(x, ',' order by x) as ids from (select distinct rid, item_id::varchar as x from m where item_id is not null) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(t.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)
"""
