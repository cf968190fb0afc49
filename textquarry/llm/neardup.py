"""Near duplicates: MinHash signatures joined within a Hamming distance, links confirmed on full sets.

A text's set holds its different WORDS-word shingles. Texts with equal sets are
one class from the start and go on as one row, however many copies there are.
A class has a signature of CHUNKS * LANES values of BITS bits, one for each of as
many hash functions: the fewer the values that differ, the more alike the sets.

Multi-index Hamming join: the signature is cut into CHUNKS chunks. Two signatures
that differ in at most ERRORS * CHUNKS + CHUNKS - 1 values have, by pigeonhole, a
chunk with at most ERRORS differing values. So each chunk is entered once for
every choice of ERRORS values left out, and signatures that agree in an entry are
candidates: no pair within that distance is missed. At a similarity of 0.75
another entry agrees anyway in all but 3 of 10,000 pairs.

Hub rounds: in each of ROUNDS rounds an entry names one hub, drawn by a digest of
its component, and a class is compared in full with one hub alone, the one that
most of its entries name. So a group of n alike classes costs n comparisons a
round, not n * n, and mostly becomes one component.

Blocks: entries in which different components still meet are left over. The
classes that such entries connect are a neighbourhood, and all of them are
compared with each other, a block at a time: a class carries its full set once
into each block, the block counts what every two sets share, and gives back a
spanning forest of the components that it joins, never pairs. So rows stay in
proportion to the classes. A neighbourhood that fills more than LARGE fragments is
a chain of loose groups; it is compared entry by entry instead, which covers the same
candidates. Either way every two classes that share an entry end up in one
component if their full sets are alike; what ROUNDS joins before has no influence.

Null, empty and wordless texts have an empty set and link with nothing; rows
with a null id stay single and are kept, with a null component. Rows with equal
ids are one document with the links of all its texts. Very long texts are
shingled whole. Large groups are aggregated before they are shuffled or joined by
keys that adaptive execution can split; nothing but counts comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, read, written
from .graph import components

WORDS, PERCENT = 5, 75
CHUNKS, LANES, BITS, ERRORS = 8, 5, 12, 1
ROUNDS = 2
#: Classes, and shingles of their sets, that a fragment holds at most, about; a block is two fragments.
FRAGMENT, FRAGMENT_SHINGLES = 1000, 2_000_000
#: Neighbourhoods of more fragments are compared entry by entry: a class has at most CHUNKS * LANES entries.
LARGE = CHUNKS * LANES
#: Columns of the membership matrix that are multiplied at once.
COLUMNS = 2048
#: Ids of so many texts or components are sent to every task at most (16 MB each); more are joined by a shuffle.
MAX_SENT = 2_000_000

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 63, CHUNKS * LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, CHUNKS * LANES, dtype=np.uint64)
_C = _RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the different shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    h = w[:n] * _C[0]
    for i in range(1, WORDS):
        h += w[i : n + i] * _C[i]
    return np.unique(_mixed(h))


def signature(h: np.ndarray) -> np.ndarray:
    """CHUNKS numbers of LANES * BITS bits."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(least, (h[i : i + 2048, None] * _A + _B).min(0), out=least)
    lanes = (_mixed(least) >> np.uint64(64 - BITS)).reshape(CHUNKS, LANES)
    return np.bitwise_or.reduce(lanes << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)), axis=1).astype(np.int64)


SIGNATURE = [f"s{i}" for i in range(CHUNKS)]


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, digest, s0, ...) of each text; the digest is null for an empty set."""
    bounded_batches(docs.sparkSession)
    fields = ["n", "digest", *SIGNATURE]

    @F.arrow_udf("struct<n:long,digest:binary," + ",".join(f"{s}:long" for s in SIGNATURE) + ">")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, digests, signatures = [], [], []
            for t in batch.to_pylist():
                h = shingles(t)
                n.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                signatures.append(signature(h) if len(h) else np.zeros(CHUNKS, np.int64))
            s = np.array(signatures, np.int64).reshape(len(n), CHUNKS)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(s[:, i]) for i in range(CHUNKS))], fields)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint(text).alias("f")).select("doc_id", "f.*")


def _lanes(value: int) -> int:
    return sum(value << (BITS * i) for i in range(LANES))


def _kept(left_out: int) -> Column:
    return F.lit(_lanes((1 << BITS) - 1) & ~(((1 << BITS) - 1) << (BITS * left_out)))


def entries(classes: DataFrame) -> DataFrame:
    """(node, slot, entry): each chunk with each choice of one value left out."""
    keys = [F.xxhash64(F.lit(i * LANES + j), F.col(s).bitwiseAND(_kept(j))) for i, s in enumerate(SIGNATURE) for j in range(LANES)]
    return classes.select("node", F.posexplode(F.array(*keys)).alias("slot", "entry"))


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the sets in left and right are alike, as a matrix: exact counts of common shingles, by products of membership."""
    n = np.array([len(x) for x in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    common = times > 1  # what only one set has adds nothing
    row, column = row[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(common.sum()), COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[row[i:j], column[i:j] - at] = 1
        both += member[left] @ member[right].T
    return 100 * both >= PERCENT * (n[left][:, None] + n[right] - both)


def joined_in(component: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(a, b): the components a that alike sets of left and right join to others, and the smallest, b, of those."""
    names, label = np.unique(component, return_inverse=True)
    group = np.arange(len(names))
    for i, mates in zip(left, alike(sets, left, right)):
        meet = np.unique(group[label[np.append(right[mates], i)]])
        if len(meet) > 1:
            group[np.isin(group, meet)] = meet[0]
    return [(int(names[k]), int(names[g])) for k, g in enumerate(group) if k != g]


def compared(blocks: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the components that the blocks (unit, low, high) join: sets of fragment low with those of high."""

    def each(key: tuple, table: pa.Table) -> pa.Table:
        _, low, high = (k.as_py() for k in key)
        own, component = (table.column(c).to_numpy() for c in ("own", "component"))
        pairs = []
        if len(component) > 1 and (component != component[0]).any():
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
            pairs = joined_in(component, sets, np.flatnonzero(own == low), np.flatnonzero(own == high))
        return pa.table([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return blocks.groupBy("unit", "low", "high").applyInArrow(each, "a long, b long")


class Sets:
    """Full sets of the texts of `nodes`, made once, in the shared folder."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, temp: Scratch):
        nodes = temp.written(nodes, "nodes")
        rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("tq_text"))
        rows = rows.join(F.broadcast(nodes) if nodes.count() <= MAX_SENT else nodes, "node")

        @F.arrow_udf("binary")
        def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([shingles(t).tobytes() for t in batch.to_pylist()], pa.binary())

        self.sets = temp.written(rows.select("node", packed("tq_text").alias("set")), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (node, hub, ...) whose full sets are alike."""

        @F.arrow_udf("boolean")
        def confirm(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for a, b in batches:
                out = []
                for x, y in zip(a, b):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
                yield pa.array(out, pa.bool_())

        side = lambda x: self.sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"))
        return pairs.join(side("node"), "node").join(side("hub"), "hub").where(confirm("node_set", "hub_set"))


def further_joined(joined: DataFrame, edges: DataFrame, name: str, temp: Scratch) -> DataFrame:
    """joined (node, component) after edges (a, b) between components."""
    more = components(edges, temp, name).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    return joined.join(more, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))


def across(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """(entry, node, component) of the entries in which different components meet."""
    split = shared.join(joined, "node")
    mixed = split.groupBy("entry").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first <> last").select("entry")
    return split.join(mixed, "entry")


def fragments(members: DataFrame, key: str, size: DataFrame) -> DataFrame:
    """(key, fragments): how many fragments the different nodes of each key fill. size: (node, n)."""
    filled = F.ceil(F.greatest(F.count(F.lit(1)) / FRAGMENT, F.sum("n") / FRAGMENT_SHINGLES))
    return members.select(key, "node").distinct().join(size, "node").groupBy(key).agg(filled.alias("fragments"))


def connected(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, temp: Scratch) -> DataFrame:
    """(node, component) of every class that shares an entry with another one. The result reads tables of temp."""
    every = entries(classes)
    shared = every.groupBy("entry").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("entry")
    shared = temp.written(every.join(shared, "entry"), "entries")
    sets = Sets(docs, shared.select("node").distinct(), doc_id, text, temp)
    joined = sets.sets.select("node", F.col("node").alias("component")).distinct()
    for turn in range(ROUNDS):
        split = shared.join(joined, "node") if turn == 0 else temp.written(across(shared, joined), "open")
        hubs = split.groupBy("entry").agg(F.min_by(F.struct("component", "node"), F.xxhash64("component", F.lit(turn))).alias("hub"))
        meet = split.join(hubs, "entry").where(F.col("component") != F.col("hub.component"))
        named = meet.groupBy("node", "component", "hub").agg(F.count(F.lit(1)).alias("n"))
        best = named.groupBy("node", "component").agg(F.max_by("hub", F.struct("n", "hub")).alias("best")).select("node", F.col("component").alias("a"), F.col("best.node").alias("hub"), F.col("best.component").alias("b"))
        joined = temp.written(further_joined(joined, sets.confirmed(best).select("a", "b"), "hub-links", temp), "joined")

    open_ = temp.written(across(shared, joined), "open")
    # Components that open entries connect are one neighbourhood.
    least = open_.groupBy("entry").agg(F.min("component").alias("b"))
    near = components(open_.join(least, "entry").select(F.col("component").alias("a"), "b").distinct(), temp, "near")
    near = temp.written(near.select(F.col("node").alias("component"), F.col("component").alias("near")), "near-of")
    # Sent to every task if there are few; else written after the join, so that nothing keeps a large component's rows together.
    open_ = temp.written(open_.join(F.broadcast(near) if near.count() <= MAX_SENT else near, "component"), "open-near")
    size = classes.groupBy("node").agg(F.max("n").alias("n"))
    filled = temp.written(fragments(open_, "near", size), "filled")
    loose = F.col("fragments") > LARGE
    unit = F.struct(loose.alias("loose"), F.when(loose, F.col("entry")).otherwise(F.col("near")).alias("of"))
    members = temp.written(open_.join(filled, "near").select(unit.alias("unit"), "node", "component").distinct(), "members")
    # Members of a large unit are dealt to fragments, and each pair of fragments is a block of its own.
    members = members.join(fragments(members, "unit", size), "unit").withColumn("own", F.pmod(F.xxhash64("node"), "fragments"))
    members = members.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fragments") - 1)).alias("other"))
    blocks = members.select("unit", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component").join(sets.sets, "node")
    return further_joined(joined, compared(blocks), "block-links", temp)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    prints = written(fingerprints(docs, doc_id, text), "fingerprints")
    full = prints.where("digest is not null and doc_id is not null")
    with Scratch(docs.sparkSession) as temp:
        classes = temp.written(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), *(F.first(s).alias(s) for s in SIGNATURE)), "classes")
        joined = connected(docs, classes, doc_id, text, temp)
        of = written(classes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id")), "components")
    linked = full.select("doc_id", "n", "digest").join(of, "digest").select("doc_id", "n", "component_id")
    alone = prints.where("digest is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from d, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as u(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
r(x, y) as (select doc_id, doc_id from d union select r.x, e.y from r join e on e.x = r.y),
c as (select x as doc_id, min(y) as component_id from r group by x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from d join c using (doc_id) left join n using (doc_id)
"""
