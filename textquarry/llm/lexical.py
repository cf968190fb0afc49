"""Ranked lexical search: every item against all documents, as a blocked sparse matrix product.

Scores are the product of two sparse matrices: items by terms, holding how often
a term stands in an item, and terms by documents, holding int64 impacts
w * (1e9 * tf div (1000 * tf + 8 * m)). Both are cut into blocks:

1. Items are taken in blocks of about ITEM_BYTES of text, whose terms are known to
   every task. One pass over the texts writes, of each document, its length and the
   counts of those terms, and of each task how many of its documents hold a term.
   The latter are summed up to N, L and df.
2. Each Arrow batch of those rows is a block of documents. It is turned into rows by
   term; an item's row of the product merges the rows of its terms into one dense
   accumulator (Gustavson), and the k best of the block meet the k best so far.
3. The k best of each task are reduced over groups of tasks, then over all.

Weights are floor(1000 * ln((2N + 2) / (2df + 1))) in doubles; the rest is integer, so
results don't depend on how rows are dealt. Equal scores go by ascending id, null
ids last; rows with equal ids are separate documents. Null and empty texts have
no term: such documents count for nothing and such items have no row. Items that
repeat are separate queries. Fewer than k documents above 0 give fewer rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, read, written

K = 10
ITEM_BYTES = 4 << 20
#: Groups of tasks whose best are reduced first.
GROUPS = 64
#: Every byte as it counts in a term: A-Z lower-cased, what ends a term as a blank; bytes of characters beyond ASCII stay.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def counted(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term of the vocabulary, and a row with `held` for each task: N, L, terms and their df."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("held", T.LongType()), T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        size, held, total, id_type = len(known), 0, 0, None
        df = np.zeros(size, np.int64)

        def rows(held, ids, n, ends, terms, counts) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), ids, pa.array(n, pa.int64()), *lists], schema.fieldNames())

        for batch in batches:
            id_type = batch.schema.field(0).type
            lengths, found = [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(t) if t else []
                lengths.append(len(words))
                found.append(np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words)))
            n = np.array(lengths, np.int64)
            held, total = held + int((n > 0).sum()), total + int(n.sum())
            keys = np.concatenate(found) if found else np.zeros(0, np.int64)
            keys += np.repeat(np.arange(len(n)) * size, n) * (keys >= 0)
            keys, counts = np.unique(keys[keys >= 0], return_counts=True)
            at, terms = np.divmod(keys, max(size, 1))
            df += np.bincount(terms, minlength=size)
            each = np.bincount(at, minlength=len(n))
            some = np.flatnonzero(each)
            if len(some):
                ends = np.concatenate([[0], np.cumsum(each[some])])
                yield rows(np.full(len(some), None), batch.column(0).take(pa.array(some)), n[some], ends, terms, counts)
        if held:
            some = np.flatnonzero(df)
            yield rows([held], pa.nulls(1, id_type), [total], [0, len(some)], some, df[some])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(count, schema)


def transposed(terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by term: (starts, documents, impacts)."""
    order = np.argsort(terms, kind="stable")
    return np.searchsorted(terms[order], np.arange(size + 1)), docs[order], impacts[order]


def merged(query: list[tuple[int, int]], starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, scores: np.ndarray) -> None:
    """One row of the product into `scores`: the rows of the item's terms, each times its count. No row names a document twice."""
    scores[:] = 0
    for term, times in query:
        row = slice(starts[term], starts[term + 1])
        scores[docs[row]] += times * impacts[row]


def best(scores: np.ndarray, k: int, least: int) -> np.ndarray:
    """Places of the k highest scores of `least` and more, highest first, equal ones by place."""
    some = np.flatnonzero(scores >= least)
    if len(some) > k:
        bar = np.partition(scores[some], len(some) - k)[len(some) - k]
        above = some[scores[some] > bar]
        some = np.concatenate([above, some[scores[some] == bar][: k - len(above)]])
    return some[np.lexsort((some, -scores[some]))]


def ranked_in_tasks(rows: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score, part): the k best documents of each task for each item."""
    shipped = rows.sparkSession.sparkContext.broadcast((queries, weights))
    schema = T.StructType([T.StructField("item", T.IntegerType()), rows.schema["doc_id"], T.StructField("score", T.LongType()), T.StructField("part", T.IntegerType())])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shipped.value
        top: list[list[tuple]] = [[] for _ in queries]
        id_type = None
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.select(["doc_id"]), [("doc_id", "ascending")]))  # places within the block are in the order of ids, nulls last
            ids, id_type = batch.column("doc_id"), batch.schema.field("doc_id").type
            terms, tf = batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            each = pc.list_value_length(batch.column("terms")).to_numpy()
            m = 25 + 75 * batch.column("n").to_numpy() * n_docs // n_terms
            docs = np.repeat(np.arange(len(each)), each)
            impacts = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
            by_term = transposed(terms, docs, impacts, len(weights))
            scores = np.zeros(len(each), np.int64)
            for item, query in enumerate(queries):
                merged(query, *by_term, scores)
                own = top[item]
                places = best(scores, k, own[-1][0] if len(own) == k else 1)
                if len(places):
                    new = list(zip(scores[places].tolist(), ids.take(pa.array(places)).to_pylist()))
                    top[item] = sorted(own + new, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        rows = [(i, d, s) for i, own in enumerate(top) for s, d in own]
        if rows:
            item, doc, score = zip(*rows)
            part = pa.array([TaskContext.get().partitionId() % GROUPS] * len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, id_type), pa.array(score, pa.int64()), part], schema.fieldNames())

    return rows.mapInArrow(product, schema)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    id_kind = items.schema["item_id"].dataType
    out = T.StructType([T.StructField("item_id", id_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    found = []
    for b in range(blocks):
        own = items.where(F.col("block") == b).collect()  # about `block` bytes of text
        counts = [Counter(terms_of(r.text.encode("utf-8", "replace"))) if r.text else Counter() for r in own]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        if not vocabulary:
            continue
        with Scratch(spark) as temp:
            rows = temp.written(counted(docs, doc_id, text, vocabulary), "terms")
            totals = rows.where("held is not null")
            sums = totals.agg(F.sum("held"), F.sum("n")).first()
            if not sums[0]:
                continue
            df = totals.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
            weights = np.zeros(len(vocabulary), np.int64)
            for r in df.collect():  # the block's terms
                weights[r.terms] = math.floor(1000 * math.log((2 * sums[0] + 2) / (2 * r.df + 1)))
            queries = [[(vocabulary[t], n) for t, n in c.items()] for c in counts]
            ranked = ranked_in_tasks(rows.where("held is null").drop("held"), queries, weights, sums[0], sums[1], k)
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            for group in (["item", "part"], ["item"]):
                ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_kind)]))
            found.append(written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    result = spark.createDataFrame([], out)
    for one in found:
        result = result.unionAll(one)
    return result if not found else found[0] if len(found) == 1 else result


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


SQL = r"""
with folded as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words, row_number() over () as r from documents),
items as (select item_id, row_number() over () as q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
totals as (select count(*) as n_docs, sum(len(words))::bigint as n_terms from folded where len(words) > 0),
tf as (select r, any_value(doc_id) as doc_id, term, count(*) as tf from (select r, doc_id, unnest(words) as term from folded) group by r, term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, totals where term in (select term from items) group by term, n_docs),
impacts as (select tf.r, tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(words) * n_docs) // n_terms))) as impact
  from tf join weights using (term) join folded on folded.r = tf.r, totals),
scores as (select q, item_id, i.r, i.doc_id, sum(impact)::bigint as score from items join impacts i using (term) group by q, item_id, i.r, i.doc_id)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scores where score > 0) where rank <= 10
"""
