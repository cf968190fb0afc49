"""Substring dedup: repeated lines and sentences of whole documents.

A piece is a line, and a line of several sentences is cut after each of them. A
unit is a run of pieces, over line ends too, that just reaches MIN_WORDS words:
from each piece on, and back from each piece. So the units within a passage don't
depend on what stands around it, and cover all its pieces if it has MIN_WORDS
words or more. Units are normalised (lower case, words joined by one blank) and
hashed. Digests are grouped over all documents; the earliest occurrence, by
document rank and then position, stays, and every other one is removed. Removed
units keep their offsets in the original text (code points, end exclusive) and
may overlap. A unit that overlaps the first of its kind in its own document, as
in a line said over and over, is taken together with it as one longer unit.

Documents rank by `rank` (ascending, null last), then by a digest of the text;
rows equal in both are one document and get the same result. Null and empty
texts have no units. Group sizes don't matter: only one row for each digest is
made, by partial aggregates, and only removed units go back to their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, free, read, release, written

MIN_WORDS = 8
#: Digests that occur so often are joined by broadcast, if they are no more than MAX_SENT (some MB).
HOT, MAX_SENT = 10_000, 200_000
SENTENCE_END = re.compile(r"[.!?…]+[\"')\]»”]*(?=[\x20\t\x0b\x0c\r])")
BLANK = " \t\x0b\x0c\r"


def units(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(digest, start, end) of the units, by place."""
    pieces: list[tuple[int, int, int, bytes]] = []  # start, end, number of words, the words
    at = 0
    for line in (text or "").split("\n"):
        cuts = [0, *(m.end() for m in SENTENCE_END.finditer(line)), len(line)]
        for a, b in zip(cuts, cuts[1:]):
            piece = line[a:b]
            words = piece.lower().encode("utf-8", "surrogatepass").split()
            if words:
                lead = len(piece) - len(piece.lstrip(BLANK))
                pieces.append((at + a + lead, at + a + len(piece.rstrip(BLANK)), len(words), b" ".join(words)))
        at += len(line) + 1
    runs, first, held = set(), 0, 0
    for last, piece in enumerate(pieces):
        held += piece[2]
        while held >= min_words:  # the shortest run from `first` on; in the end, the one back from `last`
            if held - piece[2] < min_words or held - pieces[first][2] < min_words:
                runs.add((first, last))
            if held - pieces[first][2] < min_words:
                break
            held -= pieces[first][2]
            first += 1
    out, seen = [], {}
    for i, j in sorted(runs):
        digest = xxhash.xxh3_128_intdigest(b" ".join(p[3] for p in pieces[i : j + 1]))
        k, end = seen.setdefault(digest, (i, j))
        if k < i <= end:
            i, digest = k, xxhash.xxh3_128_intdigest(b" ".join(p[3] for p in pieces[k : j + 1]))
        out.append((digest, pieces[i][0], pieces[j][1]))
    return sorted(out, key=lambda u: u[1:])


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """text without the removed pieces; a line that loses all its words goes with its end."""
    if not removed:
        return text
    gone = np.zeros(len(text), bool)
    for a, b in removed:
        gone[a:b] = True
    lines, at = [], 0
    for line in text.split("\n"):
        mask = gone[at : at + len(line)]
        if not mask.any():
            lines.append(line)
        else:
            left = " ".join("".join(c if not g else "\n" for c, g in zip(line, mask)).replace("\n", " ").split())
            if left:
                lines.append(left)
        at += len(line) + 1
    return "\n".join(lines)


def removals(docs: DataFrame, rank: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, removed): (rank, key, n_units) of each row, and (rank, key, start, end, first_rank, first_start) of each removed unit of each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(rank).alias("rank"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))

    @F.arrow_udf("array<struct<h:long,l:long,start:int,end:int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("l", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        half, sign = (1 << 64) - 1, 1 << 63
        for batch in batches:
            yield pa.array([[((d >> 64) - sign, (d & half) - sign, a, b) for d, a, b in units(t, min_words)] for t in batch.to_pylist()], kind)

    rows = written(rows.select("rank", "key", cut("text").alias("units")), "units")
    each = rows.select("rank", "key", F.explode("units").alias("u")).select("rank", "key", "u.*")
    order = F.struct(F.col("rank").isNull().alias("no"), "rank", "key", "start")
    with Scratch(spark) as temp:
        # Digests are counted first, by partial sums of three numbers; only units of repeated ones are ordered.
        often = temp.written(each.groupBy("h", "l").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
        release(spark)
        hot = temp.written(often.where(F.col("n") >= HOT).select("h", "l"), "hot")
        few = hot.count() <= MAX_SENT
        repeated = temp.written(met(each, often.drop("n"), hot, few), "repeated-units")
        release(spark)
        first = temp.written(repeated.groupBy("h", "l").agg(F.min(order).alias("first")), "first")
        removed = met(repeated, first, hot, few).where(order != F.col("first"))
        removed = written(removed.select("rank", "key", "start", "end", F.col("first.rank").alias("first_rank"), F.col("first.start").alias("first_start")), "removed")
    return rows.select("rank", "key", F.size("units").cast("long").alias("n_units")), removed


def met(units: DataFrame, groups: DataFrame, hot: DataFrame, few: bool) -> DataFrame:
    """units with the columns of their digest's group. Digests in `hot` are sent to every task, if they are few, so that none of them is one task's."""
    if not few:
        return units.join(groups, ["h", "l"])
    sent = F.broadcast(hot)
    cold = units.join(sent, ["h", "l"], "left_anti").join(groups.join(sent, ["h", "l"], "left_anti"), ["h", "l"])
    return cold.unionByName(units.join(F.broadcast(groups.join(sent, ["h", "l"], "left_semi")), ["h", "l"]))


def by_document(docs: DataFrame, rank: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(rank, key, n_units, removed: its removed pieces in order). A document's pieces are no more than its own units."""
    rows, removed = removals(docs, rank, text, min_words)
    spans = removed.groupBy("rank", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "first_rank", "first_start"))).alias("removed"))
    spans = spans.select(F.col("rank").alias("r"), F.col("key").alias("k"), "removed")
    return rows.join(spans, F.col("rank").eqNullSafe(F.col("r")) & (F.col("key") == F.col("k")), "left").drop("r", "k")


def deduplicated(docs: DataFrame, rank: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated units taken out of `text`, and tq_removed with their offsets in the original."""
    r, k, out = (free(docs, c) for c in ("tq_rank", "tq_key", "tq_removed"))
    found = by_document(docs, rank, text, min_words).dropDuplicates(["rank", "key"]).where("removed is not null").select(F.col("rank").alias(r), F.col("key").alias(k), F.col("removed").alias(out))
    docs = docs.join(found, F.col(rank).eqNullSafe(F.col(r)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(k)), "left")

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, removed in batches:
            yield pa.array([t if t is None or not r else without(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(texts.to_pylist(), removed.to_pylist())], pa.string())

    return docs.withColumn(text, cleaned(F.col(text), F.col(out))).drop(r, k)


def stretches(units: str) -> Column:
    """What units in order of their starts cover, each place once."""
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for units in batch.to_pylist():
                out: list[dict] = []
                for u in units or []:
                    if out and u["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], u["end"])
                    else:
                        out.append({"start": u["start"], "end": u["end"]})
                rows.append(out)
            yield pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return merged(units)


def op5_unitdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its units, how many are removed, the code points that these cover, and the stretches."""
    found = by_document(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("stretches", stretches("removed"))
    pieces, covered = F.col("removed"), F.col("stretches")
    return found.select(
        F.col("rank").alias("doc_id"),
        "n_units",
        F.when(pieces.isNull(), 0).otherwise(F.size(pieces)).cast("long").alias("n_removed"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]), F.lit(0).cast("long")).alias("removed_chars"),
        F.coalesce(F.array_join(F.transform(covered, lambda x: F.concat_ws(":", x["start"], x["end"])), ","), F.lit("")).alias("removed"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(pieces, lambda x: x["first_rank"]))), F.array().cast("array<long>")).alias("first_doc_ids"),
    )


