"""Sentences and overlapping chunks.

A chunk is always a slice of the sentence array, since the overlap is the
sentences before the current one; so the state is (start, words) and a chunk is
(start, end). `chunks` is that fold as one Catalyst expression; `chunks_arrow`
is the same in an Arrow function, which is faster on long documents because an
interpreted fold copies its accumulator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, metadata, word_count
from .sections import bound, sections

MAX_WORDS, OVERLAP, TINY = 350, 2, 15
#: What ends in a full stop without ending a sentence.
ABBREVIATIONS = ("G.R", "A.M", "A.C", "No", "Nos", "vs", "v", "Jr", "Sr", "Mr", "Mrs", "Ms", "Dr", "Atty", "Hon", "Art", "Sec", "Inc", "Co", "Corp", "etc", "e.g", "i.e")

Splitter = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentences(text: Column | str) -> Column:
    """Cut after `.`, `!` and `?` before white space; blank pieces are left out."""
    cut = F.split(F.regexp_replace(_col(text), rf"([.!?])[{WS}]+", "$1\u0001"), "\u0001", -1)
    return F.filter(cut, lambda s: s.rlike(rf"[^{WS}]"))


def sentences_legal(text: Column | str) -> Column:
    """The same, but not after abbreviations and initials."""
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    kept = F.regexp_replace(_col(text), rf"(?<![A-Za-z])({known}|[A-Z](?:\.[A-Z])*)\.([{WS}])", "$1\u0002$2")
    return F.transform(sentences(kept), lambda s: F.replace(s, F.lit("\u0002"), F.lit(".")))


def chunks(sents: Column | str, max_words: int = MAX_WORDS, overlap: int = OVERLAP, tiny: int = TINY) -> Column:
    """array<string> of chunks of a sentence array, which is computed once."""
    return bound(_col(sents), lambda s: bound(F.transform(s, word_count), lambda counts: _chunks(s, counts, max_words, overlap, tiny)))


def _chunks(sents: Column, counts: Column, max_words: int, overlap: int, tiny: int) -> Column:
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("words"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def fold(whole: Column) -> Column:
        def step(s, n):
            fits = s["words"] + n <= max_words
            start = F.greatest(s["i"] - overlap, F.lit(0))
            again = F.aggregate(F.slice(whole, start + 1, s["i"] - start + 1), F.lit(0), lambda x, y: x + y)
            emitted = F.when(s["i"] > 0, F.array_append(s["out"], F.struct(s["start"].alias("a"), s["i"].alias("b")))).otherwise(s["out"])
            return F.struct(
                (s["i"] + 1).alias("i"),
                F.when(fits, s["start"]).otherwise(start).alias("start"),
                F.when(fits, s["words"] + n).otherwise(again).alias("words"),
                F.when(fits, s["out"]).otherwise(emitted).alias("out"),
            )

        return F.aggregate(whole, zero, step, lambda s: F.when(s["i"] > 0, F.array_append(s["out"], F.struct(s["start"].alias("a"), s["i"].alias("b")))).otherwise(s["out"]))

    def part(values: Column, x: Column) -> Column:
        return F.slice(values, x["a"] + 1, x["b"] - x["a"])

    def merge(out, x):
        text, n = F.array_join(part(sents, x), " "), F.aggregate(part(counts, x), F.lit(0), lambda a, b: a + b)
        last = F.concat(F.element_at(out, -1), F.lit(" "), text)
        return F.when((n < tiny) & (F.size(out) > 0), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), last)).otherwise(F.array_append(out, text))

    return F.aggregate(fold(counts), F.array().cast("array<string>"), merge)


def slices_of(counts: list[int], max_words: int, overlap: int) -> list[tuple[int, int]]:
    out, start, words = [], 0, 0
    for i, n in enumerate(counts):
        if words + n <= max_words:
            words += n
            continue
        if i:
            out.append((start, i))
        start = max(0, i - overlap)
        words = sum(counts[start : i + 1])
    return [*out, (start, len(counts))] if counts else []


def chunked(sents: list[str], max_words: int = MAX_WORDS, overlap: int = OVERLAP, tiny: int = TINY) -> list[str]:
    """Slices as texts; a slice of few words goes to the chunk before it."""
    counts = [len(s.split()) for s in sents]
    runs = slices_of(counts, max_words, overlap)
    heads = [k for k, (a, b) in enumerate(runs) if k == 0 or sum(counts[a:b]) >= tiny]
    return [" ".join(" ".join(sents[a:b]) for a, b in runs[k:n]) for k, n in zip(heads, [*heads[1:], len(runs)])]


def chunks_arrow(sents: Column | str, max_words: int = MAX_WORDS, overlap: int = OVERLAP, tiny: int = TINY) -> Column:
    @F.arrow_udf("array<string>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if s is None else chunked(s, max_words, overlap, tiny) for s in batch.to_pylist()], pa.list_(pa.string()))

    return apply(_col(sents))


def rag_chunks(docs: DataFrame, text: str = "text", max_words: int = MAX_WORDS, overlap: int = OVERLAP, splitter: Splitter = sentences, arrow: bool = True) -> DataFrame:
    """docs' other columns with case_no, division, title, section_pos, section, chunk_index and the chunk's text.

    chunk_index starts at 0 in each section. Everything is narrow.
    """
    others = [F.col(c) for c in docs.columns if c != text]
    # Outer forms, since a filter on the size of what is exploded would compute it twice; of a text without sections or chunks no row stays.
    meta = docs.select(*others, metadata(text).alias("tq_meta"), sections(text).alias("tq_sections"))
    meta = meta.select(*others, "tq_meta", F.posexplode_outer("tq_sections").alias("section_pos", "tq_section")).where("section_pos is not null")
    cut = (chunks_arrow if arrow else chunks)(splitter(F.col("tq_section.text")), max_words, overlap)
    rows = meta.select(*others, "tq_meta.*", "section_pos", F.col("tq_section.name").alias("section"), cut.alias("tq_chunks"))
    return rows.select(*others, "case_no", "division", "title", "section_pos", "section", F.posexplode_outer("tq_chunks").alias("chunk_index", "text")).where("chunk_index is not null")
