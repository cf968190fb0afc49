"""A sentence splitter that learns from the corpus which full stops end no sentence.

The statistics are those of unsupervised boundary detection (Kiss and Strunk, 2006).
Words are cut at white space; a word's type is its lower-cased core, without what
stands around it and without its final stops, all numbers being one type.

1. Abbreviations: types that end in a full stop far more often than words in
   general. The likelihood ratio against "nearly always" is weighted by 1 / e^length,
   by inner stops, and by a penalty for each occurrence without a stop.
2. Starters: types that follow a sure sentence end more often than by chance.
3. Collocations: types that stand on both sides of an abbreviation's, an initial's
   or a number's stop more often than by chance, so that no sentence ends between.
4. Case: whether a type was seen with a small letter, at the start of a sentence
   too, and with a capital, within a sentence too.

Each is an aggregate over the different words and what stands before them, which one
pass over the texts counts in its tasks and writes. What is learned
comes to the driver as a `Model`: its lists hold what passes a threshold, and the
case of the `vocabulary` commonest of the types that follow a doubtful stop. The case
of all others lies in files, from which a task takes what its batch asks for. A text
is then cut in Arrow batches, in time linear in its length. Null texts give null.
"""

from __future__ import annotations

import re
import zlib
from collections import ChainMap, Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from ..sources.stream import opened
from ..sources.tables import scratch_path, written_table

# Fixed values of the method: thresholds of its scores.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
NUMBER = "##"
#: Types whose case is sent to every task; that of more lies in files of about so many types each.
VOCABULARY, FILED = 200_000, 50_000
#: Abbreviations that are sent to every task at most; more are joined by a shuffle.
MAX_SENT = 200_000

#: What is known of a type's case.
FLAGS = ("lower", "upper", "lower_at_start", "upper_within")
Case = tuple[bool, bool, bool, bool]

# What may stand around a word, and its final stops.
BEFORE, AFTER, STOPS = "\"'([{<", "\"')]}>,;:", ".!?"
_FINAL, _LAST = frozenset(STOPS), frozenset(STOPS + AFTER)
#: Different pairs of words that a task holds before it gives them on.
HELD = 500_000
NUMERIC = r"\A[-+]?[0-9][0-9.,-]*\z"


def _token(w: Column) -> Column:
    """(type, case, dot, end, dots, letters) of a word. dot: it ends in one full stop; end: in ! or ?; dots: in more stops."""
    core = F.rtrim(F.ltrim(w, F.lit(BEFORE)), F.lit(AFTER))
    bare = F.lower(F.rtrim(core, F.lit(STOPS)))
    first = F.substring(core, 1, 1)
    case = F.when(first != F.lower(first), "u").when(first != F.upper(first), "l").otherwise("")
    number = F.when(F.substring(bare, 1, 1).between("+", "9"), bare.rlike(NUMERIC)).otherwise(False)  # few words get to the pattern
    dots = core.endswith("..")
    return F.struct(F.when(number, NUMBER).otherwise(bare).alias("type"), case.alias("case"), (core.endswith(".") & ~dots).alias("dot"), (core.endswith("!") | core.endswith("?")).alias("end"), dots.alias("dots"))


def _stop(word: str) -> str:
    """Of a word that something follows, what its final stop tells: the word where that is one full stop, else the stop alone, or nothing."""
    core = word.rstrip(AFTER)
    if core[-1:] not in _FINAL:
        return ""
    return core[-1] if core[-1] != "." else ".." if core.endswith("..") else word


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, w, times) of a task's texts: each word, what stands before it, and how often. p: null before the first, "" for a word without a final stop.

    All words are counted as if such a one stood before; the few others are taken out of that count.
    """

    def part() -> pa.RecordBatch:
        p, w, n = [""] * len(plain) + [x for x, _ in others], [*plain, *(x for _, x in others)], [*plain.values(), *others.values()]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], ["p", "w", "times"])

    plain, others = Counter(), Counter()
    for batch in batches:
        for text in batch.column(0):
            words = (text.as_py() or "").split()
            if not words:
                continue
            plain.update(words)
            pairs = [(p, w) for b, w in pairwise(words) if b[-1] in _LAST and (p := _stop(b))]
            pairs.append((None, words[0]))
            others.update(pairs)
            plain.subtract(w for _, w in pairs)
            if len(plain) + len(others) > HELD:
                yield part()
                plain, others = Counter(), Counter()
    yield part()


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each different word and what stands before it (null before the first), with how often they do.

    Of a word before, only its final stop tells something, and its type only where
    that is one full stop; the rest is left out. The texts are counted in the tasks
    first, and read once.
    """
    rows = docs.select(text).mapInArrow(_pairs, "p string, w string, times long").groupBy("p", "w").agg(F.sum("times").alias("times")).where("times > 0")
    return rows.select(_token(F.col("w")).alias("t"), F.when(F.col("p").isNotNull(), _token(F.col("p"))).alias("before"), "times").select("t.*", "before", "times")


def abbreviations(words: DataFrame) -> DataFrame:
    """(type, stops, others, score) of all types with a letter that end in a full stop somewhere."""
    dot = F.col("dot").cast("long")
    types = words.groupBy("type").agg(F.sum(dot * F.col("times")).alias("stops"), F.sum((1 - dot) * F.col("times")).alias("others"))
    types = written_table(types, "sentence-types")
    return scored_abbreviations(types)


def scored_abbreviations(types: DataFrame) -> DataFrame:
    total = types.agg(F.sum("stops").alias("n_stops"), F.sum(F.col("stops") + F.col("others")).alias("n_all"))
    p = F.col("n_stops") / F.col("n_all")
    ratio = -2 * (F.col("stops") * (F.log(p) - F.log(F.lit(0.99))) + F.col("others") * (F.log(1 - p) - F.log(F.lit(0.01))))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    size = F.length("type") - inner
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), -F.col("others"))
    some = types.where((F.col("stops") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}"))
    return some.crossJoin(F.broadcast(total)).where(F.col("n_stops") < F.col("n_all")).select("type", "stops", "others", score.alias("score"))  # one row


def chance(n: Column, a: Column, b: Column, ab: Column) -> Column:
    """Twice the log-likelihood ratio of `a` and `b` of n meeting ab times, against by chance; 0 where they meet less often than that."""

    def part(hits: Column, of: Column, p: Column) -> Column:
        # x log x is 0 at 0.
        return F.when(hits > 0, hits * F.log(p)).otherwise(0.0) + F.when(of > hits, (of - hits) * F.log(1 - p)).otherwise(0.0)

    alone, together, apart = b / n, ab / a, (b - ab) / (n - a)
    ratio = 2 * (part(ab, a, together) + part(b - ab, n - a, apart) - part(ab, a, alone) - part(b - ab, n - a, alone))
    return F.when((ab * n > a * b) & (n > a), ratio).otherwise(0.0)


def contexts(words: DataFrame, known: DataFrame) -> DataFrame:
    """(before, type, doubtful, starts, n, and case flags) of the words by what stands before them.

    known: (type) of the abbreviations. `before` is the type before the word where
    its stop is doubtful, else null, so that there are not many pairs.
    """
    known = known.select(F.col("type").alias("b_type"), F.lit(True).alias("abbreviation"))
    known = F.broadcast(known) if known.count() <= MAX_SENT else known
    b = F.col("before")
    rows = words.withColumn("b_type", F.when(b["dot"], b["type"])).join(known, "b_type", "left")
    short = (b["type"] == NUMBER) | (F.length(b["type"]) == 1)
    doubtful = F.coalesce(b["dots"] | (b["dot"] & (F.col("abbreviation").isNotNull() | short)), F.lit(False))
    starts = F.coalesce((b["dot"] & F.col("abbreviation").isNull() & ~short) | b["end"], F.lit(True))  # the first word of a text too
    upper, lower = F.col("case") == "u", F.col("case") == "l"
    rows = rows.select(F.when(doubtful, F.coalesce(F.col("b_type"), F.lit(""))).alias("before"), "type", doubtful.alias("doubtful"), starts.alias("starts"), upper.alias("upper"), lower.alias("lower"), b.isNull().alias("first"), "times")
    flags = {"lower": F.max("lower"), "upper": F.max("upper"), "lower_at_start": F.max(F.col("lower") & F.col("starts")), "upper_within": F.max(F.col("upper") & ~F.col("starts") & ~F.col("doubtful"))}
    return rows.groupBy("before", "type", "doubtful", "starts").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("first"), F.col("times")).otherwise(0)).alias("n_first"), *(v.alias(k) for k, v in flags.items()))


def starters(counted: DataFrame) -> DataFrame:
    """(type, n, at, score): how often each type stands anywhere and after a sure sentence end. The first words of texts follow none."""
    types = counted.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("starts"), F.col("n") - F.col("n_first")).otherwise(0)).alias("at"))
    total = types.agg(F.sum("n").alias("n_all"), F.sum("at").alias("n_at"))
    rows = types.where((F.col("at") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}")).crossJoin(F.broadcast(total))  # one row
    return rows.select("type", "n", "at", chance(F.col("n_all"), F.col("n_at"), F.col("n"), F.col("at")).alias("score"))


def collocations(counted: DataFrame) -> DataFrame:
    """(before, type, n, score) of the pairs around a doubtful stop that are seen more than once."""
    types = counted.groupBy("type").agg(F.sum("n").alias("n"))
    total = types.agg(F.sum("n").alias("n_all"))
    pairs = counted.where("doubtful and before <> ''").groupBy("before", "type").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & F.col("type").rlike(r"[\p{L}\p{N}]|##"))
    own = types.select(F.col("type").alias("before"), F.col("n").alias("n_before"))
    rows = pairs.join(own, "before").join(types.select("type", F.col("n").alias("n_type")), "type").crossJoin(F.broadcast(total))  # one row
    return rows.select("before", "type", "n", chance(F.col("n_all"), F.col("n_before"), F.col("n_type"), F.col("n")).alias("score"))


def cases(counted: DataFrame) -> DataFrame:
    """(type, n, lower, upper, lower_at_start, upper_within) of the types that follow a doubtful stop somewhere."""
    rows = counted.groupBy("type").agg(F.sum(F.when(F.col("doubtful"), F.col("n")).otherwise(0)).alias("n"), *(F.max(f).alias(f) for f in FLAGS))
    return rows.where("n > 0")


@dataclass
class Statistics:
    """What was counted, as tables."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame


def statistics(docs: DataFrame, text: str = "text") -> Statistics:
    words = written_table(tokens(docs, text), "sentence-words")
    known = written_table(abbreviations(words).where(F.col("score") >= ABBREVIATION), "abbreviations")
    counted = written_table(contexts(words, known), "sentence-contexts")
    return Statistics(known, starters(counted).where(F.col("score") >= STARTER), collocations(counted).where(F.col("score") >= COLLOCATION), cases(counted))


_WORD = re.compile(rf"[^{WS}]+")
_CLOSED = re.compile(r"[.!?][\"')\]}>]*\Z")
_NUMERIC = re.compile(r"\A[-+]?[0-9][0-9.,-]*\Z")


@dataclass
class Filed:
    """Case of types in files of the shared folder, dealt by the types' crc32."""

    path: str
    parts: int

    @staticmethod
    def write(cases: DataFrame) -> "Filed":
        filed = Filed(scratch_path(cases.sparkSession, "sentence-cases"), -(-cases.count() // FILED))
        rows = cases.select("type", *FLAGS, (F.crc32(F.col("type").cast("binary")) % filed.parts).cast("int").alias("part"))
        rows.repartition(filed.parts, "part").write.partitionBy("part").parquet(filed.path)
        return filed

    def find(self, types: Iterable[str]) -> dict[str, Case]:
        """Of the types, those that are in the files. One part is held at a time."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        parts, found = {}, {}
        for t in types:
            parts.setdefault(zlib.crc32(t.encode()) % self.parts, []).append(t)
        fs, root = opened(self.path)
        for part, asked in parts.items():
            for info in fs.get_file_info(FileSelector(f"{root}/part={part}", allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    with fs.open_input_file(info.path) as file:
                        rows = pq.read_table(file)
                    rows = rows.filter(pc.is_in(rows["type"], value_set=pa.array(asked, pa.string())))
                    found.update(zip(rows["type"].to_pylist(), zip(*(rows[f].to_pylist() for f in FLAGS))))
        return found


class Asked:
    """Known case that notes which other types it is asked for."""

    def __init__(self, known: Mapping[str, Case]):
        self.known, self.asked = known, set()

    def get(self, kind: str, default: Case) -> Case:
        if kind not in self.known:
            self.asked.add(kind)
        return self.known.get(kind, default)


@dataclass
class Model:
    """What was learned. rest: the case of types that `cases` doesn't hold, where there are more."""

    abbreviations: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    cases: Mapping[str, Case] = field(default_factory=dict)
    rest: Filed | None = None

    @staticmethod
    def of(s: Statistics, vocabulary: int = VOCABULARY) -> "Model":
        rows = s.cases.orderBy(F.col("n").desc(), "type").limit(vocabulary + 1).collect()
        common, rest = rows[:vocabulary], None
        if len(rows) > vocabulary:
            n, kind = F.col("n"), F.col("type")
            rest = Filed.write(s.cases.where((n < common[-1].n) | ((n == common[-1].n) & (kind > common[-1].type))) if common else s.cases)
        return Model({r.type for r in s.abbreviations.select("type").collect()}, {r.type for r in s.starters.select("type").collect()},
                     {(r.before, r.type) for r in s.collocations.select("before", "type").collect()}, {r.type: tuple(r[f] for f in FLAGS) for r in common}, rest)

    def holding(self, texts: Iterable[str]) -> "Model":
        """The same with the case of all types that the texts ask for: they are cut once to see which."""
        if self.rest is None:
            return self
        seen = Asked(self.cases)
        trial = replace(self, cases=seen, rest=None)
        for text in texts:
            trial.sentences(text)
        return replace(self, cases=ChainMap(self.rest.find(seen.asked), self.cases), rest=None)

    def ends(self, word: str, following: str) -> bool:
        """Whether a sentence ends between two words, the first of which ends in . ! or ? (and closing marks)."""
        if self.rest is not None:
            return self.holding([f"{word} {following}"]).ends(word, following)
        core = word.lstrip(BEFORE).rstrip(AFTER)
        if core[-1:] in "!?":
            return True
        bare = core.rstrip(STOPS).lower()
        number = bool(_NUMERIC.match(bare))
        kind = NUMBER if number else bare
        listed, dots, short = kind in self.abbreviations, core.endswith(".."), number or len(kind) == 1
        if not (listed or dots or short):
            return True
        after = following.lstrip(BEFORE).rstrip(AFTER)
        then = after.rstrip(STOPS).lower()
        then = NUMBER if _NUMERIC.match(then) else then
        if (kind, then) in self.collocations and not dots:
            return False
        first = after[:1]
        upper, lower = first != first.lower(), first != first.upper()
        seen_lower, seen_upper, lower_at_start, upper_within = self.cases.get(then, (False,) * 4)
        likely = True if upper and seen_lower and not upper_within else False if lower and (seen_upper or not lower_at_start) else None
        if listed or dots:
            return likely is True or (upper and then in self.starters)
        if likely is not None:
            return likely
        # An initial before a name that is never written small; a number's stop ends a sentence unless something small follows.
        return not (upper and not seen_lower and not number) and not lower

    def sentences(self, text: str) -> list[str]:
        """text in sentences, white space between them left out."""
        if self.rest is not None:
            return self.holding([text]).sentences(text)
        out, start, last = [], None, None
        for m in _WORD.finditer(text):
            if start is None:
                start = m.start()
            elif last[0][-1] in _LAST and _CLOSED.search(last[0]) and self.ends(last[0], m[0]):
                out.append(text[start : last.end()])
                start = m.start()
            last = m
        return out if last is None else [*out, text[start : last.end()]]

    def splitter(self, spark: SparkSession) -> Callable[[Column], Column]:
        """The form that `chunker.rag_chunks` takes."""
        shipped = spark.sparkContext.broadcast(self)

        @F.arrow_udf("array<string>")
        def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shipped.value
            for batch in batches:
                texts = batch.to_pylist()
                held = model.holding(t for t in texts if t is not None)
                yield pa.array([None if t is None else held.sentences(t) for t in texts], pa.list_(pa.string()))

        return lambda text: cut(F.col(text) if isinstance(text, str) else text)


def trained(docs: DataFrame, text: str = "text", vocabulary: int = VOCABULARY) -> Model:
    return Model.of(statistics(docs, text), vocabulary)
