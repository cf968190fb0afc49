"""Personal data: known formats, and identifiers found by the contexts of known ones.

Four kinds of span come from fixed patterns: e-mail addresses, IP addresses, card
numbers and phone numbers. They are the seeds of a bootstrap over all documents:

1. An instance is a string: a seed, or an identifier-like token (MIN_LENGTH
   characters with MIN_DIGITS digits) outside all base spans. Its patterns are
   lexical: the word before it, the two words before it, the word after it, and
   the words on both sides, however far they are.
2. A pattern's confidence is the sum of the scores over all occurrences of its
   instances, over the number of times that its words occur around anything, in
   all documents, less its occurrences at instances that are not believed yet. So
   copies of a text count alike on both sides. It needs MIN_SUPPORT different
   instances that are believed already.
3. An instance's score is 1 less the product of (1 - confidence) over its kept
   patterns; from MIN_SCORE on it is believed, and counts in the next round.

Rounds go on until no further instance is believed; then each occurrence of a
believed instance is a span of the kind `context`. Words that mostly stand around
other things never become a pattern, however often they stand around a seed.

Only DataFrame functions are used. Spans are code points, ends exclusive. Null
and empty texts have none. Rows that share id and text get the same result.

Time is linear in a text but for sorting its spans: patterns are possessive, and
every array is gone through by index. A text is cut at its words with a digit or an
@, in one of which every span starts and ends; a word's neighbours are those of the
pieces around it, places are prefix sums of lengths, and spans find their words by
counts along both, sorted together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, written

KINDS = ("email", "ip", "card", "phone", "context")
# A run that fails at its first character fails at the others, so matches are tried where a run begins or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
SPACE = r"\x20\x09-\x0D"
#: A whole word with a digit or an @.
MARKED = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
OPENING = "\"'([<"
#: Sums are taken in runs of so many numbers, then over the runs.
RUN = 256
MIN_LENGTH, MIN_DIGITS = 6, 3
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 4, 0.6, 0.6
#: Patterns that are sent to every task at most (a few MB).
MAX_SENT = 100_000
#: Kinds of patterns by first letter: the word before, the two before, the word after, and those on both sides.
BEFORE, TWO, AFTER, AROUND = "b", "t", "a", "s"

SPAN = "struct<start:int,end:int,kind:int,value:string>"
NONE = f"array<{SPAN}>"


def summed(rows: DataFrame, **numbers: Column) -> DataFrame:
    """rows with the running sums of arrays of int as further columns.

    A fold copies its result at each step, so it runs over short parts, then over
    their ends. Steps are selections of their own, in which an array is a column.
    """

    def running(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["out"], acc["s"] + v).alias("out")), lambda acc: acc["out"])

    def parts(k: str) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(k) - 1, F.lit(0)), F.lit(RUN))
        return F.transform(starts, lambda at: running(F.slice(k, at + 1, F.lit(RUN))))

    rest, names = rows.columns, list(numbers)
    rows = rows.select(*rest, *(v.alias(k) for k, v in numbers.items()))
    rows = rows.select(*rest, *(parts(k).alias(k) for k in names))
    rows = rows.select(*rest, *names, *(running(F.transform(k, lambda p: F.try_element_at(p, F.lit(-1)))).alias(f"{k}_end") for k in names))
    # What a lambda takes from a column named once would be computed for each element, since Spark puts the column's expression in; so arrays are zipped.
    first = lambda k: F.concat(F.array(F.lit(0)), F.slice(f"{k}_end", F.lit(1), F.size(k) - 1))
    shifted = lambda k: F.flatten(F.zip_with(k, first(k), lambda p, before: F.transform(p, lambda v: v + before)))
    return rows.select(*rest, *(shifted(k).alias(k) for k in names))


def counted(rows: DataFrame, **asked: tuple[Column, Column, bool]) -> DataFrame:
    """rows with, for each query, how many of some places are less, or equal too: name=(places, queries, equal), arrays of int."""

    def merged(places: Column, queries: Column, equal: bool) -> Column:
        own = F.transform(places, lambda p: F.struct(p.alias("at"), F.lit(0 if equal else 1).alias("side"), F.lit(-1).alias("i")))
        return F.array_sort(F.concat(own, F.transform(queries, lambda q, i: F.struct(q.alias("at"), F.lit(1 if equal else 0).alias("side"), i.alias("i")))))

    rest, names = rows.columns, list(asked)
    rows = rows.select(*rest, *(merged(*v).alias(f"{k}_both") for k, v in asked.items()))
    rows = summed(rows, **{k: F.transform(f"{k}_both", lambda x: (x["i"] < 0).cast("int")) for k in names})
    told = lambda k: F.transform(F.array_sort(F.filter(F.zip_with(f"{k}_both", k, lambda x, n: F.struct(x["i"].alias("i"), n.alias("n"))), lambda x: x["i"] >= 0)), lambda x: x["n"])
    return rows.select(*rest, *(told(k).alias(k) for k in names))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    backwards = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2))
    return F.aggregate(F.filter(backwards, lambda v: v.isNotNull()), F.lit(0), lambda n, v: n + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def matched(rows: DataFrame) -> DataFrame:
    """(doc_id, key, base, m, p, e) of rows (doc_id, tq_text): the base spans in order; the marked words, the pieces around them, and their ends."""
    text, strings, ints = F.col("tq_text"), F.array().cast("array<string>"), F.array().cast("array<int>")
    number = text.rlike("[0-9]")
    kinds = {"k0": (EMAIL, F.contains(text, F.lit("@"))), "k1": (IP, number), "k2": (CARD, number), "k3": (PHONE, F.contains(text, F.lit("+"))), "m": (MARKED, F.lit(True))}
    found = rows.select("doc_id", F.xxhash64("tq_text").alias("key"), "tq_text", *(F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(strings).alias(k) for k, (pattern, some) in kinds.items()))
    # Texts are split only where something matched.
    between = lambda k: F.when(F.size(k) > 0, F.split(text, kinds[k][0], -1))
    lengths = [F.coalesce(F.transform(between(k), F.length), ints).alias(f"{k}_between") for k in kinds if k != "m"]
    found = found.select("doc_id", "key", *kinds, *lengths, F.coalesce(between("m"), strings).alias("p"))
    found = found.withColumn("m_between", F.transform("p", F.length))
    ends = {f"{k}_ends": F.zip_with(k, F.slice(f"{k}_between", F.lit(1), F.size(k)), lambda m, n: F.length(m) + n) for k in kinds}
    found = summed(found, **ends)
    spans = [F.zip_with(f"k{i}", f"k{i}_ends", lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(i).alias("kind"), m.alias("value"))) for i in range(4)]
    kept = (
        lambda s: F.lit(True),
        lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        lambda s: F.length(digits(s["value"])).between(14, 19) & luhn(digits(s["value"])),
        lambda s: F.length(digits(s["value"])).between(10, 15),
    )
    base = F.array_sort(F.concat(*(F.filter(x, k) for x, k in zip(spans, kept))))
    return found.select("doc_id", "key", base.alias("base"), "m", "p", F.col("m_ends").alias("e"))


def marked_words(rows: DataFrame) -> DataFrame:
    """rows of `matched` with `words`: (start, end, value, opening, before, two, after) of each marked word.

    opening: how many of its characters open a bracket or quote before anything
    else. The other words of the text stand in the pieces between marked ones.
    """
    rest = ["doc_id", "key", "base"]
    word, blank = rf"(?<![^{SPACE}])([^{SPACE}]++)", f"[{SPACE}]"
    ends = lambda x: F.struct(F.regexp_extract(x, rf"{word}{blank}*+\z", 1).alias("last"), F.regexp_extract(x, rf"{word}{blank}++[^{SPACE}]++{blank}*+\z", 1).alias("second"), F.regexp_extract(x, rf"\A{blank}*+([^{SPACE}]++)", 1).alias("first"))
    rows = rows.select(*rest, "m", F.transform("p", ends).alias("t"), "e")
    m, t = F.col("m"), F.col("t")
    # The words before the k-th marked one: of the piece before it, else the marked one before.
    before = F.transform(m, lambda w, k: F.when(t[k]["last"] != "", t[k]["last"]).otherwise(F.get(m, k - 1)))
    rows = rows.select(*rest, "m", "t", "e", before.alias("b"))
    two = lambda k: F.when(t[k]["second"] != "", t[k]["second"]).when(t[k]["last"] != "", F.get(m, k - 1)).otherwise(F.get(F.col("b"), k - 1))
    after = lambda k: F.when(t[k + 1]["first"] != "", t[k + 1]["first"]).otherwise(F.get(m, k + 1))

    def told(w, k):
        end = F.col("e")[k]
        return F.struct((end - F.length(w)).alias("start"), end.alias("end"), w.alias("value"), (F.length(w) - F.length(F.ltrim(w, F.lit(OPENING)))).alias("opening"), F.lower(F.col("b")[k]).alias("before"), F.lower(two(k)).alias("two"), F.lower(after(k)).alias("after"))

    return rows.select(*rest, F.transform(m, told).alias("words"))


def patterns_of(start: Column, value: Column, first: Column, last: Column) -> Column:
    """The patterns of an instance that starts in the marked word `first` and ends in `last`. Within its word only opening marks may stand before it."""
    led = start - first["start"] <= first["opening"]
    b, t, a = F.when(led, first["before"]), F.when(led, first["two"]), last["after"]
    made = F.array(
        F.concat(F.lit(BEFORE + " "), b),
        F.concat(F.lit(TWO + " "), t, F.lit(" "), b),
        F.concat(F.lit(AFTER + " "), a),
        F.when(~value.rlike(f"[{SPACE}]"), F.concat(F.lit(AROUND + " "), b, F.lit(" "), a)),
    )
    return F.array_compact(made)  # of a word that isn't there there is no pattern


def seeds(base: Column, words: Column, at: Column, to: Column) -> Column:
    """(patterns, value, n) of each span. n is 0 where the span before starts at the same place, which is one occurrence."""

    numbered = F.zip_with(base, F.zip_with(at, to, lambda a, t: F.struct(a.alias("at"), t.alias("to"))), lambda s, x: F.struct(s.alias("s"), x["at"].alias("at"), x["to"].alias("to")))

    def one(x, i):
        s = x["s"]
        again = F.coalesce(F.get(base, i - 1)["start"] == s["start"], F.lit(False))
        return F.struct(patterns_of(s["start"], s["value"], F.get(words, x["at"] - 1), F.get(words, x["to"])).alias("patterns"), s["value"].alias("value"), F.when(again, 0).otherwise(1).alias("n"))

    return F.transform(numbered, one)


def cores(words: Column) -> Column:
    """(value, start, end, k) of the identifier-like cores of the marked words, k being the word's number."""

    def core(w, k):
        start = w["end"] - F.length(F.regexp_replace(w["value"], r"^[^A-Za-z0-9]*+", ""))
        value = F.regexp_extract(w["value"], r"^[^A-Za-z0-9]*+(.*[A-Za-z0-9])[^A-Za-z0-9]*$", 1)
        return F.struct(value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end"), k.alias("k"))

    return F.filter(F.transform(words, core), lambda x: (F.length(x["value"]) >= MIN_LENGTH) & (F.length(digits(x["value"])) >= MIN_DIGITS))


def instances(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, base, seeds, tokens) of each row: its base spans, those with their patterns, and the identifier-like tokens outside them."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("tq_text"))
    rows = marked_words(matched(own))
    rows = rows.select("*", cores(F.col("words")).alias("cores"))
    span, word, core = F.col("base"), F.col("words"), F.col("cores")
    # Spans find the marked words that they start and end in. A core meets a span where more spans start before its end than end before its start.
    rows = counted(rows, at=(word["start"], span["start"], True), to=(word["end"], span["end"], False), begun=(span["start"], core["end"], False), over=(span["end"], core["start"], True))
    rows = rows.select("doc_id", "key", "base", "words", "cores", seeds(span, word, F.col("at"), F.col("to")).alias("seeds"), F.zip_with("begun", "over", lambda a, b: a > b).alias("met"))
    free = F.filter(F.zip_with(core, "met", lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda y: ~y["m"])
    tokens = F.transform(free, lambda y: F.struct(patterns_of(y["x"]["start"], y["x"]["value"], F.get(word, y["x"]["k"]), F.get(word, y["x"]["k"])).alias("patterns"), y["x"]["value"].alias("value"), y["x"]["start"].alias("start"), y["x"]["end"].alias("end")))
    return rows.select("doc_id", "key", "base", "seeds", tokens.alias("tokens"))


def occurrences(texts: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each of the patterns occur in all texts, one word apart where they stand around.

    At most MAX_SENT patterns are sent to every task: words that stand in none of
    them are dropped before any pattern is made. More are joined by a shuffle, after
    the patterns of each task have been counted.
    """
    def each(words: Column) -> Column:
        return F.transform(words, lambda x, i: F.struct(x.alias("w"), F.get(words, i - 1).alias("before"), F.get(words, i + 2).alias("after")))

    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"[^{SPACE}]+"), F.lit(0))
    # The words are bound once, as the element of a one-element array.
    every = texts.select(F.explode(F.flatten(F.transform(F.array(words), each))).alias("x")).select("x.*")
    few = patterns.count() <= MAX_SENT
    if few:
        kind = F.substring("pattern", 1, 1)
        # The word of a pattern that its others are counted from.
        anchors = patterns.select(F.when(kind == AROUND, F.split("pattern", " ")[1]).otherwise(F.substring_index("pattern", " ", -1)).alias("w")).distinct()
        every = every.join(F.broadcast(anchors), "w", "left_semi")
    w = F.col("w")
    made = {BEFORE: w, TWO: F.concat("before", F.lit(" "), w), AFTER: w, AROUND: F.concat(w, F.lit(" "), F.col("after"))}
    every = every.select(F.explode(F.array(*(F.concat(F.lit(k + " "), v) for k, v in made.items()))).alias("pattern"))
    every = every.join(F.broadcast(patterns), "pattern", "left_semi") if few else every
    counted = every.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    return counted if few else counted.join(patterns, "pattern", "left_semi")


def believed(found: DataFrame, texts: DataFrame, text: str, temp: Scratch) -> DataFrame:
    """(value) of the instances that the graph of patterns and instances supports. found: (pattern, value, seed, n)."""
    graph = temp.written(found.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")), "graph")
    known_ids = graph.where("seed").select("value").distinct()
    scores = temp.written(known_ids.withColumn("score", F.lit(1.0)), "scores")
    totals = graph.select("pattern", F.lit(0).cast("long").alias("total")).limit(0)
    before, n = -1, scores.count()
    while n > before:
        own = graph.join(scores, "value", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        known = F.col("score") >= MIN_SCORE
        patterns = own.groupBy("pattern").agg(F.sum(F.col("score") * F.col("n")).alias("good"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("open"), F.count(F.when(known, 1)).alias("support"))
        patterns = temp.written(patterns.where(F.col("support") >= MIN_SUPPORT), "patterns")
        fresh = temp.written(patterns.join(totals, "pattern", "left_anti").select("pattern"), "fresh")
        if not fresh.isEmpty():
            totals = totals.unionAll(temp.written(occurrences(texts, text, fresh), "totals"))
        decided = F.col("total") - F.col("open")
        patterns = patterns.join(totals, "pattern").where((decided > 0) & (F.col("good") >= MIN_CONFIDENCE * decided))
        patterns = patterns.select("pattern", F.least(F.col("good") / decided, F.lit(0.999)).alias("confidence"))
        reached = graph.join(patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        scores = temp.written(reached.unionAll(scores).groupBy("value").agg(F.max("score").alias("score")).where(F.col("score") >= MIN_SCORE), "scores")
        before, n = n, scores.count()  # a believed instance stays so, and their number is bounded
    return scores.join(known_ids, "value", "left_anti").select("value")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of spans of each row, without and with those found by context."""
    rows = instances(docs, doc_id, text)
    rows = written(rows, "pii")
    with Scratch(docs.sparkSession) as temp:
        known = rows.select(F.explode("seeds").alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.value", F.lit(True).alias("seed"), "x.n")
        every = rows.select("doc_id", "key", F.explode("tokens").alias("x")).select("doc_id", "key", "x.*")
        new = believed(known.unionAll(every.select(F.explode("patterns").alias("pattern"), "value", F.lit(False).alias("seed"), F.lit(1).alias("n"))), docs, text, temp)
        more = every.join(new, "value").select("doc_id", "key", F.struct("start", "end", F.lit(4).alias("kind"), "value").alias("s")).distinct()
        # No more than a document's own tokens.
        more = more.groupBy("doc_id", "key").agg(F.collect_list("s").alias("more")).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "more")
        more = written(more, "pii-contexts")
    joined = rows.select("doc_id", "key", "base").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(NONE)))).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {i})")).cast("long").alias(f"n_{KINDS[i]}") for i in range(4)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
