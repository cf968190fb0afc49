"""Quality rules as a short-circuit cascade.

Every text gets its base metrics in one pass. A text that passes the base rule
then goes through the further rules, one after another, until one rejects it:
metrics that only a later rule needs are not computed for it. The order of the
rules comes from a random sample of bounded size: at each step the rule that rejects most of
the survivors per second of its own cost goes next. A verdict is a conjunction,
so the order changes the time and never the result.

Null and empty texts have no words, fail the base rule and are not kept. Rows
with equal or null ids are judged each for itself; other columns are passed on, and
where docs has a column named like the output, the output gets underscores.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free, read

MIN_WORDS = 50
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NO_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())
#: Texts from which the order of the rules is estimated.
SAMPLE = 300


class Doc:
    """A text and the metrics that its rules have asked for so far."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")
        self.words = self.data.split()
        self.n_words = len(self.words)
        self.word_chars = len(self.text) - (len(self.data) - len(self.data.translate(None, SPACE)))
        self.n_symbols = len(self.data) - len(self.data.translate(None, SYMBOLS))
        lines = [x for x in self.data.split(b"\n") if x.strip(SPACE)]
        self.n_lines = len(lines)
        self.n_dup_lines = self.n_lines - len(set(lines))
        self.n_repeat_words = repeated_words(self.words)
        self.lines = lines

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    v = len(ids)
    pair = w[:-1] * v + w[1:]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, window, counts = np.unique(pair[:-1] * v + w[2:], return_inverse=True, return_counts=True)
    twice = counts[window] > 1
    if not twice.any():
        return 0
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def short_or_long_words(d: Doc) -> bool:
    return d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words


def many_symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > d.n_words


def repeated_lines(d: Doc) -> bool:
    return 2 * d.n_dup_lines > d.n_lines


def few_alphabetic_words(d: Doc) -> bool:
    return 5 * sum(bool(w.translate(None, NO_LETTER)) for w in d.words) < 3 * d.n_words


def few_different_words(d: Doc) -> bool:
    return 20 * len(set(d.words)) < d.n_words


def one_word_dominates(d: Doc) -> bool:
    return 10 * max(Counter(d.words).values()) > 3 * d.n_words


def shouted_marks(d: Doc) -> bool:
    return 10 * (d.data.count(b"!!") + d.data.count(b"??")) > d.n_words


def mostly_bullets(d: Doc) -> bool:
    marks = (b"-", b"*", b"\xe2\x80\xa2")
    return 10 * sum(x.lstrip(SPACE).startswith(marks) for x in d.lines) > 9 * d.n_lines


def mostly_ellipses(d: Doc) -> bool:
    return 10 * sum(x.rstrip(SPACE).endswith((b"...", b"\xe2\x80\xa6")) for x in d.lines) > 3 * d.n_lines


RULES = tuple(Rule(f.__name__, f) for f in (few_different_words, one_word_dominates, few_alphabetic_words, mostly_bullets, mostly_ellipses, shouted_marks, repeated_lines, many_symbols, short_or_long_words))


def ordered(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejection per cost, each measured on the sample's texts that the rules before it leave."""
    left = [d for d in map(Doc, texts) if not d.base_failed]
    cost, verdict = {}, {}
    for rule in rules:
        began = time.perf_counter()
        verdict[rule] = [rule.rejects(d) for d in left]
        cost[rule] = time.perf_counter() - began + 1e-9
    out, alive = [], set(range(len(left)))
    while len(out) < len(rules):
        best = max((r for r in rules if r not in out), key=lambda r: (sum(verdict[r][i] for i in alive) / cost[r], -cost[r]))
        out.append(best)
        alive -= {i for i in alive if verdict[best][i]}
    return tuple(out)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judged(texts: list[str | None], rules: tuple[Rule, ...]) -> list[tuple]:
    rows = []
    for text in texts:
        d = Doc(text)
        kept = not d.base_failed and not any(r.rejects(d) for r in rules)
        rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed, kept))
    return rows


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, out: str = "quality") -> DataFrame:
    """docs with a struct column `out` (or free(docs, out)): the base metrics and the verdict of each text."""
    bounded_batches(docs.sparkSession)
    out = free(docs, out)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in batches for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"at": pa.array([rules.index(r) for r in ordered(texts, rules)], pa.int64())})

    # Drawn over the whole table, so that no task gets more than some times the sample; estimated in one task, and only the order comes to the driver.
    share = min(1.0, 4 * sample / max(1, docs.count()))
    drawn = docs.select(text).sample(share, 1).orderBy(F.rand(1)).limit(sample).coalesce(1)
    cascade = tuple(rules[r["at"]] for r in drawn.mapInArrow(estimate, "at long").collect()) or rules  # an empty table has no task
    types = [pa.int64()] * 5 + [pa.bool_()] * 2
    names = [x.split()[0] for x in OUT.split(", ")]

    @F.arrow_udf(f"struct<{OUT.replace(' ', ':').replace(',:', ',')}>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = list(zip(*judged(batch.to_pylist(), cascade))) or [()] * 7
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.withColumn(out, judge(docs[text]))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "quality.*")


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
r as (select row_number() over () as rid, doc_id, text from d),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from r),
t as (select rid, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from w, unnest(range(1, len(ws) - 1)) as u(i)),
g as (select rid, i, count(*) over (partition by rid, a, b, c) as n from t),
p as (select rid, count(distinct i + k) as n from g, unnest([0, 1, 2]) as v(k) where n > 1 group by rid),
tops as (select rid, max(n) as top, count(*) as kinds from (select rid, x, count(*) as n from (select rid, unnest(ws) as x from w) group by rid, x) group by rid),
m as (select w.rid, doc_id, text, ls, ws, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
        coalesce(p.n, 0) as n_repeat_words, coalesce(top, 0) as top, coalesce(kinds, 0) as kinds
      from w left join p using (rid) left join tops using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_symbols > n_words
    or 2 * n_dup_lines > len(ls)
    or 5 * len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) < 3 * n_words
    or 20 * kinds < n_words or 10 * top > 3 * n_words
    or 10 * (len(regexp_extract_all(text, '!!')) + len(regexp_extract_all(text, '\?\?'))) > n_words
    or 10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)'))) > 9 * len(ls)
    or 10 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(ls)) as kept
from f
"""
