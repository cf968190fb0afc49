"""Secret scan: known formats, and the guess cost of values in a credential context.

Three kinds of span come from fixed patterns: assignments, access keys and long
hex runs. Further values that stand after a credential word (`pwd: ...`, `the
passphrase is ...`) are taken as secrets if guessing them is expensive. The cost
is the cheapest way to build the value from segments: common words (also in leet
spelling), dates, repeats, keyboard walks, alphabetic sequences, and brute force
for the rest. A dynamic programme over the value's positions finds that minimum.
Common words are WORDS, then the corpus's own: those that stand at least MIN_TIMES
times outside credential values, MAX_WORDS at most, commonest first. So prose after
a credential word is cheap, and a copied secret doesn't become a word by its copies.

Positions are code points, ends exclusive. Null and empty texts have no spans.
Repeated rows are scanned each for itself; a value of any length is scored whole.
A column of docs named like the output stays, and the output gets underscores.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from math import inf, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, free, read

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]{24,}", re.A)
#: A credential word, then a separator, then a value in other characters than white space, quotes and angle brackets.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth|client|secret)[\x20_-]?(?:key|token|secret)|login)"""
    r"""["']?\x20*(?:=>|:=|[:=]|\x20is\x20)\x20*["']?([^\x20\t-\r"'<>]+)""", re.I | re.A)  # fmt: skip
STARTS = ("pass", "pwd", "secret", "token", "credential", "key", "login")
KINDS = ("assign", "access", "hex", "guess")

#: Words of the corpus have at most so many letters; a repeat's unit has at most MAX_UNIT characters.
LONGEST, MAX_UNIT = 24, 8
#: What each segment but the first pays for the choice of kinds.
MORE = log10(2)
#: Values shorter than this, or cheaper than 10 to the power MIN_COST guesses, are no secrets.
MIN_VALUE, MIN_COST = 6, 9.0

#: Words that guesses try first, commonest first; a word's rank is its cost.
WORDS = (
    "password pass word admin login secret token key user test guest root default welcome master hello love money "
    "dragon monkey letmein shadow sunshine princess football baseball super batman trust summer winter spring autumn "
    "monday tuesday friday sunday january february march april june july august september october november december "
    "changeme example sample demo temp null none true false value string your here enter insert placeholder api auth "
    "access private public client server data base file name mail home house black white green blue red star moon sun "
    "king queen angel lucky happy magic power energy secure security computer internet google linux windows apple orange"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}


def _longest(rank: dict[str, int]) -> int:
    """Length of the longest word, kept with the ranks that it belongs to."""
    if _KNOWN.get("of") is not rank:
        _KNOWN.update(of=rank, longest=max(map(len, rank), default=0))
    return _KNOWN["longest"]


_KNOWN: dict = {}
#: Words of the corpus that are sent to every task, and how often such a word occurs at least.
MAX_WORDS, MIN_TIMES = 20_000, 5
LEET = str.maketrans("@4380$5170!", "aaebossltoi")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(a, b) for r in ROWS for a, b in zip(r, r[1:])} | {(a, b) for up, down in zip(ROWS, ROWS[1:]) for i, a in enumerate(up) for b in down[max(0, i - 1) : i + 1]}
NEXT |= {(b, a) for a, b in NEXT}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)", re.A)


def _alphabet(c: str) -> int:
    return 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _cheapest_repeat(best: list[float], j: int, unit: int, most: int) -> float:
    """Least cost of what lies before a repeat of 2 to most units that ends at j, and of the number of units."""
    if most < 40:
        return min(best[j - m * unit] + log10(m + 1) + (MORE if j > m * unit else 0.0) for m in range(2 if unit > 1 else 3, most + 1))
    m = np.arange(2 if unit > 1 else 3, most + 1)
    return float((np.array(best)[j - m * unit] + np.log10(m + 1) + np.where(j > m * unit, MORE, 0.0)).min())


def guess_cost(value: str, rank: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation.

    best[j] is the cost of the first j characters, the least over all segments that
    may end there. Brute force goes on from the position before, a character at a
    time; every other segment adds its own cost and, unless it comes first,
    log10(2) for the choice of kinds. Kinds: words of rank (also in leet spelling),
    dates, walks and sequences of 3 characters or more, and repeats of 3 characters
    or more with units of MAX_UNIT characters at most, from any place in their run.
    """
    low, n = value.lower(), len(value)
    if len(low) != n:  # a letter whose small form is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, longest = low.translate(LEET), _longest(rank)
    walk, step = [0] * n, [0] * n  # how far a walk or sequence that ends here goes back
    for i in range(1, n):
        walk[i] = walk[i - 1] + 1 if (low[i - 1], low[i]) in NEXT else 0
        d = ord(low[i]) - ord(low[i - 1])
        step[i] = (step[i - 1] + 1 if i > 1 and ord(low[i - 1]) - ord(low[i - 2]) == d else 1) if abs(d) == 1 else 0
    again = [0] * (MAX_UNIT + 1)  # for each unit, how many characters up to here equal the one a unit before
    single = [log10(_alphabet(c)) for c in value]
    before = [0.0]
    for x in single:
        before.append(before[-1] + x)
    best = [0.0] + [inf] * n
    for j in range(1, n + 1):
        cost = best[j - 1] + single[j - 1]

        def offer(i: int, own: float) -> None:
            nonlocal cost
            cost = min(cost, best[i] + own + (MORE if i else 0.0))

        for i in range(max(0, j - longest), j - 2):
            word = low[i:j]
            upper = log10(2) if value[i:j] != word else 0.0
            if word in rank:
                offer(i, log10(rank[word] + 1) + upper)
            elif plain[i:j] in rank:
                offer(i, log10(rank[plain[i:j]] + 1) + upper + log10(4))
        if "0" <= value[j - 1] <= "9":
            for i in range(max(0, j - 10), j - 3):
                if DATE.fullmatch(value, i, j):
                    offer(i, log10(365 * 120) if j - i > 4 else log10(150))
        for back, kinds in ((walk[j - 1], 47 * 4), (step[j - 1], 72)):
            for i in range(j - 1 - back, j - 2):
                offer(i, log10(kinds * (j - i)))
        for unit in range(1, min(MAX_UNIT, j - 1) + 1):
            again[unit] = again[unit] + 1 if low[j - 1] == low[j - 1 - unit] else 0
            most = again[unit] // unit + 1
            if most >= (2 if unit > 1 else 3):
                # Brute force for the unit; in all units of a run its characters are the same but for their case.
                cost = min(cost, _cheapest_repeat(best, j, unit, most) + before[j] - before[j - unit])
        best[j] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the known formats."""
    low = text.lower()
    out = []
    if any(w in low for w in ("passw", "secret", "token", "key")):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def guessed_spans(text: str, base: list[tuple[int, int, int]], min_cost: float = MIN_COST, rank: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """Expensive values in a credential context that no known format covers."""
    low = text.lower()
    if not any(w in low for w in STARTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, value = m.start(1), m[1].rstrip(".,;:!?)]}")
        end = start + len(value)
        if len(value) >= MIN_VALUE and not any(a < end and start < b for a, b, _ in base):
            if guess_cost(value, rank) >= min_cost:
                out.append((start, end, 3))
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each stretch that spans cover replaced by mark."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


NAMES = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]


def scanned(texts: list[str | None], redact: bool, rank: dict[str, int] = RANK) -> list[tuple]:
    rows = []
    for text in texts:
        base = base_spans(text or "")
        every = base + guessed_spans(text or "", base, rank=rank)
        counts = [sum(k == i for _, _, k in base) for i in range(3)]
        rows.append((*counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every), redacted(text, every) if redact and every else text if redact else None))
    return rows


def ranks(docs: DataFrame, text: str = "text", words: Sequence[str] = WORDS) -> dict[str, int]:
    """Ranks of words, and after them of the corpus's common words outside credential values."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?i){CONTEXT.pattern}"), F.lit(" "))
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(r"(?<!\p{L})\p{L}{3,%d}(?!\p{L})" % LONGEST), F.lit(0))).alias("word"))
    common = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TIMES).orderBy(F.desc("n"), "word").limit(MAX_WORDS)
    out = {w: i + 1 for i, w in enumerate(words)}
    with Scratch(docs.sparkSession) as temp:
        # Written first, so that the tasks' commonest words meet in a task and not on the driver.
        for row in sorted(temp.written(common, "secret-words").collect(), key=lambda x: (-x.n, x.word)):
            out.setdefault(row.word, len(out) + 1)
    return out


def secrets(docs: DataFrame, text: str = "text", out: str = "secrets", redact: bool = False, words: Sequence[str] = WORDS) -> DataFrame:
    """docs with a struct column `out` (or free(docs, out)): counts, spans and, if asked for, the text with its secrets replaced."""
    bounded_batches(docs.sparkSession)
    rank, out = ranks(docs, text, words), free(docs, out)
    types = [pa.int64()] * 3 + [pa.string()] * 3

    @F.arrow_udf("struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string,redacted:string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = list(zip(*scanned(batch.to_pylist(), redact, rank))) or [()] * 6
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)

    return docs.withColumn(out, scan(docs[text]))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets(docs).select("doc_id", "secrets.*").drop("redacted")
