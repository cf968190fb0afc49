"""Text functions with the white-space and line rules of Unicode text processing, as Column expressions.

Java's `\\s`, `trim` and `$` know fewer characters or more places, so classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode strings, inside a character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters as a string. Trimming looks at a text's ends alone, where a pattern would be tried at each character.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: What is none, as a class. Nearly all of it is decided by the first range; the negated class alone is tried range by range.
INK = rf"[!-~[^{WS}]]"
ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# The patterns that define case number and division, and the lines that are no title.
CASE_NO = rf"G\.[{WS}]*R\.[{WS}]*No[s]?\.[{WS}]*([A-Za-z0-9\-]+)"
DIVISION = rf"(?iuU)\b(FIRST|SECOND|THIRD)[{WS}]+DIVISION\b|\bEN[{WS}]+BANC\b"
NO_TITLE = r"(?iu)Republic of the Philippines|Supreme Court"
DIVISION_HEADING = r"(?s)\n([A-Z ]+DIVISION\n.*)\z"
TITLE_LINES = 20
#: Characters in which a title is looked for first.
TITLE_CHARS = 2000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(BLANKS))


def lstrip(text: Column | str) -> Column:
    return F.ltrim(_col(text), F.lit(BLANKS))


def lines(text: Column | str) -> Column:
    """Lines ended by any line boundary of Unicode text."""
    return F.split(_col(text), LINE_END, -1)


def word_count(text: Column | str) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_count(_col(text), F.lit(f"{INK}+"))


def division_cut(text: Column | str) -> Column:
    """What follows the line end before the first `... DIVISION` line, without leading white space; else the text as it is."""
    tail = F.regexp_extract(_col(text), DIVISION_HEADING, 1)
    return F.when(tail == "", _col(text)).otherwise(lstrip(tail))


def case_no(text: Column | str) -> Column:
    return F.regexp_substr(_col(text), F.lit(CASE_NO))


def division(text: Column | str) -> Column:
    return F.upper(F.regexp_substr(_col(text), F.lit(DIVISION)))


def _first_title(some_lines: Column) -> Column:
    """The first of the first non-blank lines that isn't boilerplate, else null."""
    found = F.filter(F.transform(some_lines, strip), lambda line: line != "")
    return F.try_element_at(F.filter(F.slice(found, 1, TITLE_LINES), lambda line: ~line.rlike(NO_TITLE)), F.lit(1))


def title(text: Column | str) -> Column:
    """The first of the first non-blank lines that isn't boilerplate, else null.

    Mostly it is among the whole lines of the first characters; only where it isn't
    is more of the text taken apart, and no more than these lines.
    """
    text = _col(text)
    start = lines(F.substring(text, 1, TITLE_CHARS))
    whole = F.when(F.length(text) > TITLE_CHARS, F.slice(start, F.lit(1), F.size(start) - 1)).otherwise(start)
    head = F.regexp_extract(text, rf"\A(?:[{WS}]*+[^{ENDS}]++){{0,{TITLE_LINES}}}", 0)
    return F.coalesce(_first_title(whole), _first_title(lines(head)))


def metadata(text: Column | str) -> Column:
    return F.struct(case_no(text).alias("case_no"), division(text).alias("division"), title(text).alias("title"))
