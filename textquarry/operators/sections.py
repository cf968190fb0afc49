"""Sections of a document, in place: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS, strip

# Canonical section names and the lines that open them, in order of precedence.
HEADINGS = {
    "DECISION": rf"D[{WS}]E[{WS}]C[{WS}]I[{WS}]S[{WS}]I[{WS}]O[{WS}]N",
    "SYLLABUS": "SYLLABUS",
    "FACTS": rf"THE[{WS}]+FACTS|STATEMENT[{WS}]+OF[{WS}]+FACTS|FACTS",
    "ISSUES": rf"ISSUE[S]?|ASSIGNED[{WS}]+ERRORS",
    "RULING": rf"RULING|DISCUSSION|THE[{WS}]+COURT[’'`]S?[{WS}]+RULING",
    "WHEREFORE": rf"WHEREFORE|SO[{WS}]+ORDERED",
}
PREAMBLE, FULL_TEXT = "PREAMBLE", "FULL_TEXT"


#: Any heading, with the blanks and the colons that don't count.
ANY = rf"(?iu)\A[{WS}]*+(?:{'|'.join(HEADINGS.values())})[{WS}]*+:*+[{WS}]*+\z"


def heading(line: Column | str) -> Column:
    """The canonical name if the line is a heading, else null. Colons at the end don't count.

    One match decides for nearly all lines; which heading it is, is asked only of those that are one.
    """
    line = F.col(line) if isinstance(line, str) else line
    out = F.lit(None).cast("string")
    for name, pattern in reversed(HEADINGS.items()):
        out = F.when(line.rlike(rf"(?iu)\A[{WS}]*+(?:{pattern})[{WS}:]*+\z"), F.lit(name)).otherwise(out)
    return F.when(line.rlike(ANY), out)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used: as the element of a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sections(text: Column | str) -> Column:
    """array<struct<name, text>> in order; blank sections are left out.

    Sections are slices of the line array between heading lines, so the work is
    linear in the text. Lines, heading lines and slices are each bound once.
    """
    text = F.col(text) if isinstance(text, str) else text

    def cut(rows: Column, heads: Column) -> Column:
        def body(x, k):
            after = F.when(k + 1 < F.size(heads), F.get(heads, k + 1)["at"]).otherwise(F.size(rows))
            own = F.array_join(F.slice(rows, x["at"] + 2, after - x["at"] - 1), "\n")
            more = F.when(after - x["at"] > 1, F.concat(F.lit("\n"), own)).otherwise("")
            return F.struct(x["name"].alias("name"), strip(F.concat(x["name"], F.lit(":\n"), more)).alias("text"))

        first = F.when(F.size(heads) > 0, F.get(heads, F.lit(0))["at"]).otherwise(F.size(rows))
        lead = F.array(F.struct(F.lit(PREAMBLE).alias("name"), strip(F.array_join(F.slice(rows, F.lit(1), first), "\n")).alias("text")))
        return F.filter(F.concat(lead, F.transform(heads, body)), lambda s: s["text"] != "")

    def named(found: Column) -> Column:
        alone = (F.size(found) == 1) & (F.get(found, F.lit(0))["name"] == PREAMBLE)
        return F.when(alone, F.transform(found, lambda s: F.struct(F.lit(FULL_TEXT).alias("name"), s["text"].alias("text")))).otherwise(found)

    def whole(rows: Column) -> Column:
        marked = F.filter(F.transform(rows, lambda line, i: F.struct(i.alias("at"), heading(line).alias("name"))), lambda x: x["name"].isNotNull())
        return bound(bound(marked, lambda heads: cut(rows, heads)), named)

    return bound(F.split(text, "\n", -1), whole)
