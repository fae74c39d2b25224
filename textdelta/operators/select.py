"""Selectors: which operations of a diff, as boolean expressions over operation rows.

Positions are bytes; an operation is placed by its original span, else by its modified one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.charclass import SPACE
from ..functions.tokens import running_sums

_SPANS = "array<struct<start:int,end:int,title:string>>"


def start_of(op: Column | None = None) -> Column:
    at = (lambda n: op[n]) if op is not None else F.col
    return F.coalesce(at("original_start"), at("modified_start"))


def end_of(op: Column | None = None) -> Column:
    at = (lambda n: op[n]) if op is not None else F.col
    return F.when(at("original_start").isNotNull(), at("original_end")).otherwise(at("modified_end"))


def whole() -> Column:
    return F.lit(True)


def edit_type(*kinds: str) -> Column:
    return F.col("edit_type").isin(*kinds)


def insertions() -> Column:
    return edit_type("Insert")


def deletions() -> Column:
    return edit_type("Delete")


def modifications() -> Column:
    return edit_type("Modify")


def changes() -> Column:
    return edit_type("Insert", "Delete", "Modify")


def position(start: int, end: int) -> Column:
    return (start_of() < end) & (end_of() > start)


def all_of(*selectors: Column) -> Column:
    """Those that all selectors take; none without selectors."""
    return reduce(lambda a, b: a & b, selectors) if selectors else F.lit(False)


def any_of(*selectors: Column) -> Column:
    return reduce(lambda a, b: a | b, selectors) if selectors else F.lit(False)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def _line_spans(text: Column, opens, closes) -> Column:
    """Spans from each line that opens one to the start of the next that closes it (or the end); opens and closes: of a line, the one before it, and whether there is one."""
    lines = F.split(text, "\n")
    ends = running_sums(F.transform(lines, lambda x: F.octet_length(x) + 1))

    def of(both: Column) -> Column:
        line, end = both["lines"], both["ends"]
        start = lambda i: F.coalesce(F.get(end, i - 1), F.lit(0))
        picked = lambda test: F.filter(F.transform(line, lambda x, i: F.when(test(x, F.get(line, i - 1), i > 0), F.struct(start(i).alias("at"), _trimmed(x).alias("title")))), lambda x: x.isNotNull())
        froms, tos = picked(opens), picked(closes)
        return F.transform(froms, lambda x, k: F.struct(x["at"].alias("start"), F.coalesce(F.get(tos, k)["at"], F.octet_length(text)).alias("end"), x["title"].alias("title")))

    return F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), ends.alias("ends"))), of), 1)  # so that lines are found once


def _blank(line: Column) -> Column:
    return F.rlike(line, F.lit(f"^{SPACE}*$"))


def paragraph_spans(text: Column) -> Column:
    """Runs of lines that are not blank; one ends where the blank line starts."""
    return _line_spans(text, lambda x, before, any_: ~_blank(x) & (~any_ | _blank(before)), lambda x, before, any_: any_ & _blank(x) & ~_blank(before))


def is_header(line: Column) -> Column:
    """A line that starts with #, or of two words or more with all letters capital."""
    t = _trimmed(line)
    return t.startswith("#") | ((F.size(F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")) >= 2) & ~F.rlike(t, F.lit(r"[\p{L}&&[^\p{Lu}]]")))


def section_spans(text: Column) -> Column:
    """From each header to the next."""
    froms = _line_spans(text, lambda x, before, any_: is_header(x), lambda x, before, any_: F.lit(False))
    return F.element_at(F.transform(F.array(froms), lambda all_: F.transform(all_, lambda x, k: F.struct(x["start"].alias("start"), F.coalesce(F.get(all_, k + 1)["start"], x["end"]).alias("end"), x["title"].alias("title")))), 1)


def overlaps(spans: Column) -> Column:
    return F.exists(spans, lambda s: (start_of() < s["end"]) & (end_of() > s["start"]))


def paragraph_numbers(spans: Column, *ids: int) -> Column:
    """The spans of these numbers, from 0."""
    return F.filter(spans, lambda s, i: i.isin(*ids)) if ids else F.array().cast(_SPANS)


def titled(spans: Column, *headers: str) -> Column:
    """The spans whose title holds one of these texts, whatever the case."""
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, [F.contains(F.lower(s["title"]), F.lit(h.lower())) for h in headers], F.lit(False)))


def paragraphs(spans: Column, *ids: int) -> Column:
    """Operations within the paragraphs of these numbers, from 0; spans: those of the diff's original text."""
    return overlaps(paragraph_numbers(spans, *ids))


def sections(spans: Column, *headers: str) -> Column:
    """Operations within sections whose header holds one of these texts, whatever the case."""
    return overlaps(titled(spans, *headers))
