"""The pattern dialect, and expressions that find a pattern in a line."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linescope.functions.arrays import let, sums_before

#: Bytes of a line that the reference's search shows to patterns other than plain case-sensitive text.
MATCH_LIMIT = 65_536


@dataclass(frozen=True)
class Pattern:
    """What to look for in a line: plain text or a regular expression, with or without regard to case."""

    text: str
    regex: bool = False
    ignore_case: bool = False

    def __post_init__(self):
        if not self.text:
            raise ValueError("an empty pattern matches nothing of interest")

    @property
    def plain(self) -> bool:
        return not self.regex and not self.ignore_case

    def java(self) -> str:
        """As a java.util.regex pattern: Unicode classes, only line feed ends a line, case folded by Unicode."""
        body = self.text if self.regex else quoted(self.text)
        return f"(?dU{'iu' if self.ignore_case else ''}){body}"

    def check(self) -> Pattern:
        """Raise ValueError if this is not a valid pattern."""
        try:
            SparkSession.active()._jvm.java.util.regex.Pattern.compile(self.java())
        except Exception as error:
            raise ValueError(f"not a valid pattern: {self.text!r}") from error
        return self


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def head(text: Column, limit: int = MATCH_LIMIT) -> Column:
    """The first ``limit`` bytes of a text, without a character that they would cut."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) > limit, F.regexp_replace(cut, "\\x{FFFD}$", "")).otherwise(text)


def required(pattern: Pattern) -> str:
    """The longest text that every match of a case-sensitive expression has, as far as a look at its top level shows.

    Groups, classes and what a quantifier may leave out are passed over; alternatives, flags and escapes with arguments
    give up (''). A text of one character is not worth looking for.
    """
    body, runs, depth, i = pattern.text, [""], 0, 0
    if pattern.ignore_case or not pattern.regex:
        return "" if pattern.ignore_case else body
    while i < len(body):
        c, i = body[i], i + 1
        if c == "\\":
            c, i = body[i : i + 1], i + 1
            if c == "" or c in "xucpPkNQE0123456789":
                return ""
            if depth == 0:
                runs += [""] if c.isalnum() else []
                runs[-1] += "" if c.isalnum() else c
        elif c == "[":
            open_, i = 1, i + body.startswith("^", i)
            if body.startswith("]", i):
                return ""
            while open_ and i < len(body):
                c, i = body[i], i + 1
                if c == "\\":
                    if body[i : i + 1] in ("Q", "E"):
                        return ""
                    i += 1
                open_ += {"[": 1, "]": -1}.get(c, 0)
            runs.append("")
        elif c == "(":
            if body[i : i + 1] == "?" and body[i + 1 : i + 2] not in (":", "=", "!", "<", ">"):
                return ""
            depth += 1
            runs.append("")
        elif c == ")":
            depth -= 1
            runs.append("")
        elif depth:
            continue
        elif c == "|":
            return ""
        elif c in "?*{":
            runs[-1] = runs[-1][:-1]
            runs.append("")
            if c == "{" and "}" not in body[i:]:
                return ""
            i = body.index("}", i) + 1 if c == "{" else i
        elif c in ".^$+":
            runs.append("")
        else:
            runs[-1] += c
    return max((r for r in runs if len(r) > 1 and not set(r) & {"\r", "\n"}), key=len, default="")


def matches(text: Column, pattern: Pattern, limit: int | None = MATCH_LIMIT) -> Column:
    """Whether a line has the pattern: one search strategy by kind of pattern.

    Patterns other than plain case-sensitive text see ``limit`` bytes of the line, as in the reference's search; None is
    the whole line, as the operators have it. What an expression's matches must have is looked for first, by a comparison
    that sources can take over.
    """
    if pattern.plain:
        return F.lit(False) if set(pattern.text) & {"\r", "\n"} else text.contains(pattern.text)
    found = (text if limit is None else head(text, limit)).rlike(pattern.java())
    literal = required(pattern)
    return text.contains(literal) & found if literal else found


#: Characters that stand for nothing in any text; one that a text does not have marks its matches.
MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def mark_of(text: Column) -> Column:
    """A noncharacter that a text does not have; a text that has all of them is an error."""
    free = [F.when(~text.contains(m), F.lit(m)) for m in MARKS]
    return F.coalesce(*free, F.when(text.isNotNull(), F.raise_error("a text has all noncharacters: its matches cannot be marked").cast("string")))


def _pieces(text: Column, pattern: Pattern) -> Column:
    """The text cut at the borders of its matches: gap, match, gap, match, ..., gap.

    The engine itself sets the marks as it replaces, so any pattern is cut where it matches, also one that matches the
    empty string or looks around.
    """
    mark = mark_of(text)
    return F.split(F.regexp_replace(text, F.lit(pattern.java()), F.concat(mark, F.lit("$0"), mark)), mark, -1)


SPANS = "array<struct<start: int, len: int, matched: string>>"


def spans(text: Column, pattern: Pattern) -> Column:
    """Every non-empty occurrence as array<struct<start, len, matched>>, in code points."""

    def placed(pieces: Column) -> Column:
        starts = sums_before(F.transform(pieces, F.length))
        both = F.arrays_zip(pieces.alias("matched"), starts.alias("start"))
        hits = F.filter(both, lambda x, i: (i % 2 == 1) & (F.length(x["matched"]) > 0))
        return F.transform(hits, lambda x: F.struct(x["start"].cast("int").alias("start"), F.length(x["matched"]).alias("len"), x["matched"].alias("matched")))

    empty = F.expr(f"cast(array() as {SPANS})")
    found = let(_pieces(text, pattern), placed)
    has = text.contains(pattern.text) if pattern.plain else matches(text, pattern, None)
    return F.when(has, found).when(text.isNotNull() | F.lit(pattern.plain), empty)


def dense_spans(text: Column, pattern: Pattern) -> Column:
    """As ``spans``, for patterns that match in most places: sums over a batch are taken at once, in an Arrow function.

    The engine still cuts the texts. It cannot stand inside a lambda of an array function.
    """
    return F.when(text.isNotNull(), F.arrow_udf(_placed, SPANS)(F.when(matches(text, pattern, None), _pieces(text, pattern))))


def _placed(pieces: pa.Array) -> pa.Array:
    """Every second piece of each row, if it is not empty, with its place; rows without pieces have none."""
    flat, sizes = pieces.flatten(), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy().astype(np.int64)
    lengths = pc.utf8_length(flat).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    first = np.repeat(ends - sizes, sizes)
    before = np.cumsum(lengths) - lengths
    hits = np.flatnonzero(((np.arange(len(first)) - first) % 2 == 1) & (lengths > 0))
    columns = [pa.array((before[hits] - before[first[hits]]).astype(np.int32)), pa.array(lengths[hits].astype(np.int32)), flat.take(pa.array(hits))]
    bounds = np.searchsorted(hits, np.append(0, ends)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, names=["start", "len", "matched"]))


def segments(text: Column, pattern: Pattern) -> Column:
    """The text in pieces, array<struct<segment, is_match>>; their concatenation is the text."""
    both = F.transform(_pieces(text, pattern), lambda x, i: F.struct(x.alias("segment"), (i % 2 == 1).alias("is_match")))
    return F.filter(both, lambda x: F.length(x["segment"]) > 0)
