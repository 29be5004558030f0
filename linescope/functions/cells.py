"""Tokens, display widths and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linescope.functions.patterns import Pattern, dense_spans

#: Wide tokens are runs of anything but white space; narrow ones runs of word characters or of other signs. No character is
#: of two kinds.
RUNS = {"wide": [r"\S"], "narrow": [r"[\p{L}\p{Nd}_]", r"[^\s\p{L}\p{Nd}_]"]}
TOKENS = {mode: Pattern("|".join(f"{c}+" for c in kinds), regex=True) for mode, kinds in RUNS.items()}
#: Characters that take two cells: East Asian wide and full-width blocks; beyond the basic plane each counts as two.
#: (U+303F is narrow.)
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3040}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{10000}-\x{10FFFF}]"
TAB = 8


def tokens(text: Column, mode: str = "wide") -> Column:
    return dense_spans(text, TOKENS[mode])


def token_over(text: Column, index: Column, mode: str = "wide") -> Column:
    """The token over a character as struct<start, token>, null on white space and outside the text.

    Tokens are runs of one kind of character, so only the run to both sides of the place is read, not the whole text.
    """
    at = F.when(index.between(0, F.length(text) - 1), index).cast("int")
    before, rest = F.reverse(text.substr(F.lit(1), at)), text.substr(at + 1, F.length(text))

    def over(kind: str) -> Column:
        run = Pattern(f"^{kind}+", regex=True).java()
        left, right = F.reverse(F.regexp_extract(before, run, 0)), F.regexp_extract(rest, run, 0)
        return F.when(right != "", F.struct((at - F.length(left)).alias("start"), F.concat(left, right).alias("token")))

    return F.coalesce(*[over(kind) for kind in RUNS[mode]])


def display_width(text: Column) -> Column:
    """Cells that a text takes: tabs go to the next multiple of 8, wide characters take 2."""

    def step(cells: Column, c: Column) -> Column:
        return F.when(c == "\t", cells + TAB - cells % TAB).otherwise(cells + F.when(c.rlike(WIDE), 2).otherwise(1))

    stepped = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)
    return F.when(text.rlike(f"\\t|{WIDE}"), stepped).otherwise(F.length(text))


def colour(text: Column) -> Column:
    """``#RRGGBB``, ``#AARRGGBB``, or either without the sign, as an ARGB number; anything else is null."""
    valid = text.rlike("^#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")
    digits = F.regexp_replace(text, "^#", "")
    return F.when(valid, F.conv(F.lpad(digits, 8, "F"), 16, 10).cast("long"))
