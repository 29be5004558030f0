"""Lines that many documents share, dropped from all but one of them.

Lines are exploded and compared by a 128-bit hash of their normal form. Distinct documents of a hash are counted in two
grouped steps: a line's documents are told apart first, dealt by line and document, so a line that a third of all
documents hold is no one task's; what is left to add up for a line are partial counts. Texts are shuffled once, to meet
the numbers of the lines that they lose.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.common import Scratch, unused

#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"


def normal(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """``(doc, own, body, pos, h1, h2)`` of every line whose normal form has at least ``min_chars`` code points.

    ``body`` is a hash of the whole text, which tells rows of one key apart, and ``own`` the same for rows without a key.
    """
    body = F.xxhash64(text)
    own = F.when(F.col(key).isNull(), body).otherwise(0)
    cut = docs.select(F.col(key).alias("doc"), own.alias("own"), body.alias("body"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    cut = cut.withColumn("line", normal(F.col("line"))).where(F.length("line") >= min_chars)
    return cut.select("doc", "own", "body", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def common_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(h1, h2, n, doc, own)``: hashes of lines in ``min_docs`` documents or more, their number and the last of them."""
    held = hashed_lines(docs, min_chars, key, text).select("h1", "h2", "doc", "own").distinct()
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("doc"), F.max("own").alias("own")).where(F.col("n") >= min_docs)


def without_common_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")
) -> DataFrame:
    """``docs`` with ``text`` less the lines that at least ``min_docs`` documents hold, but for the largest key's.

    Lines end at line feeds; a null or empty text is one empty line. A line counts by its normal form, if that has
    ``min_chars`` code points; a document that holds one several times keeps or loses them all. The lines that stay are
    joined by line feeds, so a text that loses none is unchanged but for null, which becomes empty. ``counts`` names two
    columns more (with underscores before if such columns exist): lines before, and lines dropped. Rows of one key are
    one document; rows without a key are one document for each text of theirs and come before all others. A row is
    returned for each row; its other columns are kept.
    """
    last = Scratch(docs.sparkSession).write(common_lines(docs, min_docs, min_chars, key, text), "common")
    last = last.select("h1", "h2", F.col("doc").alias("last"), F.col("own").alias("last_own"))
    stays = F.col("doc").eqNullSafe(F.col("last")) & (F.col("last").isNotNull() | (F.col("own") == F.col("last_own")))
    # a written table, so that both sides of the join have an exchange of their own and a very common line can be split
    lost = hashed_lines(docs, min_chars, key, text).join(last, ["h1", "h2"]).where(~stays)
    lost = lost.groupBy("doc", "body").agg(F.collect_set("pos").alias("lost"))

    body, doc, gone = (unused(n, [*docs.columns, key]) for n in ("body", "doc", "lost"))
    lost = lost.select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("lost").alias(gone))
    here = docs.join(lost, docs[key].eqNullSafe(F.col(doc)) & (F.xxhash64(docs[text]) == F.col(body)), "left")
    whole, n_lost = F.coalesce(docs[text], F.lit("")), F.coalesce(F.size(gone), F.lit(0))
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    places = F.array_except(F.sequence(F.lit(0), F.size(_lines(docs[text])) - 1), F.col(gone))
    lines = unused("lines", [*docs.columns, body, doc, gone])
    here = here.withColumn(lines, F.when(F.col(gone).isNotNull(), _lines(docs[text])))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col(lines), i)), "\n")
    out = [F.when(F.col(gone).isNull(), whole).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns]
    total, dropped = (unused(c, docs.columns) for c in counts)
    return here.select(*out, n_lines.cast("long").alias(total), n_lost.cast("long").alias(dropped))
