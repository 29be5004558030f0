"""How the sources of a language differ from each other and from the language, by the terms that they use.

Terms are counted by language and source in three steps: within slices of texts as vectors, by Spark before the shuffle, and
after it. Sums over pairs of sources run over terms that both have; terms that one of them or both lack are added from
counts of equal shares. A source's first terms are found by a dominance skyband: a term that at least ``top`` others
precede in count, in the language's count and in order cannot be among the first ``top``. Partitions keep their skybands,
these are merged in a second exchange, and only what is left is ranked.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linescope.llm import tokens
from linescope.llm.common import Scratch, partitions

#: Shares are of this many.
SCALE = 1_000_000_000
#: Rows of which a skyband is taken at once, and rows that are compared with them in one step.
HELD, BLOCK = 8192, 1024
_TERM = np.zeros(256, bool)
_TERM[128:] = True
_TERM[ord("A") : ord("Z") + 1] = _TERM[ord("a") : ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
COUNTS = "lang string, source string, term string, n long, docs long"


def cut_terms(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """For each term the text that holds it, and all terms as an array with a dictionary."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    inside = _TERM[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    opens = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(opens, starts, "right") - 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]]))
    return owner, terms.dictionary_encode()


def _counted(batches):
    """Of each slice of texts the terms of each language and source, how often and in how many texts."""

    def rows():
        for b in (s for batch in batches for s in tokens.slices(batch, 2, tokens.FEW)):
            owner, terms = cut_terms([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()])
            if not len(terms):
                continue
            groups = pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["lang", "source"]).to_pylist()
            known = {}
            group = np.array([known.setdefault((g["lang"], g["source"]), len(known)) for g in groups])
            code, size = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary)
            per_text, n = np.unique(owner * size + code, return_counts=True)
            pair, first = np.unique(group[per_text // size] * size + per_text % size, return_inverse=True)
            held = list(known)
            names = [pa.array([g[i] for g in held], pa.string()).take(pa.array(pair // size)) for i in (0, 1)]
            sums = [np.bincount(first, w, len(pair)).astype(np.int64) for w in (n, None)]
            columns = [*names, terms.dictionary.take(pa.array(pair % size)), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    yield from tokens.tidied(rows())


def counted_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term in a source's texts, and texts that hold it.

    A term is a run of ASCII letters and of characters beyond ASCII, A-Z lower-cased. Nulls are read as ''.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)]
    read = docs.select(named[0].alias("lang"), named[1].alias("source"), F.col(text).alias("text"))
    found = read.mapInArrow(_counted, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total), exactly, by three steps of long division (count <= total < 2 ** 53)."""
    value, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        value, rest = value * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return value + 1


def diverging(p, q):
    """floor((p - q) * (p - q) / q) of shares, which are at most SCALE + 1: the square fits 64 bits."""
    return (p - q) * (p - q) // q


def diverging_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# --- first terms -----------------------------------------------------------------------------------------------------


def skyband(terms: np.ndarray, here: np.ndarray, there: np.ndarray, k: int) -> np.ndarray:
    """Which rows are dominated by fewer than ``k`` others, in order of ``terms`` (byte strings, each once).

    A row dominates another with no higher count ``here``, no lower count ``there`` and a later term.
    """
    order = np.argsort(terms, kind="stable")
    x, y = here[order], there[order]
    over = np.zeros(len(order), np.int64)
    for at in range(0, len(order), BLOCK):
        own = slice(at, at + BLOCK)
        before = (x[:at, None] >= x[None, own]) & (y[:at, None] <= y[None, own])
        within = (x[own, None] >= x[None, own]) & (y[own, None] <= y[None, own])
        over[own] = before.sum(0) + np.triu(within, 1).sum(0)
    return order[over < k]


def _bands(k: int):
    """Rows ``(lang, source, term, n, total, p, q)`` in batches to those of their groups' skybands; groups may be mixed."""

    def banded(table: pa.Table) -> pa.Table:
        groups = table.select(["lang", "source"]).to_pandas().groupby(["lang", "source"], sort=False).indices
        terms = np.array([t.encode() for t in table["term"].to_pylist()], object)
        here, there = table["n"].to_numpy(), table["total"].to_numpy()
        kept = [at[skyband(terms[at], here[at], there[at], k)] if len(at) > k else at for at in groups.values()]
        return table.take(pa.array(np.sort(np.concatenate(kept)))) if kept else table

    def keep(batches):
        held, size, limit = [], 0, HELD
        for b in batches:
            for at in range(0, b.num_rows, HELD):
                part = b.slice(at, HELD)
                held.append(part)
                size += part.num_rows
                if size >= limit:
                    band = banded(pa.Table.from_batches(held)).combine_chunks()
                    held, size = band.to_batches(), band.num_rows
                    limit = max(HELD, 2 * size)
        if size:
            yield from banded(pa.Table.from_batches(held)).to_batches()

    return keep


def first_terms(kept: DataFrame, top: int) -> DataFrame:
    """``(lang, source, item, value, rank)``: of each group the ``top`` terms that diverge most from their language.

    ``kept`` has ``(lang, source, term, n, total, p, q)`` of terms with p > q. Within a group p grows with ``n`` and q with
    ``total``, so a term with a higher n, a lower total and an earlier name never comes later.
    """
    fields = "lang string, source string, term string, n long, total long, p long, q long"
    band = kept.select("lang", "source", "term", "n", "total", "p", "q").mapInArrow(_bands(top), fields)
    # a group's skybands meet in several tasks first, so that no task gets all of them
    parts = F.pmod(F.xxhash64("term"), F.lit(max(1, int(partitions(kept.sparkSession) ** 0.5))))
    merged = band.repartition(partitions(kept.sparkSession), "lang", "source", parts).mapInArrow(_bands(top), fields)
    value = diverging_column(F.col("p"), F.col("q")).alias("value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = merged.select("lang", "source", F.col("term").alias("item"), value).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= top)


# --- pairs of sources ------------------------------------------------------------------------------------------------


def _met(batches):
    """Sums over terms that two sources of a language both have, of what their pair adds to the sums without such terms.

    Rows ``(lang, term, source, p, p0)`` come sorted by language and term; p0 is a source's share of a term it lacks.
    """
    names = ["lang", "source", "other", "value"]

    def summed(table: pa.Table):
        ends = [table[c].combine_chunks().dictionary_encode() for c in ("lang", "term", "source")]
        lang, term, source = (e.indices.to_numpy(zero_copy_only=False).astype(np.int64) for e in ends)
        p, p0 = table["p"].to_numpy(), table["p0"].to_numpy()
        many = len(ends[2].dictionary)
        keys, sums = [], []
        for d in range(1, len(p)):
            i = np.flatnonzero((term[d:] == term[:-d]) & (lang[d:] == lang[:-d]))
            if not len(i):
                break
            j = i + d
            for a, b in ((i, j), (j, i)):
                extra = diverging(p[a], p[b]) - diverging(p[a], p0[b]) - diverging(p0[a], p[b]) + diverging(p0[a], p0[b])
                found, at = np.unique((lang[a] * many + source[a]) * many + source[b], return_inverse=True)
                total = np.zeros(len(found), np.int64)
                np.add.at(total, at, extra)
                keys.append(found)
                sums.append(total)
        if not keys:
            return
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate(sums))
        columns = [ends[0].dictionary.take(pa.array(found // many // many)), ends[2].dictionary.take(pa.array(found // many % many)), ends[2].dictionary.take(pa.array(found % many))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total)], names=names)

    held, size = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows < HELD * 8:
            continue
        last = held.slice(held.num_rows - 1).to_pylist()[0]  # a term's rows stay together
        same = (pc.equal(held["term"], last["term"]).to_numpy()) & (pc.equal(held["lang"], last["lang"]).to_numpy())
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield from summed(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield from summed(held)


def _pairs(scratch: Scratch, kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each two sources of a language, from sums that hold for terms of either alone."""
    zero = groups.select("lang", "source", "p0", "n_terms")
    equal = scratch.write(kept.groupBy("lang", "source", "p").agg(F.count("*").alias("many")), "equal")
    others = scratch.write(zero.groupBy("lang", F.col("p0").alias("q0")).agg(F.count("*").alias("sources")), "zeros")
    own = equal.join(zero.select("lang", "source", "p0"), ["lang", "source"]).join(others, "lang")
    sums = own.groupBy("lang", "source", "q0").agg(
        F.sum(F.col("many") * diverging_column(F.col("p"), F.col("q0"))).alias("from_it"),
        F.sum(F.col("many") * diverging_column(F.col("q0"), F.col("p"))).alias("to_it"),
    )
    sums = scratch.write(sums, "sums")
    there = zero.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("n_terms").alias("m_terms"))
    two = zero.join(there, "lang").where("source <> item").join(langs.select("lang", "v"), "lang")
    two = two.join(sums.select("lang", "source", "q0", "from_it"), ["lang", "source", "q0"], "left")
    back = sums.select("lang", F.col("source").alias("item"), F.col("q0").alias("p0"), "to_it")
    two = two.join(back, ["lang", "item", "p0"], "left")
    met = kept.repartition("lang", "term").sortWithinPartitions("lang", "term").select("lang", "term", "source", "p", "p0")
    met = met.mapInArrow(_met, "lang string, source string, item string, value long")
    met = scratch.write(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("met")), "met")
    lacking = (F.col("v") - F.col("n_terms") - F.col("m_terms")) * diverging_column(F.col("p0"), F.col("q0"))
    parts = [F.when(F.col("v") > 0, lacking), F.col("from_it"), F.col("to_it"), F.col("met")]
    value = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0).cast("long")) for p in parts])
    return two.join(met, ["lang", "source", "item"], "left").select("lang", "source", "item", value.alias("value"))


# --- the audit -------------------------------------------------------------------------------------------------------


def audit(docs: DataFrame, top: int = 200, min_docs: int = 3, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of each source of each language.

    A language keeps the V terms that at least ``min_docs`` of its rows hold. A source's share of a kept term is p = 1 +
    floor(10^9 * (count + 1) / (N + V)), N being all its counts; likewise a language's. What p differs by from q is
    floor((p - q)^2 / q). Part ``pair`` has each other source of the language, with that summed over all kept terms, q
    being the other's share; part ``term`` the ``top`` terms that the source has and of which its share is larger than
    the language's. Ranks count from 1 by value from the highest and then by item in order of its UTF-8 bytes. Null
    languages, sources and texts are read as ''; sources without terms take part in pairs, and without kept terms all
    values are 0. Rows are documents, whatever their keys; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.write(counted_terms(docs, lang, source, text), "counts")
    of_term = Window.partitionBy("lang", "term")
    total = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("in_docs"))
    kept = scratch.write(total.where(F.col("in_docs") >= min_docs).drop("in_docs"), "kept")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    there = docs.select(*named).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("n_terms"))
    zero = F.lit(0).cast("long")
    groups = there.join(sums, ["lang", "source"], "left").withColumns({c: F.coalesce(c, zero) for c in ("size", "n_terms")})
    vocabulary = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    langs = there.select("lang").distinct().join(vocabulary, "lang", "left").withColumns({c: F.coalesce(c, zero) for c in ("v", "lang_size")})
    langs = scratch.write(langs, "langs")
    groups = groups.join(langs, "lang")
    some = F.greatest(F.col("size") + F.col("v"), F.lit(1))
    groups = scratch.write(groups.select("lang", "source", "n_terms", "v", "lang_size", some.alias("sum"), share(F.lit(1).cast("long"), some).alias("p0")), "groups")
    shares = kept.join(groups.drop("n_terms"), ["lang", "source"])
    p, q = share(F.col("n") + 1, F.col("sum")), share(F.col("total") + 1, F.col("lang_size") + F.col("v"))
    shares = scratch.write(shares.select("lang", "source", "term", "n", "total", p.alias("p"), q.alias("q"), "p0"), "shares")

    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = _pairs(scratch, shares, groups, langs).withColumn("rank", F.row_number().over(by_value))
    terms = first_terms(shares.where("p > q"), top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
