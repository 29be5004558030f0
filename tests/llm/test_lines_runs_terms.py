"""Line deduplication, periodic runs and the divergence audit against plain versions, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("linescope.llm")
from linescope.llm import divergence, line_dedup, periods  # noqa: E402
from linescope.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_lines long, lost string, body string, doc long, n_runs long, start long, p long, value string, term string"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def frame(spark, rows):
    """Rows ``(doc_id, text, lang, source)`` with further columns of names that the operators use."""
    return spark.createDataFrame([(*r, -1, "lost", "body", 5, 6, 7, 8, "v", "t") for r in rows], ODD)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table(spark, SF, "documents").collect()]


def odd_rows():
    line = "A line of more than twenty signs"
    rows = [(i, f"  {line.upper() if i % 2 else line}\t\nown line number {i} of this one text\n{line}", "en", "s") for i in range(6)]
    rows += [(10, None, None, None), (11, "", "en", None), (12, "\n\n", None, "s"), (13, " \t ", "de", "t"), (13, line, "de", "t"), (13, line, "de", "t")]
    rows += [(None, line, "en", "s"), (None, "another line that is long enough\n" * 3, "en", "s"), (None, line, None, None), (14, "short", "en", "s"), (15, "short", "en", "s"), (16, "short", "en", "s")]
    rows += [(20 + i, "Straße ÄÖÜ und viele weitere Worte\r\n" * 3, "de", "t" if i % 2 else "u") for i in range(4)]
    return rows + [(30, "one long text " * 30_000, "en", "long"), (31, "a " * 50_000, "en", "long"), (32, "x\0y z\0w", "en", "\0"), (33, "漢字 と かな " * 9, "ja", "s")]


# --- line deduplication ----------------------------------------------------------------------------------------------


def plain_lines(rows, least=3, chars=20):
    key = lambda s: s.strip(" \t\n\x0b\f\r").translate(LOWER)
    ident = lambda d, t: (d is not None, d if d is not None else line_own(t))
    held = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(ident(d, t))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        lost = [len(held[key(s)]) >= least and max(held[key(s)]) != ident(d, t) if key(s) in held else False for s in lines]
        out.append((d, len(lines), sum(lost), "\n".join(s for s, gone in zip(lines, lost) if not gone)))
    return out


def line_own(text):
    """Texts without a key come in order of Spark's hash of them, which the plain version takes from Spark."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.active()
    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_lines_of_documents(spark, texts):
    got = line_dedup.without_common_lines(table(spark, SF, "documents"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    want = plain_lines(texts)
    assert sum(r[2] for r in want) > 20
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "text") == sorted(want, key=str)


def test_lines_of_odd_rows(spark):
    docs = frame(spark, odd_rows())
    got = line_dedup.without_common_lines(docs)
    assert got.columns == [*docs.columns, "_n_lines", "n_dropped"]
    assert {(r["n_lines"], r["lost"], r["body"], r["doc"]) for r in got.collect()} == {(-1, "lost", "body", 5)}
    assert rows_of(got, "doc_id", "_n_lines", "n_dropped", "text") == sorted(plain_lines(odd_rows()), key=str)
    assert line_dedup.without_common_lines(docs.where("false")).count() == 0
    few = line_dedup.without_common_lines(docs, min_docs=2, min_chars=3)
    assert rows_of(few, "doc_id", "_n_lines", "n_dropped", "text") == sorted(plain_lines(odd_rows(), 2, 3), key=str)


def test_a_line_of_most_documents(spark):
    """A hot line costs each document that line and no other."""
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('the licence line of all documents\\n', 'own line of a document, number ', id) as text")
    got = line_dedup.without_common_lines(docs).selectExpr("doc_id", "n_lines", "n_dropped", "text").collect()
    assert all(r["n_lines"] == 2 and r["n_dropped"] == (r["doc_id"] != 1999) for r in got)
    assert all(r["text"] == f"own line of a document, number {r['doc_id']}" for r in got if r["doc_id"] != 1999)


def test_line_deduplication_is_native(spark):
    docs = table(spark, SF, "documents")
    for df in (line_dedup.common_lines(docs), line_dedup.without_common_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- runs ------------------------------------------------------------------------------------------------------------


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            begin = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            length = at + q - begin
            if at > begin and length >= max(6, 4 * q):
                found.setdefault((begin, length), q)
            at += at == begin
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_description(words):
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), " ".join(w for i, w in enumerate(words) if i not in gone)


def cut(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def moved(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_how_far_two_places_match():
    rng = random.Random(1)
    for _ in range(60):
        words = np.array([rng.randrange(rng.choice([1, 2, 9])) for _ in range(rng.randrange(2, 200))])
        index = periods.Extensions(words)
        for _ in range(40):
            i, j = rng.sample(range(len(words)), 2)
            k = 0
            while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            assert index(np.array([i]), np.array([j])).tolist() == [k]


@pytest.mark.parametrize("step, rounds", [(3, 0), (50, 1), (1 << 20, 8)])
def test_runs(monkeypatch, step, rounds):
    monkeypatch.setattr(periods, "STEP", step)
    monkeypatch.setattr(periods, "ROUNDS", rounds)
    rng, periodic = random.Random(step), 0
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            parts = [[rng.choice(rng.choice(["ab", "abcde"])) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9) for _ in range(rng.randrange(6))]
            texts.append([w for p in parts for w in p])
        bases = np.cumsum([0] + [len(t) for t in texts])
        want = [(s + base, n, q) for t, base in zip(texts, bases.tolist()) for s, n, q in plain_runs(t)]
        words = np.array([ord(w) for t in texts for w in t], np.int64)
        assert [tuple(r) for r in periods.runs(words, np.diff(bases)).tolist()] == want
        periodic += len(want)
    assert periodic > 300


def test_runs_of_documents(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in periods.planted_runs(table(spark, SF, "documents")).collect()}
    want = {d: plain_description(moved(d, cut(t))) for d, t, *_ in texts}
    assert got == {d: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest()) for d, w in want.items()}
    assert sum(w[0] > 0 for w in want.values()) > 10


def test_runs_of_odd_rows(spark):
    rows = [*odd_rows(), (40, "x y z " * 400 + "a b " * 3 + "c c c c c c", None, None), (41, "a b\vc\fa\tb\rc\n" * 5, None, None)]
    docs = frame(spark, rows)
    got = periods.repeated_runs(docs)
    long = [(30, 1, 0, 90_000, 3, 30_000_000, "one long text"), (31, 1, 0, 50_000, 1, 50_000_000, "a")]
    want = [(d, *plain_description(cut(t))) for d, t, *_ in rows if d not in (30, 31)]
    assert rows_of(got.where("doc_id is null or doc_id not in (30, 31)"), *got.columns) == sorted(want, key=str)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "collapsed"]
    assert rows_of(got.where("doc_id in (30, 31)"), *columns) == long
    assert periods.repeated_runs(docs.where("false")).count() == 0
    assert periods.planted_runs(docs).where("doc_id is null").select("n_runs").distinct().count() == 1


# --- divergence ------------------------------------------------------------------------------------------------------


def plain_audit(rows, top, least=3):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), {(g or "", s or "") for _, _, g, s in rows}
    for _, text, lang, source in rows:
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    share = lambda n, size, v: 1 + 10**9 * (n + 1) // (size + v)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources, v = sorted(s for g, s in groups if g == lang), len(kept)
        sizes = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], sizes[s], v) for t in kept} for s in sources}
        totals = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: share(totals[t], sum(totals.values()), v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("top, held", [(200, 8192), (3, 16)])
def test_audit_of_documents(spark, texts, monkeypatch, top, held):
    monkeypatch.setattr(divergence, "HELD", held)
    got = divergence.audit(table(spark, SF, "documents"), top)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(texts, top)


def test_audit_of_odd_rows(spark):
    rows = odd_rows() + [(50 + i, "Ties and ties AND Tied " * (1 + i % 2), "en", f"s{i % 5}") for i in range(15)]
    docs = frame(spark, rows)
    assert sorted(tuple(r) for r in divergence.audit(docs, 4).collect()) == plain_audit(rows, 4)
    assert divergence.audit(docs.where("false")).count() == 0
    alone = docs.where("doc_id in (10, 12)")  # no terms at all
    assert sorted(tuple(r) for r in divergence.audit(alone).collect()) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


@pytest.mark.parametrize("k", [1, 2, 7])
def test_skyband(monkeypatch, k):
    monkeypatch.setattr(divergence, "BLOCK", 5)
    rng = random.Random(k)
    for _ in range(30):
        n = rng.randrange(40)
        terms = [f"t{i}".encode() for i in rng.sample(range(1000), n)]
        here, there = [rng.randrange(6) for _ in range(n)], [rng.randrange(6) for _ in range(n)]
        over = [sum(terms[j] < terms[i] and here[j] >= here[i] and there[j] <= there[i] for j in range(n)) for i in range(n)]
        got = divergence.skyband(np.array(terms, object), np.array(here, int), np.array(there, int), k)
        assert sorted(got.tolist()) == [i for i in range(n) if over[i] < k]


def test_shares_are_exact(spark):
    rng = random.Random(3)
    data = [(a, b) for b in (1, 2, 999, 10**6 + 7, 10**12 + 39, 2**52 - 1) for a in {1, b, max(1, b // 3), rng.randint(1, b)}]
    rows = spark.createDataFrame(data, "a long, b long")
    got = rows.select("a", "b", divergence.share(rows.a, rows.b)).collect()
    assert all(r[2] == 1 + 10**9 * r[0] // r[1] for r in got)
