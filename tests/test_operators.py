"""Search, position, blocks, rules, marks and tokens against plain versions."""

import bisect
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from linescope.functions import cells
from linescope.functions.groups import Layout, Syntax, group_spans
from linescope.functions.many import matching
from linescope.functions.patterns import Pattern, matches, quoted, required, spans
from linescope.operators import blocks, marks, position, rules, search, tokens
from linescope.operators.rules import Rule
from linescope.plans import ordered
from linescope.sources import lines as L


def frame(spark, *texts):
    return L.lines_from_column(spark.createDataFrame(list(enumerate(texts)), "path long, t string"), "path", "t")


def found(spark, text, pattern):
    return spark.range(1).select(matches(F.lit(text), pattern)).first()[0]


@pytest.mark.parametrize(
    "text, pattern, want",
    [
        ("Fatal Éclair", Pattern("éclair", ignore_case=True), True),
        ("Fatal Éclair", Pattern("éclair"), False),
        ("a+b", Pattern("a+b"), True),
        ("A+B\\E", Pattern("a+b\\e", ignore_case=True), True),
        ("１２", Pattern(r"^\d+$", regex=True), True),
        ("ab\r", Pattern("b$", regex=True), False),
        ("x" * 70_000 + "needle", Pattern("needle"), True),
        ("x" * 70_000 + "needle", Pattern("needle", regex=True), False),
        ("é" * 40_000 + "needle", Pattern("NEEDLE", ignore_case=True), False),
        ("abc", Pattern("a\rb"), False),
    ],
)
def test_matches(spark, text, pattern, want):
    assert found(spark, text, pattern) is want


def test_bad_patterns(spark):
    with pytest.raises(ValueError):
        Pattern("")
    with pytest.raises(ValueError):
        search.search(frame(spark, "a"), Pattern("(", regex=True))
    assert quoted("a\\Eb") == "\\Qa\\E\\\\E\\Qb\\E"


def test_files_without_lines(spark):
    """They have rows if the files are given: no lines, no hits."""
    texts = ["a\nb", "", None, "\n"]
    lines, all_ = frame(spark, *texts), spark.range(4).withColumnRenamed("id", "path")
    assert sorted(tuple(r) for r in L.file_stats(lines, files=all_).collect()) == [(0, 2, 4, 1, 1), (1, 0, 0, None, None), (2, 0, 0, None, None), (3, 1, 1, 0, 0)]
    assert sorted(tuple(r) for r in search.search_summary(lines, Pattern("a"), files=all_).collect()) == [(0, 1, False, 0.5), (1, 0, False, None), (2, 0, False, None), (3, 0, False, 0.0)]
    assert L.file_stats(lines).count() == search.search_summary(lines, Pattern("a")).count() == 2


def test_hits_are_lines(spark):
    hits = search.ordinals(search.search(frame(spark, "xx x\ny\nx", "y"), Pattern("x"))).collect()
    assert sorted((r["path"], r["line_no"], r["byte_off"], r["hit_no"]) for r in hits) == [(0, 0, 0, 1), (0, 2, 7, 2)]


def test_summary_is_truncated_at_the_cap(spark):
    out = {r["path"]: tuple(r)[1:] for r in search.search_summary(frame(spark, "x\nx\n", "y\n", "x\nx\nx"), Pattern("x"), 2).collect()}
    assert out == {0: (2, True, 1.0), 1: (0, False, 0.0), 2: (2, True, 1.0)}


def test_spans_and_segments(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab. é") for _ in range(rng.randrange(12))) or "a" for _ in range(150)]
    pattern = Pattern("a+b?|é", regex=True)
    df = frame(spark, *texts)
    got = {}
    for r in search.match_spans(df, pattern).collect():
        got.setdefault(r["path"], []).append((r["start"], r["matched"]))
    pieces = {}
    for r in search.match_segments(df, pattern).orderBy("path", "seg_no").collect():
        pieces.setdefault(r["path"], []).append((r["segment"], r["is_match"]))
    for i, t in enumerate(texts):
        want = [(m.start(), m[0]) for m in re.finditer("a+b?|é", t)]
        assert got.get(i, []) == want
        if want:
            assert "".join(s for s, _ in pieces[i]) == t and [s for s, hit in pieces[i] if hit] == [m for _, m in want]


def test_a_large_file_of_hits_only(spark):
    n = 300_000
    lines = spark.range(n).selectExpr("0L as path", "id as line_no", "2 * id as byte_off", "1 as n_bytes", "'x' as text")
    files = spark.createDataFrame([(0, n)], "path long, total_lines long")
    found = blocks.context_blocks(lines, files, 1, width=10_000)
    assert [tuple(r) for r in found.collect()] == [(0, 0, 0, n - 1, n, n)]
    shown = blocks.block_rows(found, lines, lines, width=10_000).agg(F.count("*"), F.min("row_no"), F.max("hit_no"), F.sum("row_no"), F.sum("hit_no")).first()
    assert tuple(shown) == (n, 0, n, n * (n - 1) // 2, n * (n + 1) // 2)
    assert search.ordinals(lines, width=50_000).where("hit_no = line_no + 1").count() == n
    odd = position.adjacent_lines(lines, width=10_000).where("next_off <> byte_off + 2 or prev_off <> greatest(byte_off - 2, 0)")
    assert odd.count() == 0


@pytest.mark.parametrize("width", [None, 7])
def test_pages_and_ranges(spark, width):
    rng = random.Random(8)
    texts = {p: ["y" * rng.randrange(4) for _ in range(rng.randrange(1, 40))] for p in range(6)}
    df = frame(spark, *["\n".join(t) + "\n" for t in texts.values()])
    starts = {p: [sum(len(x) + 1 for x in t[:i]) for i in range(len(t))] for p, t in texts.items()}
    asked = sorted({(rng.randrange(7), rng.randrange(-3, 90)) for _ in range(60)})
    got = {}
    for r in position.page_at(df, spark.createDataFrame(asked, "path long, offset long"), 3, width).orderBy("turn").collect():
        got.setdefault((r["path"], r["offset"]), []).append((r["turn"], r["byte_off"]))
    for p, o in asked:
        page = [s for s in starts.get(p, []) if s >= o][:3]
        assert got.get((p, o), []) == list(enumerate(page, 1))
    ranges = sorted({(rng.randrange(7), rng.randrange(-3, 45), rng.randrange(-3, 99)) for _ in range(40)})
    found = {}
    for r in position.line_range(df, spark.createDataFrame(ranges, "path long, top long, bottom long"), 5, width or 4096).collect():
        found.setdefault((r["path"], r["top"], r["bottom"]), []).append(r["line_no"])
        assert (r["rows"] > 5) == r["too_many"]
    for p, a, b in ranges:
        assert sorted(found.get((p, a, b), [])) == [i for i in range(len(starts.get(p, []))) if a <= i <= b]


@pytest.mark.parametrize("width", [None, 7])
def test_walks(spark, width):
    rng = random.Random(width or 1)
    starts = {p: sorted(rng.sample(range(100), 9)) for p in range(5)}
    probes = [(p, rng.randrange(-5, 110)) for p in range(6) for _ in range(8)]
    hits = spark.createDataFrame([(p, o) for p, xs in starts.items() for o in xs], "path long, byte_off long")
    asked = spark.createDataFrame(sorted(set(probes)), "path long, offset long")
    after = {(r[0], r[1]): r[2] for r in search.next_mark(hits, asked, width).collect()}
    before = {(r[0], r[1]): r[2] for r in search.prev_mark(hits, asked, width).collect()}
    ranks = {(r[0], r[1]): r[2] for r in search.hit_rank(hits, asked, width).collect()}
    numbered = hits.selectExpr("path", "byte_off", "byte_off * 10 as line_no")
    holding = {(r[0], r[1]): r[2] for r in position.offset_to_line(numbered, asked, width).collect()}
    for p, o in set(probes):
        xs = starts.get(p, [])
        assert after[p, o] == next((x for x in xs if x > o), None)
        assert before[p, o] == next((x for x in reversed(xs) if x < o), None)
        if xs:
            assert ranks[p, o] == min(bisect.bisect_left(xs, o), len(xs) - 1)
        at = next((x for x in reversed(xs) if x <= max(o, 0)), None)
        assert holding.get((p, o)) == (None if at is None else at * 10)


def plain_blocks(hits, n, total):
    out = []
    for h in sorted({min(max(h, 0), total - 1) for h in hits} if total > 0 else []):
        s, e = max(h - n, 0), min(h + n, total - 1)
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], e, out[-1][2] + [h])
        else:
            out.append((s, e, [h]))
    return out


@pytest.mark.parametrize("width", [None, 4])
@pytest.mark.parametrize("n", [0, 1, 3])
def test_blocks(spark, n, width):
    rng = random.Random(n)
    files = {p: rng.choice([0, 1, 10, 40]) for p in range(20)}
    hits = {p: [rng.randrange(0, 45) for _ in range(rng.randrange(8))] for p in files}
    fdf = spark.createDataFrame(list(files.items()), "path long, total_lines long")
    hdf = spark.createDataFrame([(p, h) for p, hs in hits.items() for h in hs], "path long, line_no long")
    got = {}
    for r in blocks.context_blocks(hdf, fdf, n, width, hit_list=True).orderBy("path", "block_id").collect():
        got.setdefault(r["path"], []).append((r["start_line"], r["end_line"], r["hit_lines"]))
        assert r["line_count"] == r["end_line"] - r["start_line"] + 1 and r["n_hits"] == len(r["hit_lines"])
    assert got == {p: b for p in files if (b := plain_blocks(hits[p], n, files[p]))}
    with pytest.raises(ValueError):
        blocks.context_blocks(hdf, fdf, -1)


def test_block_rows(spark):
    df = frame(spark, "a\nX\nb\nc\nd\nX\nX")
    files = spark.createDataFrame([(0, 7)], "path long, total_lines long")
    hits = search.search(df, Pattern("X"))
    shown = blocks.block_rows(blocks.context_blocks(hits, files, 1), df, hits).orderBy("row_no").collect()
    assert [(r["row_no"], r["kind"], r["line_no"], r["hit_no"]) for r in shown] == [
        (0, "context", 0, None), (1, "hit", 1, 1), (2, "context", 2, None), (3, "separator", None, None), (4, "context", 4, None), (5, "hit", 5, 2), (6, "hit", 6, 3),
    ]


def test_positions(spark):
    df = frame(spark, "\n".join(f"line {i}" for i in range(50)))
    targets = spark.createDataFrame([(0, 1), (0, 30)], "path long, target long")
    window = position.centered_window(df, targets, 6).collect()
    assert sorted(r["line_no"] for r in window if r["target"] == 1) == list(range(6))
    assert sorted(r["line_no"] for r in window if r["target"] == 30) == list(range(27, 33))
    files = spark.createDataFrame([(0, 389)], "path long, size long")
    for share, want in ((-1.0, [0, 1]), (0.5, [26, 27]), (2.0, [49])):
        assert sorted(r["line_no"] for r in position.jump_percent(df, files, F.lit(share), 2).collect()) == want
    wanted = spark.createDataFrame([(0, 3), (0, 77), (9, 0)], "path long, line_no long")
    assert [r["text"] for r in position.get_lines(df, wanted).collect()] == ["line 3"]
    assert sorted(tuple(r) for r in position.missing_lines(df, wanted).collect()) == [(0, 77), (9, 0)]
    some = position.sample_lines(df, 5, 1).collect()
    assert some == position.sample_lines(df, 5, 1).collect() and len(some) == 5


def test_clamp(spark):
    out = position.clamp_text(frame(spark, "é" * 10 + "\nabc"), max_bytes=5, max_chars=100).orderBy("line_no").collect()
    assert [(r["shown"], r["is_clamped"]) for r in out] == [("éé…", True), ("abc", False)]


def test_colours(spark):
    given = ["#102030", "102030", "#80102030", None, "", "red", "#12345"]
    out = spark.createDataFrame([(c,) for c in given], "c string").select(cells.colour(F.col("c"))).collect()
    assert [r[0] for r in out] == [0xFF102030, 0xFF102030, 0x80102030, None, None, None, None]


def test_usable_rules(spark):
    rows = [("s", 0, "a", False, True, "#000001", None, False, True), ("s", 1, "", False, True, "#000001", None, False, True), ("s", 2, "b", False, True, None, "x", False, True), ("s", 3, "c", False, True, "#000001", None, False, False), ("s", 4, "(", True, True, None, "#000002", False, True)]
    df = spark.createDataFrame(rows, "set_id string, rule_pos int, pattern string, is_regex boolean, ignore_case boolean, fg string, bg string, whole_line boolean, enabled boolean")
    good, bad = rules.compiled(rules.usable_rules(df))
    assert [r.rule_pos for r in good] == [0] and bad == ["("]


def painted(text, own):
    """Per character the colours of the first rule that has one, as disjoint spans."""
    fg, bg = [0] * len(text), [0] * len(text)
    for r in reversed(own):
        spans = [(0, len(text))] if r.whole_line and re.search(r.pattern.text, text) else [m.span() for m in re.finditer(r.pattern.text, text)] if not r.whole_line else []
        for s, e in spans:
            for i in range(s, e):
                fg[i], bg[i] = r.fg if r.fg is not None else fg[i], r.bg if r.bg is not None else bg[i]
    out = []
    for i, c in enumerate(zip(fg, bg)):
        if out and out[-1][2] == c and out[-1][0] + out[-1][1] == i:
            out[-1] = (out[-1][0], out[-1][1] + 1, c)
        elif c != (0, 0):
            out.append((i, 1, c))
    return out


@pytest.mark.parametrize("borders", [256, 3])
def test_painting(spark, monkeypatch, borders):
    monkeypatch.setattr(rules, "BORDERS", borders)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 16))) for _ in range(80)]
    df = frame(spark, *texts)
    for _ in range(3):
        own = [Rule(i, Pattern(rng.choice(["ab", "b+", "[cd]a?", "abc", "d"]), regex=True), rng.choice([None, 1, 2]), rng.choice([3, 4]), rng.random() < 0.2) for i in range(4)]
        got = {}
        for r in rules.painted_spans(df, own).orderBy("path", "start").collect():
            got.setdefault(r["path"], []).append((r["start"], r["len"], (r["fg"], r["bg"])))
        assert {i: got.get(i, []) for i in range(len(texts))} == {i: painted(t, own) for i, t in enumerate(texts)}


def test_overlay(spark):
    out = rules.overlay_search(frame(spark, "abcd"), [Rule(0, Pattern("abc"), fg=5, bg=6)], Pattern("cd"), 9).orderBy("start").collect()
    assert [(r["start"], r["len"], r["fg"], r["bg"]) for r in out] == [(0, 2, 5, 6), (2, 2, 0, 9)]


def test_groups(spark):
    own = [Rule(0, Pattern(r"(\w+)=(\d*)", regex=True), fg=1), Rule(1, Pattern(r"(x)?y", regex=True), fg=2), Rule(2, Pattern("z*", regex=True), fg=3)]
    out = sorted((r["rule_pos"], r["start"], r["len"]) for r in rules.rule_spans(frame(spark, "k=12 b= y zz"), own).collect())
    assert out == [(0, 0, 1), (0, 2, 2), (0, 5, 1), (1, 8, 1), (2, 10, 2)]


@pytest.mark.parametrize("pattern", ["(?=a)|x+", "x*", "(?<=a)b|", r"\\b", "a|$", "(?!x)b"])
def test_patterns_that_match_nothing(spark, pattern):
    """Java and Python find the same matches here; empty ones are left out."""
    texts = ["axbx", "", "xx", "aabb xa", "b", "é x\ufdd0a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    got, pieces = {i: [] for i in range(len(texts))}, {}
    for r in search.match_spans(df, Pattern(pattern, regex=True)).orderBy("start").collect():
        got[r["path"]].append((r["start"], r["start"] + r["len"]))
    for r in search.match_segments(df, Pattern(pattern, regex=True)).orderBy("seg_no").collect():
        pieces.setdefault(r["path"], []).append(r["segment"])
    assert got == {i: [m.span() for m in re.finditer(pattern, t) if m[0]] for i, t in enumerate(texts)}
    assert all("".join(p) == texts[i] for i, p in pieces.items())


def test_long_lines_have_all_their_spans(spark):
    text = " ".join(["ab", "é", "abc"] * 3000)
    df = spark.createDataFrame([(0, 0, text)], "path long, line_no long, text string")
    assert [(r["start"], r["end"], r["token"]) for r in tokens.tokens(df).orderBy("start").collect()] == [(*m.span(), m[0]) for m in re.finditer(r"\S+", text)]
    probes = spark.createDataFrame([(0, 0, 0), (0, 0, 2), (0, 0, 20_004), (0, 0, 10**6), (0, 0, -1), (0, 5, 1)], "path long, line_no long, index int")
    out = {(r["line_no"], r["index"]): (r["start"], r["token"]) for r in tokens.token_at(df, probes).collect()}
    at = next(m for m in re.finditer(r"\S+", text) if m.start() <= 20_004 < m.end())
    assert out == {(0, 0): (0, "ab"), (0, 2): (None, None), (0, 20_004): (at.start(), at[0]), (0, 10**6): (None, None), (0, -1): (None, None), (5, 1): (None, None)}


def test_groups_in_java_syntax(spark):
    own = [Rule(0, Pattern(r"(\p{L}+)x", regex=True), fg=1), Rule(1, Pattern(r"\Q(\E(?<n>\d++)(-\k<n>)?\z", regex=True), fg=2)]
    out = sorted((r["rule_pos"], r["start"], r["len"]) for r in rules.rule_spans(frame(spark, "éax (12-12"), own).collect())
    assert out == [(0, 0, 2), (1, 5, 2), (1, 7, 3)]
    with pytest.raises(ValueError):
        rules.rule_spans(frame(spark, "a"), [Rule(0, Pattern(r"(?:(\p{javaLowerCase}+)x)+", regex=True), fg=1)])
    rows = [("s", i, p, True, False, "#000001", None, False, True) for i, p in enumerate([r"((\p{javaLowerCase})x)*", r"(a)"])]
    df = spark.createDataFrame(rows, "set_id string, rule_pos int, pattern string, is_regex boolean, ignore_case boolean, fg string, bg string, whole_line boolean, enabled boolean")
    good, bad = rules.compiled(rules.usable_rules(df))
    assert [r.rule_pos for r in good] == [1] and len(bad) == 1


def test_many_rules_in_groups(spark):
    own = [Rule(i, Pattern(f"w{i:03d}"), fg=i + 1) for i in range(120)]
    out = rules.rule_hits(frame(spark, "w005 w099 w119"), own).collect()
    assert sorted(r["rule_pos"] for r in out) == [5, 99, 119]


LOGS = {
    "levels": ("x FATAL y", "an Error", "Warning:", "notice", "INFO a", "debug", "trace"),
    "syslog": ("kern.crit", "daemon.err", "warning", "sshd[1]: x", "from 10.0.0.1 on"),
    "access": ('"x" 503 1', '"x" 404 1', '"x" 301 1', '"x" 200 1', '10.0.0.1 - - [x]'),
    "jsonlog": ('{"level": "error"', '{"level":"warning"', '{"level": "info"', '{"msg": "x"', '{"ts":"2024-01-02T03:04:05Z"'),
    "geojson": ('"type": "FeatureCollection"', '"type": "Feature"', '"geometry":', '"coordinates":', '"properties":', '"Point"', '"bbox":'),
    "kml": ("<kml x", "<Document", "<Folder", "<Placemark", "<name>", "<coordinates>", "<Style"),
    "nmea": ("$GPGGA,1", "$GPRMC,1", "$GPGSA,1", "$GPGSV,1", "$GPVTG,1"),
}


@pytest.mark.parametrize("name", rules.PRESETS)
def test_presets(spark, name):
    df = frame(spark, *LOGS[name], "nothing here")
    out = {r["path"]: r["rule_pos"] for r in rules.classify_lines(df, rules.preset_rules(name)).collect()}
    assert out == {**{i: i for i in range(len(LOGS[name]))}, len(LOGS[name]): None}


def test_preset_levels_are_whole_words(spark):
    df = frame(spark, "an interrupt", "more information", "terror and errors", "detracers", "debugging", "xinfo")
    out = {r["path"]: r["rule_pos"] for r in rules.classify_lines(df, rules.preset_rules("levels")).collect()}
    assert out == {0: None, 1: 4, 2: 1, 3: None, 4: None, 5: None}
    assert not [r for r in rules.classify_lines(df, rules.preset_rules("syslog")).collect() if r["rule_pos"] is not None]


def test_rule_sets(spark):
    rule = {"Pattern": "a", "IsRegex": False, "IgnoreCase": True, "Foreground": "#000001", "Background": None, "WholeLine": False, "Enabled": True}
    text = json.dumps([{"Id": "n", "Name": "New", "Rules": [rule, rule]}, {"Id": "k", "Name": "Known", "Rules": [rule]}, {"Id": "", "Name": "Empty", "Rules": [rule]}, {"Id": "n", "Name": "Again", "Rules": []}])
    out = rules.import_rule_sets(spark.createDataFrame([(0, text)], "pos int, json string"), spark.createDataFrame([("k",)], "set_id string"))
    assert sorted((r["set_id"], r["set_name"], r["rule_pos"], r["read_only"]) for r in out.collect()) == [("n", "New", 0, False), ("n", "New", 1, False)]
    back = json.loads(rules.export_rule_sets(out).first()["json"])
    assert back["Id"] == "n" and len(back["Rules"]) == 2


def test_folds(spark):
    log = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, None, 2), ("b", 3, "y", 3), ("c", 4, None, 4), ("c", 5, "z", 5), ("b", 6, "w", 6)], "k string, ts long, v string, e long")
    assert sorted(tuple(r) for r in marks.replay_edits(log, "k", "v", "ts", "e").collect()) == [("b", "w", 6, 6, 2), ("c", "z", 5, 5, 1)]
    assert sorted(tuple(r) for r in marks.replay_edits(log, "k", "v", "ts", "e", first=True, width=2).collect()) == [("b", "w", 6, 6, 1), ("c", "z", 5, 5, 2)]
    assert marks.toggle_fold(log.union(log.where("k = 'c' and ts = 4")), ["k"], "ts").collect()[0]["k"] == "c"
    used = spark.createDataFrame([("u", i, t) for t, i in enumerate("abcab")], "u string, i string, ts long")
    live = spark.createDataFrame([("a",), ("c",)], "i string")
    assert [r["i"] for r in marks.mru(used, "u", "i", "ts", 2).orderBy("place").collect()] == ["b", "a"]
    assert [r["i"] for r in marks.mru(used, "u", "i", "ts", 2, live).orderBy("place").collect()] == ["a", "c"]


def test_histogram(spark):
    hits = spark.createDataFrame([(0, 0), (0, 1), (0, 99), (0, 100)], "path long, byte_off long")
    files = spark.createDataFrame([(0, 100)], "path long, size long")
    assert sorted(tuple(r) for r in marks.hit_histogram(hits, files, 10).collect()) == [(0, 0, 2), (0, 9, 1), (0, 10, 1)]


@pytest.mark.parametrize("text, want", [("", 0), ("abc", 3), ("\t", 8), ("ab\tc", 9), ("漢字", 4), ("Ａa", 3), ("🙂", 2), ("漢\t", 8), ("\u4dc0\u3040\u303f", 5)])
def test_width(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(cells.display_width(F.col("t"))).first()[0] == want


def test_tokens(spark):
    df = frame(spark, "10.0.0.1 foo_bar--x 漢字")
    row = df.select(cells.tokens(F.col("text"), "wide").alias("w"), cells.tokens(F.col("text"), "narrow").alias("n")).first()
    assert [x["matched"] for x in row["w"]] == ["10.0.0.1", "foo_bar--x", "漢字"]
    assert [x["matched"] for x in row["n"]] == ["10", ".", "0", ".", "0", ".", "1", "foo_bar", "--", "x", "漢字"]


def test_lines_longer_than_64_kib(spark):
    from linescope.functions import patterns

    line = "x" * 50_000 + "é tion " + "y" * 50_000 + " Tion tion"
    lines = spark.createDataFrame([("a", 0, line)], "path string, byte_off long, text string")
    at = [m.start() for m in re.finditer("tion", line)]
    assert at[-1] > 100_000
    assert [r["start"] for r in search.match_spans(lines, Pattern("tion")).orderBy("start").collect()] == at
    assert search.match_spans(lines, Pattern("TION", ignore_case=True)).count() == 3
    assert "".join(r["segment"] for r in search.match_segments(lines, Pattern("tion$", regex=True)).orderBy("seg_no").collect()) == line
    assert search.search(lines, Pattern("y Tion", regex=True)).count() == 1
    assert search.search(lines, Pattern("y Tion", regex=True), limit=patterns.MATCH_LIMIT).count() == 0
    assert search.search(lines, Pattern("y Tion"), limit=patterns.MATCH_LIMIT).count() == 1
    made = [rules.Rule(0, Pattern("tion"), fg=1), rules.Rule(1, Pattern("(T)ion", regex=True), fg=2)]
    assert sorted(r["start"] for r in rules.rule_spans(lines, made).collect()) == sorted([*at, line.index("Tion")])
    assert rules.painted_spans(lines, made).count() == 3


@pytest.mark.parametrize(
    "pattern, want",
    [("^line [0-9]*99 of", "line "), ("abc|def", ""), ("ab*cd", "cd"), ("(ab)cd", "cd"), (r"x[a\]b]yz", "yz"), ("[[a]b]cd", "cd"), ("(?i)ab", ""), ("(?:ab|cd)efg", "efg")]
    + [(r"\Qab\E", ""), ("ab+cd", "ab"), ("ab{2,3}cd", "cd"), (r"a\.b\d+foo", "a.b"), ("foo(?=bar)", "foo"), ("a[^]]bcd]", ""), (r"[\\\]]]abc", "]abc"), (r"(a\)b)cde", "cde"), (r"(a)\11bc", ""), ("ab{c", "")],
)
def test_what_matches_must_have(pattern, want):
    assert required(Pattern(pattern, regex=True)) == want


def test_searches_with_a_required_text_lose_nothing(spark):
    rng = random.Random(4)
    parts = ["a", "b", "ab", "a*", "b+", "(ab)?", "[ab]", "[^a]", "a{1,2}", ".", "(?:a|b)c", "c", "ca", "^", "$", r"\w", "(?=c)"]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    some = [Pattern("".join(rng.choices(parts, k=4)), regex=True) for _ in range(60)]
    both = rows.select("text", *[F.struct(matches(F.col("text"), p, None), F.col("text").rlike(p.java())).alias(f"p{i}") for i, p in enumerate(some)])
    found = [v for r in both.collect() for v in r[1:]]
    assert all(a == b for a, b in found) and sum(a for a, _ in found) > 500 and sum(bool(required(p)) for p in some) > 20


def test_many_patterns_are_as_each_alone(spark):
    """Hundreds of patterns of all kinds together find what each finds alone."""
    rng = random.Random(9)
    letters = "abKkSsſKİıiéÉßẞΣσς.é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = spark.createDataFrame([(None,), ("",), ("abab\r",), *((word(rng.randrange(30)),) for _ in range(300))], "text string")
    some = [Pattern(word(rng.randrange(1, 4))) for _ in range(60)] + [Pattern(word(rng.randrange(1, 4)), ignore_case=True) for _ in range(60)]
    some += [Pattern(quoted(word(2)) + rng.choice(["", ".", "[ab]+", "|x"]), regex=True, ignore_case=i % 2 == 0) for i in range(40)]
    some += [Pattern(word(3).replace(".", "x") + "[a-z]?", regex=True) for _ in range(40)] + [Pattern("ab\r"), some[0], some[61]]
    alone = [F.coalesce(matches(F.col("text"), p, None), F.lit(False)) for p in some]
    both = rows.select("text", matching(F.col("text"), some).alias("many"), F.array(*alone).alias("each")).collect()
    assert all(r["many"] == [i for i, hit in enumerate(r["each"]) if hit] for r in both)
    assert sum(len(r["many"]) for r in both) > 1500
    own = [Rule(i * 2, p, fg=i + 1) for i, p in enumerate(some)]
    lines = rows.where("text is not null")
    hits = sorted((r["text"], r["rule_pos"]) for r in rules.rule_hits(lines, own).collect())
    assert hits == sorted((r["text"], i * 2) for r in both if r["text"] is not None for i in r["many"])
    first = {r["text"]: r["rule_pos"] for r in rules.classify_lines(lines, own).collect()}
    assert first == {r["text"]: r["many"][0] * 2 if r["many"] else None for r in both if r["text"] is not None}
    named = search.search_many(lines, {f"f{i}": p for i, p in enumerate(some)})
    assert sorted((r["text"], r["filter_name"]) for r in named.collect()) == sorted((t, f"f{i // 2}") for t, i in hits)


def java_groups(spark, pattern: Pattern, text: str) -> list[tuple[int, int]]:
    """What Java's own matcher says (texts without surrogate pairs)."""
    found, out = spark._jvm.java.util.regex.Pattern.compile(pattern.java()).matcher(text), []
    while found.find():
        groups = [(found.start(g), found.end(g) - found.start(g)) for g in range(1, found.groupCount() + 1) if found.start(g) >= 0]
        groups = [g for g in groups if g[1]] or [(found.start(), found.end() - found.start())]
        out += [g for g in groups if g[1]]
    return out


GROUPED = [r"\\(a)b", "([a-z&&[^b]]+)", "([a-c[x-z]]+)", "(a)(b)?", "(a|(b))c?", "(?:(a)|b)(c)", "x(a(b)c)x", "(a)*b", "(ab|a)+", r"(\w)\1", r"((a)b)\2", "(?i)A(B)", "a(?i)(B)c", "(?<n>a)b\\k<n>"]
GROUPED += ["(a{2})", "(a){2}", "(a+?)(a*)", "(?:a(b)?)?c", "()a", "(a)|", "[(](a)[)]", r"\Q(\E(a)", "(?=a)(a)", "(?<=a)(b)", "(a)(?i:(b))", "([]a]+)", "^(a)|(c)$", "(a)(b)(c)(a)(b)(c)(a)(b)(c)(a)(b)"]


def random_pattern(rng, depth=3):
    parts = ["a", "b", "c", ".", "[ab]", "[^c]", r"\w", "\\b", "x?", "b*", "a{1,2}", "(?:ab|c)", "(?=.)"]
    body = "|".join("".join(rng.choice(parts) if depth == 0 or rng.random() < 0.6 else random_pattern(rng, depth - 1) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([1, 1, 2])))
    return f"({rng.choice(['', '', '?:'])}{body}){rng.choice(['', '', '', '?', '??', '+'])}"


def test_groups_like_javas_matcher(spark):
    """Native spans of groups of 200 expressions are those of Java's matcher."""
    rng = random.Random(11)
    some = [p for p in GROUPED if Layout.of(p)]
    assert len(some) == len(GROUPED)
    while len(some) < 200:
        p = "".join(random_pattern(rng) for _ in range(rng.randrange(1, 3)))
        some += [p] if Layout.of(p) and Syntax(p).count else []
    texts = ["aab", "", r"\ab (a)", "abcxabcx ABab", "é ba abba", "abcabcabcab"] + ["".join(rng.choice("abcx ") for _ in range(12)) for _ in range(6)]
    rows = frame(spark, *texts).select("path", "text")
    for at in range(0, len(some), 25):
        own = [Pattern(p, regex=True) for p in some[at : at + 25]]
        found = rows.select("text", *[group_spans(F.col("text"), p, Layout.of(p.text)).alias(f"p{i}") for i, p in enumerate(own)])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        for r in found.collect():
            for i, p in enumerate(own):
                assert sorted(map(tuple, r[f"p{i}"])) == sorted(java_groups(spark, p, r["text"])), (p.text, Layout.of(p.text).pattern, r["text"])


@pytest.mark.parametrize("pattern", ["(?:x(a))*", "((a)b)+", "(?=(a))a", "(?x)a (b)", "(?<!(a))b", "(?>a(b)|a)c", "(a)++b", "(a)?+b"])
def test_groups_without_a_layout(spark, pattern):
    assert Layout.of(pattern) is None and rules.has_groups(Pattern(pattern, regex=True))


def test_groups_that_repeat_beside_sets_are_refused(spark):
    for p in ("(?:([a-z&&[^b]])x)+", "((a)[a-c[x-z]])+"):
        with pytest.raises(ValueError, match="beside such classes"):
            rules.with_groups(Pattern(p, regex=True))
    own = [Rule(0, Pattern("((a)b)+", regex=True), fg=1)]
    assert sorted((r["start"], r["len"]) for r in rules.rule_spans(frame(spark, "xabab"), own).collect()) == [(3, 1), (3, 2)]


def test_a_text_with_all_marks_is_an_error(spark):
    full = spark.createDataFrame([(1, "".join(chr(c) for c in range(0xFDD0, 0xFDF0)) + "a")], "path long, text string")
    with pytest.raises(Exception, match="cannot be marked"):
        search.match_spans(full, Pattern("a")).collect()


def test_ranges_only_where_files_need_them(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 400), (3, None)], "path long, size long")
    assert ordered.width_for(sizes, F.col("size"), 100) == 100
    assert ordered.width_for(sizes, F.col("size"), 400) is None
    assert ordered.width_for(sizes.where("false"), F.col("size"), 1) is None


def test_tokens_of_mixed_lines(spark):
    """Tokens, placed in batches, and those over a place, found from the place alone, agree with the spans of a line."""
    rng = random.Random(5)
    signs = ["a", "Z", "9", "_", "é", "e\u0301", "語", "😀", "𝐀", "\u00a0", "\u2028", " ", "\t", "-", ".", "\ufdd0", "\r", "٣", "²"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(300)] + ["", " ", "x", "." * 3000 + "y" * 3000]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)] + [(0, len(texts), None)], "path long, line_no long, text string")
    for mode in ("wide", "narrow"):
        rows = df.select("line_no", spans(F.col("text"), cells.TOKENS[mode]).alias("want"), cells.tokens(F.col("text"), mode).alias("got")).collect()
        assert all(r["got"] == r["want"] for r in rows) and rows[-1]["got"] is None
        over = {(r["line_no"], at): (s["start"], s["start"] + s["len"], s["matched"]) for r in rows for s in r["want"] or [] for at in range(s["start"], s["start"] + s["len"])}
        places = [-(1 << 40), -1, *range(65), 2999, 3000, 5999, 6000, 1 << 40]
        probes = df.select("path", "line_no", F.explode(F.lit(places)).alias("index")).union(spark.createDataFrame([(7, 7, 0), (0, 3, None)], "path long, line_no long, index long"))
        found = tokens.token_at(df, probes, mode).collect()
        assert len(found) == (len(texts) + 1) * len(places) + 2
        assert all((r["start"], r["end"], r["token"]) == (over.get((r["line_no"], r["index"]), (None,) * 3) if r["path"] == 0 else (None,) * 3) for r in found)


def test_tokens_are_not_placed_one_by_one(spark, capsys):
    """No lambda runs for each token (27 to 40 us a token), and a probe does not cut its whole line."""
    df = spark.createDataFrame([(0, 0, "a b")], "path long, line_no long, text string").localCheckpoint()
    for rows in (tokens.tokens(df), tokens.token_at(df, df.select("path", "line_no", F.length("text").alias("index")))):
        rows.explain()
        plan = capsys.readouterr().out
        assert "lambda" not in plan and "aggregate(" not in plan
