"""Sources: lines, numbers, offsets, encodings and export."""

import random

import pytest
from pyspark.sql import functions as F

from linescope.sources import encoding, files, lines


def plain_lines(data: bytes, bom: int = 0):
    """(line number, offset, bytes, text) of a file's bytes."""
    out, at = [], bom
    parts = data[bom:].split(b"\n")
    if parts[-1] == b"":
        parts.pop()
    for i, p in enumerate(parts):
        out.append((i, at, len(p), p.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(p) + 1
    return out


FILES = {
    "lf": b"a\nb\n\nc\n",
    "crlf": b"a\r\nb\r\r\n\r\nc\r\n",
    "unterminated": "é\nx\nlast".encode(),
    "empty": b"",
    "one": b"\n",
    "cr": b"a\rb\rc",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where, rng = tmp_path_factory.mktemp("files"), random.Random(5)
    for name, data in FILES.items():
        (where / name).write_bytes(data)
    big = b"".join(("wörd " * rng.randrange(12)).encode() + str(i).encode() + rng.choice([b"\n", b"\r\n"]) for i in range(6000))
    (where / "big").write_bytes(b"\xef\xbb\xbf" + big)
    return where


def test_numbers_and_offsets_over_many_splits(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # blocks go on over batches
    try:
        raw = lines.read_lines(spark, str(folder))
        boms = encoding.profile_files(spark, str(folder))
        assert raw.rdd.getNumPartitions() > 5
        found = {}
        for r in lines.number_lines(raw, boms).collect():
            found.setdefault(r["path"].rsplit("/", 1)[1], []).append(tuple(r)[1:])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for path in folder.iterdir():
        data = path.read_bytes()
        want = plain_lines(data, 3 if path.name == "big" else 0)
        assert sorted(found.get(path.name, [])) == want, path.name


@pytest.mark.parametrize("size, block", [(20_000, 4 << 20), (1000, 64), (7, 3), (64 << 20, 4 << 20)])
def test_whole_lines_of_ranges(folder, size, block):
    for path in (p for p in folder.iterdir() if p.name != "big" or size > 10):
        data = path.read_bytes()
        found = [files.starts(f"file:{path}", 0, at, min(at + size, len(data))) for at in range(0, len(data), size)]
        firsts = [f[1] for f in found if f[0]] + [len(data)]
        got, n = [], 0
        for start, stop in zip(firsts, firsts[1:]):
            for at, part, _ in files.whole_lines(f"file:{path}", start, stop, block=block):
                begins, lengths, raw = files.split_lines(part)
                got += [(n + k, at + b, size_, t.removesuffix("\r")) for k, (b, size_, t) in enumerate(zip(begins.tolist(), lengths.tolist(), raw.to_pylist()))]
                assert files.split_lines(part, bare=True)[2].to_pylist() == [t.removesuffix("\r") for t in raw.to_pylist()]
                n += len(begins)
        assert got == plain_lines(data, 3 if path.name == "big" else 0), path.name
        assert sum(f[0] for f in found) == len(got) and (not got or max(f[2] for f in found if f[2] is not None) == got[-1][1])


@pytest.mark.parametrize("width", [997, 64 << 20])
def test_numbered_files(spark, folder, width):
    found = {}
    for r in files.numbered_files(spark, str(folder), width=width).collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append(tuple(r)[1:])
    for path in folder.iterdir():
        assert sorted(found.get(path.name, [])) == plain_lines(path.read_bytes(), 3 if path.name == "big" else 0), path.name
    assert files.numbered_files(spark, str(folder / "empty")).count() == 0


def test_a_line_over_many_ranges(spark, tmp_path):
    """Its bytes are read by one task, in one piece; lines behind it are other tasks'."""
    long = ("é" * 40_000 + "x") * 40
    (tmp_path / "long").write_text(f"first\n{long}\nlast\n")
    ranges = files.ranges_of(files.listed(spark, str(tmp_path)).withColumn("origin", F.lit(0).cast("long")), 50_000)
    spans = sorted(tuple(r)[1:] for r in files.spans_of(files.measured(ranges)).collect())
    size = len(long.encode())
    assert spans == [(0, size + 7, 0), (size + 7, size + 12, 2)]
    got = [tuple(r)[1:] for r in files.numbered_files(spark, str(tmp_path), width=50_000).orderBy("line_no").collect()]
    assert got == [(0, 0, 5, "first"), (1, 6, size, long), (2, size + 7, 4, "last")]
    cut = files.numbered_files(spark, str(tmp_path), width=50_000, longest=10_001).orderBy("line_no").collect()
    assert [tuple(r)[1:] for r in cut] == [(0, 0, 5, "first"), (1, 6, size, "é" * 5000), (2, size + 7, 4, "last")]


def test_lines_beyond_the_limit(tmp_path, monkeypatch):
    (tmp_path / "long").write_bytes(b"a\n" + b"x" * 1000 + b"\nb\n")
    path = f"file:{tmp_path}/long"
    monkeypatch.setattr(files, "LONGEST", 900)
    with pytest.raises(ValueError, match="give longest="):
        list(files.whole_lines(path, 0, 1005, block=64))
    for block in (64, 4096):
        rows = list(files.whole_lines(path, 0, 1005, longest=100, block=block))
        assert b"".join(r[1] for r in rows).count(b"x") == (100 if block == 64 else 1000) and sum(r[2] for r in rows) == (900 if block == 64 else 0)


def test_search_of_files(spark, folder):
    from linescope.functions.patterns import Pattern
    from linescope.operators import search

    raw = lines.read_lines(spark, str(folder / "big"))
    all_ = {tuple(r) for r in lines.number_lines(raw).collect()}
    for pattern in (Pattern("wörd 1"), Pattern("[02468]$", regex=True)):
        found = {tuple(r) for r in search.search_files(raw, pattern).collect()}
        assert found == {r for r in all_ if ("wörd 1" in r[4] if pattern.plain else r[4][-1] in "02468")} and found


def test_numbers_need_all_lines(spark, folder):
    raw = lines.read_lines(spark, str(folder))
    with pytest.raises(Exception, match="none dropped or moved"):
        lines.number_lines(raw.where("length(raw) > 1")).collect()


def test_column_lines_use_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb")], "k long, t string")
    plan = lines.lines_from_column(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    long = spark.createDataFrame([(1, "\n".join("é" * (i % 7) for i in range(5000)))], "k long, t string")
    found = [tuple(r)[1:4] for r in lines.lines_from_column(long, "k", "t").collect()]
    assert found == [x[:3] for x in plain_lines(long.first()["t"].encode())]


def test_lines_from_column_like_files(spark):
    rng = random.Random(6)
    texts = [d.decode() for d in FILES.values()] + ["".join(rng.choice(["a", "ü", "\n", "\r", "\r\n", ""]) for _ in range(rng.randrange(30))) for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    found = {}
    for r in lines.lines_from_column(df, "k", "t").collect():
        found.setdefault(r["k"], []).append(tuple(r)[1:])
    for i, t in enumerate(texts):
        assert sorted(found.get(i, [])) == plain_lines((t or "").encode()), repr(t)


def test_lines_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, f"l{i}\nm\nn") for i in range(30)], "path long, t string")
    made = lines.lines_from_column(df, "path", "t")
    lines.save_lines_table(made, str(tmp_path / "t"), 3)
    opened = lines.open_lines_table(spark, str(tmp_path / "t"))
    assert sorted(opened.collect()) == sorted(made.collect())
    assert "PushedFilters: [IsNotNull(line_no), EqualTo(line_no,1)]" in opened.where("line_no = 1")._jdf.queryExecution().executedPlan().toString()


def test_checkpoints_at_the_end(spark):
    df = spark.createDataFrame([(0, 4, 8, True), (1, 4, 7, False), (2, 0, 0, False)], "path long, total_lines long, size long, terminated boolean")
    made = lines.lines_from_column(spark.createDataFrame([(0, "a\nb\nc\nd\n"), (1, "a\nb\nc\nd")], "path long, t string"), "path", "t")
    found = sorted(tuple(r) for r in lines.line_checkpoints(made, df, 2).collect())
    assert found == [(0, 0, 0, 0), (0, 1, 2, 4), (0, 2, 4, 8), (1, 0, 0, 0), (1, 1, 2, 4), (2, 0, 0, 0)]


def test_export(spark, tmp_path):
    rows = [("p", 0, "hit", 1233, 1, "x"), ("p", 1, "separator", None, None, None), ("p", 2, "context", 2000, None, "y")]
    df = spark.createDataFrame(rows, "path string, row_no long, kind string, line_no long, hit_no long, text string")
    lines.write_lines(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == ["1,234\tx", "⋯", "2,001\ty"]


HEADS = {
    "utf8": ("日本語 text".encode(), "UTF-8", 0),
    "ascii": (b"plain", "UTF-8", 0),
    "cut": ("日本".encode()[:-1], "UTF-8", 0),
    "bom8": (b"\xef\xbb\xbfx", "UTF-8", 3),
    "bom16le": (b"\xff\xfex\0", "UTF-16LE", 2),
    "bom16be": (b"\xfe\xff\0x", "UTF-16BE", 2),
    "bom32": (b"\xff\xfe\0\0x\0\0\0", "UTF-32LE", 4),
    "sjis": ("これは日本語の文章です。漢字とカナ".encode("shift_jis"), "Shift_JIS", 0),
    "euc3": (b"\x8f\xb0\xa1" * 3 + "漢字とかな".encode("euc_jp") + b"\x8e\xb1", "EUC-JP", 0),
    "euc": ("これは日本語の文章です。漢字とカナ".encode("euc_jp"), "EUC-JP", 0),
}


def test_encodings(spark, tmp_path):
    for name, (data, _, _) in HEADS.items():
        (tmp_path / name).write_bytes(data + b"\n")
    found = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["bom_len"], r["has_bom"]) for r in encoding.profile_files(spark, str(tmp_path)).collect()}
    for name, (_, kind, bom) in HEADS.items():
        if name != "cut":
            assert found[name] == (kind, bom, bom > 0), name
    assert encoding.detect(HEADS["cut"][0]) == ("UTF-8", 0)


@pytest.mark.parametrize("charset, python", [("MS932", "shift_jis"), ("EUC-JP", "euc_jp")])
def test_decode_lines(spark, tmp_path, charset, python):
    texts = ["これは", "日本語", "漢字"]
    (tmp_path / "f").write_bytes("\r\n".join(texts).encode(python))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        raw = lines.read_lines(spark, str(tmp_path), charset)
        assert [r["text"] for r in raw.orderBy("seq").collect()] == texts
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    with pytest.raises(ValueError):
        lines.read_lines(spark, str(tmp_path), "UTF-16LE")


def test_newlines(spark, tmp_path):
    for name, data in {"lf": b"a\nb", "crlf": b"a\nb\r\n", "cr": b"a\rb", "none": b"a"}.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1]: r["newline"] for r in encoding.detect_newline(spark, str(tmp_path)).collect()}
    assert found == {"lf": "Lf", "crlf": "CrLf", "cr": "Cr", "none": "Lf"}
