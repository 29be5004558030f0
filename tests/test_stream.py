"""The tail stream: appends, half lines, shrinking and restarts."""

import os

import pytest
from pyspark.sql import functions as F

from linescope.functions.patterns import Pattern
from linescope.sources.files import numbered_files
from linescope.streaming import segments, tables, tail


def run(spark, stream, checkpoint, out):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def lines_of(spark, out):
    return sorted((r["line_no"], r["byte_off"], r["text"]) for r in spark.read.parquet(out).collect())


def test_tail(spark, tmp_path):
    log, out, checkpoint = tmp_path / "a.log", str(tmp_path / "out"), str(tmp_path / "cp")
    log.write_bytes(b"one\ntwo\r\nhal")
    stream = tail.tail_numbered(tail.tail_lines(spark, str(tmp_path / "*.log")))
    run(spark, stream, checkpoint, out)
    assert lines_of(spark, out) == [(0, 0, "one"), (1, 4, "two")]
    with log.open("ab") as f:
        f.write(b"f\nthree\n")
    run(spark, stream, checkpoint, out)  # goes on from the checkpoint
    want = [(0, 0, "one"), (1, 4, "two"), (2, 9, "half"), (3, 14, "three")]
    assert lines_of(spark, out) == want
    log.write_bytes(b"one\n")  # a shrunk file gives nothing
    run(spark, stream, checkpoint, out)
    assert lines_of(spark, out) == want


def test_tail_search(spark, tmp_path):
    (tmp_path / "a.log").write_text("ok\nERROR x\nwarn\n")
    stream = tail.tail_search(tail.tail_lines(spark, str(tmp_path / "*.log")), {"bad": Pattern("error", ignore_case=True), "any": Pattern("o", ignore_case=True)})
    query = stream.writeStream.format("memory").queryName("tail_hits").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted((r["filter_name"], r["text"]) for r in spark.table("tail_hits").collect()) == [("any", "ERROR x"), ("any", "ok"), ("bad", "ERROR x")]


def test_ranges_end_at_line_feeds(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "RANGE", 10)
    path = tmp_path / "a.log"
    path.write_bytes(b"".join(b"line %d\n" % i for i in range(20)) + b"rest")
    reader = tail.TailReader(str(path))
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) > 5
    rows = [t for p in parts for b in reader.read(p) for t in b.column(2).to_pylist()]
    assert rows == [f"line {i}" for i in range(20)]


def test_files_that_are_cut_after_planning(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"".join(b"line %d\n" % i for i in range(20)))
    reader = tail.TailReader(str(path))
    parts = reader.partitions({}, reader.latestOffset())
    path.write_bytes(b"line 0\nline")
    assert [t for p in parts for b in reader.read(p) for t in b.column(2).to_pylist()] == ["line 0"]


def test_batches_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 7)
    (tmp_path / "d").mkdir()
    path = tmp_path / "d" / "a.log"
    path.write_bytes(b"".join(b"l\xc3\xa9 %d\r\n" % i for i in range(20)) + b"rest")
    reader = tail.TailReader(f"file://{tmp_path}/*/a*", per_batch=20)
    start, texts, offsets, steps = reader.initialOffset(), [], [], 0
    while (end := reader.latestOffset()) != start:
        for part in reader.partitions(start, end):
            assert part.end - part.begin < 20 + 9
            for b in reader.read(part):
                offsets += b.column(1).to_pylist()
                texts += b.column(2).to_pylist()
        start, steps = end, steps + 1
    assert steps > 5 and texts == [f"lé {i}" for i in range(20)]
    data = path.read_bytes()
    assert [data[o:].split(b"\r")[0].decode() for o in offsets] == texts


def test_deleted_keys_stay_deleted(spark, tmp_path):
    for rows in ([("a", 1, "x"), ("b", 2, "y")], [("a", 5, None)], [("a", 3, "late"), ("b", 4, "z")]):
        spark.createDataFrame(rows, "k string, ts long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = tail.replay_stream(stream, "k", "ts", str(tmp_path / "table"), str(tmp_path / "cp"), value="v").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "table" / "2")).where("v is not null").collect()) == [("b", 4, "z")]
    assert not (tmp_path / "table" / "0").exists()


def test_replay_stream(spark, tmp_path):
    for i, rows in enumerate(([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")])):
        spark.createDataFrame(rows, "k string, ts long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = tail.replay_stream(stream, "k", "ts", str(tmp_path / "table"), str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "table" / "1")).collect()) == [("a", 3, "z"), ("b", 2, "y")]


def test_a_mark_of_byte_order(spark, tmp_path):
    """It belongs to no line, in a tail as in a file that is read whole."""
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbfabc\nx\xef\xbb\xbf\n")
    stream = tail.tail_numbered(tail.tail_lines(spark, str(tmp_path / "*.log")))
    run(spark, stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    want = [tuple(r)[1:] for r in numbered_files(spark, str(tmp_path / "a.log")).select("path", "line_no", "byte_off", "text").collect()]
    assert lines_of(spark, str(tmp_path / "out")) == sorted(want) == [(0, 3, "abc"), (1, 7, "x﻿")]


@pytest.mark.parametrize("encoding", ["shift_jis", "latin-1", ""])
def test_tail_of_other_charsets(spark, tmp_path, encoding):
    text = "日本 x\r\nかな\n" if encoding == "shift_jis" else "é x\r\nü\n"
    (tmp_path / "a.log").write_bytes(text.encode(encoding or "utf-8") + b"\xff\n")
    run(spark, tail.tail_numbered(tail.tail_lines(spark, str(tmp_path / "*.log"), encoding=encoding)), str(tmp_path / "cp"), str(tmp_path / "out"))
    bad = b"\xff".decode(encoding or "utf-8", "replace")
    assert [t for _, _, t in lines_of(spark, str(tmp_path / "out"))] == [t.removesuffix("\r") for t in text.split("\n")[:-1]] + [bad]
    for wrong, error in (("utf-16", ValueError), ("no-such", LookupError)):
        with pytest.raises(error):
            tail.tail_lines(spark, str(tmp_path), encoding=wrong)


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        hidden = folder / f".{name}"
        hidden.write_bytes(data)
        hidden.rename(folder / name.replace("_", "."))


def test_segments_that_cut_lines(spark, tmp_path):
    """A line over three segments and a restart; segments out of turn, again, and of another log."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    name = F.regexp_extract("path", "([a-z]+)[.]([0-9]+)$", 1)
    number = F.regexp_extract("path", "([a-z]+)[.]([0-9]+)$", 2)
    put(folder, a_0=b"\xef\xbb\xbfone\ntwo \xc3", b_0=b"x\r\n", a_2=b" more")
    stream = lambda: segments.segment_lines(segments.segment_files(spark, str(folder), name, number, 2))
    run(spark, stream(), checkpoint, out)
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert rows() == [("a", 0, 3, "one"), ("b", 0, 0, "x")]
    put(folder, a_1=b"\xa9", c_1=b"waits\n")
    run(spark, stream(), checkpoint, out)
    assert len(rows()) == 2
    put(folder, a_3=b"\r\nthree\n\nrest", a_00=b"again\n")
    run(spark, stream(), checkpoint, out)
    whole = [("a", 0, 3, "one"), ("a", 1, 7, "two é more"), ("a", 2, 20, "three"), ("a", 3, 26, ""), ("b", 0, 0, "x")]
    assert rows() == whole
    put(folder, a_4=b"\n", b_1=b"y\n")
    run(spark, stream(), checkpoint, out)
    assert rows() == sorted([*whole, ("a", 4, 27, "rest"), ("b", 1, 3, "y")])


def test_waiting_segments_are_packed():
    some = {3: b"abc", 10: b"", 4: b"\n" * 1000}
    assert segments.unpacked(segments.packed(some)) == some and segments.unpacked(b"") == {}


def test_hits_are_appended_once(spark, tmp_path, monkeypatch):
    """A batch that fails after its write is run again and leaves its hits once; one that fails before it loses none."""
    log, table, checkpoint = tmp_path / "a.log", str(tmp_path / "hits"), str(tmp_path / "cp")
    log.write_text("error 1\nok\nerror 2\n")
    hits = lambda: tail.tail_search(tail.tail_lines(spark, str(tmp_path / "*.log")), Pattern("error"))
    seen = lambda: sorted(r["text"] for r in tables.open_hits(spark, table, hits().schema).collect())

    def run_once():
        query = tables.append_hits(hits(), table, checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    assert seen() == []
    real, fails = tables.complete, {"after": True}

    class Broken(Exception):
        pass

    from pyspark.sql.readwriter import DataFrameWriter

    written = DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        written(self, path, *a, **k)
        if fails.pop("after", False):
            raise Broken("after the write")

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(Exception, match="after the write"):
        run_once()
    assert real(spark, table) == [0] and seen() == ["error 1", "error 2"]
    run_once()
    assert seen() == ["error 1", "error 2"]
    with log.open("a") as f:
        f.write("error 3\n")
    (tmp_path / "hits" / "batch=1").mkdir()  # what a failed write has left
    (tmp_path / "hits" / "batch=1" / "part-0.parquet").write_bytes(b"half")
    assert seen() == ["error 1", "error 2"]
    run_once()
    assert seen() == ["error 1", "error 2", "error 3"]


def edit(spark, folder, *rows):
    spark.createDataFrame(rows, "k string, ts long, v string").coalesce(1).write.mode("append").parquet(str(folder))


def test_upserts_rewrite_the_buckets_of_their_keys(spark, tmp_path):
    log, table = tmp_path / "in", tmp_path / "table"
    schema = "k string, ts long, v string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(log))

    def run_all():
        query = tables.upsert_stream(stream(), "k", "ts", str(table), str(tmp_path / "cp"), value="v", buckets=16).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    edit(spark, log, *[(f"k{i}", 1, "x") for i in range(200)])
    run_all()
    assert len(os.listdir(table / "data" / "0")) > 12
    edit(spark, log, ("k7", 5, None), ("k7", 5, "tie"))
    edit(spark, log, ("k7", 3, "late"), ("k8", 4, "z"), ("new", 1, "n"))
    run_all()
    for batch, most in ((1, 1), (2, 3)):
        assert 0 < len([f for f in os.listdir(table / "data" / str(batch)) if f.startswith("bucket=")]) <= most
    want = {f"k{i}": (1, "x") for i in range(200) if i != 7} | {"k8": (4, "z"), "new": (1, "n")}
    now = {r["k"]: (r["ts"], r["v"]) for r in tables.open_upserted(spark, str(table), schema, "v").collect()}
    assert now == want
    edit(spark, log, *[(f"k{i}", 9, "y") for i in range(200)])
    edit(spark, log, ("k1", 10, "last"))
    run_all()
    now = {r["k"]: r["v"] for r in tables.open_upserted(spark, str(table), schema, "v").collect()}
    assert now == {**{f"k{i}": "y" for i in range(200)}, "k1": "last", "new": "n"}
    assert len(tables.complete(spark, str(table / "manifest"))) == 2


def test_a_failed_upsert_is_as_if_it_had_not_been(spark, tmp_path):
    log, table, schema = tmp_path / "in", str(tmp_path / "table"), "k string, ts long, v string"
    edit(spark, log, ("a", 1, "x"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(log))
    writer = lambda: tables.upsert_stream(stream, "k", "ts", table, str(tmp_path / "cp"), buckets=4)

    def run_all():
        query = writer().start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run_all()
    edit(spark, log, ("a", 2, "y"))
    real = tables._tidy
    try:
        tables._tidy = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))  # the manifest is written, its success not noted
        with pytest.raises(Exception, match="lost"):
            run_all()
    finally:
        tables._tidy = real
    run_all()
    assert [tuple(r) for r in tables.open_upserted(spark, table, schema).collect()] == [("a", 2, "y")]
    with pytest.raises(ValueError):
        tables.upsert_stream(stream, "k", "ts", table, "cp", buckets=0)
