"""UTF-16 and UTF-32 files over many ranges, against Python's decoder."""

import random

import pytest
from pyspark.sql import functions as F

from linescope.sources import files, lines, wide


def plain(data: bytes, name: str):
    units = wide.CHARSETS[name]
    at = len(units.mark) if data.startswith(units.mark) else 0
    parts = data[at:].decode(units.codec, "replace").split("\n")
    parts = parts[:-1] if parts[-1] == "" else parts
    out = []
    for i, text in enumerate(parts):
        size = len(text.encode(units.codec, "replace"))
        out.append((i, at, size, text.removesuffix("\r")))
        at += size + units.size
    return out


def some_text(rng, n):
    # U+0A0A and U+0A00 have the byte of a line feed in either half, U+10A0A in a surrogate
    words = ["a", "ਊ", "਀", "ü", "𐨊", "Ċ", "long " * 40, "", "x\r"]
    return "".join("".join(rng.choices(words, k=rng.randrange(4))) + rng.choice(["\n", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize("name", wide.CHARSETS)
def test_wide_files(spark, tmp_path, name):
    rng, units = random.Random(name), wide.CHARSETS[name]
    texts = {"marked": some_text(rng, 400), "open": some_text(rng, 30) + "tail", "one": "\n", "long": "x" * 3000 + "\n" + "ਊ" * 2000}
    data = {n: (units.mark if n == "marked" else b"") + t.encode(units.codec) for n, t in texts.items()} | {"mark": units.mark}
    for n, d in data.items():
        (tmp_path / n).write_bytes(d)
    for width in (1001, 64 << 20):
        found = {}
        for r in files.numbered_files(spark, str(tmp_path), encoding=name, width=width).collect():
            found.setdefault(r["path"].rsplit("/", 1)[1], []).append(tuple(r)[1:])
        assert {n: sorted(rows) for n, rows in found.items()} == {n: plain(d, name) for n, d in data.items() if plain(d, name)}


def test_broken_units(tmp_path):
    """Half a pair before a line feed, and a byte too many at the end."""
    units, path = wide.CHARSETS["UTF-16LE"], tmp_path / "broken"
    data = b"\x00\xd8\n\x00a\x00\n\x00b\x00c"
    path.write_bytes(data)
    [(at, whole), (rest_at, rest)] = list(wide.whole_lines(units, f"file:{path}", 0, len(data)))
    assert (at, rest_at) == (0, 8)
    begins, sizes, texts = wide.split_lines(units, whole)
    assert (begins.tolist(), sizes.tolist(), texts) == ([0, 4], [2, 2], ["�", "a"])
    assert wide.split_lines(units, rest)[2] == ["b�"]


def test_charsets_that_are_not_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"a\n")
    for call in (lambda: files.numbered_files(spark, str(tmp_path), "UTF-16"), lambda: wide.wide_files(spark, str(tmp_path), "latin-1"), lambda: lines.read_lines(spark, str(tmp_path), "UTF-16LE")):
        with pytest.raises(ValueError):
            call()


def test_sums_of_many_blocks_are_not_broadcast(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"a\nb\n")
    raw = lines.read_lines(spark, str(tmp_path))
    hinted = lambda: "BroadcastHashJoin" in lines.number_lines(raw)._jdf.queryExecution().optimizedPlan().toString() or "strategy=broadcast" in lines.number_lines(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert hinted()
    monkeypatch.setattr(lines, "FEW_BLOCKS", 1)
    assert not hinted()
    assert lines.number_lines(raw).select(F.sum("line_no")).first()[0] == 1
