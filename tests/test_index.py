"""The saved index of files: refreshing, lookups, and the source that takes filters."""

import os
import random

import pytest
from pyspark.sql import functions as F

from linescope.operators import position, search
from linescope.functions.patterns import Pattern
from linescope.sources import files, index
from test_lines import plain_lines

BOM = b"\xef\xbb\xbf"


def plain(data):
    return plain_lines(data, 3 if data.startswith(BOM) else 0)


def some_lines(rng, n):
    return b"".join(("wörd " * rng.randrange(12)).encode() + str(i).encode() + rng.choice([b"\n", b"\r\n"]) for i in range(n))


class Files:
    """A folder of files and its index, of small ranges and spans."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.location, self.data = spark, folder / "files", f"{folder}/index", {}
        self.folder.mkdir()

    def put(self, **data):
        for name, text in data.items():
            self.data[name] = text
            (self.folder / name).write_bytes(text)

    def path(self, name):
        return f"file:{self.folder}/{name}"

    def refresh(self):
        done = index.refresh(self.spark, str(self.folder), self.location, stride=100, width=777)
        return {os.path.basename(r["path"]): (r["action"], r["read_bytes"], r["lines"], r["bytes"], r["size"]) for r in done.collect()}

    def check(self):
        for df in (index.all_lines(self.spark, self.location, width=2000), index.indexed(self.spark, self.location)):
            found = {}
            for r in df.collect():
                found.setdefault(os.path.basename(r["path"]), []).append(tuple(r)[1:])
            assert {n: sorted(rows) for n, rows in found.items()} == {n: plain(d) for n, d in self.data.items() if plain(d)}


@pytest.fixture()
def there(spark, tmp_path):
    return Files(spark, tmp_path)


def test_growth_is_read_from_the_old_end(there):
    rng = random.Random(3)
    first, more = BOM + some_lines(rng, 900), some_lines(rng, 60)
    there.put(big=first, cut=some_lines(rng, 40) + b"tail", long=b"x" * 5000 + b"\n" + b"y" * 3000, one=b"\n", bom=BOM)
    was = there.refresh()
    assert was["big"] == ("new", len(first), 900, len(first), len(first))
    assert was["cut"][2:4] == (40, len(there.data["cut"]) - 4) and was["long"] == ("new", 8001, 1, 5001, 8001)
    there.check()
    assert {r[:2] for r in there.refresh().values()} == {("same", 0)}
    there.check()
    there.put(big=first + more, cut=there.data["cut"] + b" more\nand", long=there.data["long"] + b"z" * 2000, bom=BOM + b"a\nb", new=b"ab")
    now = there.refresh()
    assert now["big"] == ("grown", len(more), 960, len(first + more), len(first + more))
    assert now["cut"] == ("grown", 4 + 9, 41, len(there.data["cut"]) - 3, len(there.data["cut"]))
    assert now["long"] == ("grown", 5000, 1, 5001, 10_001)  # its unterminated line is read anew
    assert now["bom"][:3] == ("grown", 3, 1) and now["new"][0] == "new" and now["one"][:2] == ("same", 0)
    there.check()


def test_what_is_rewritten_or_cut_is_read_whole(there):
    rng = random.Random(4)
    there.put(cut=some_lines(rng, 300), head=some_lines(rng, 300), tail=some_lines(rng, 300), gone=b"a\n")
    there.refresh()
    there.put(cut=there.data["cut"][:2000], head=b"Q" + there.data["head"][1:] + b"more\n", tail=there.data["tail"][:-3] + b"Q\nmore\n")
    os.remove(there.folder / "gone")
    del there.data["gone"]
    now = there.refresh()
    assert {n: r[:2] for n, r in now.items()} == {n: ("rewritten", len(d)) for n, d in there.data.items()}
    there.check()
    there.put(cut=there.data["cut"] + b"!\nx\n")  # goes on under the new generation
    assert there.refresh()["cut"][0] == "grown"
    there.check()


def test_a_refresh_that_fails_changes_nothing(there, monkeypatch):
    rng = random.Random(5)
    there.put(a=some_lines(rng, 100))
    there.refresh()
    before = there.data["a"]
    there.put(a=before + b"more\nand more\n")

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(index, "_proofs", lambda df, size, out, real=index._proofs: real(df, size, out) if out == "found" else fails())
        with pytest.raises(RuntimeError):
            there.refresh()
    assert os.path.isdir(f"{there.location}/spans/v=2") and not os.path.isdir(f"{there.location}/manifest/2")
    there.data["a"] = before
    found = [tuple(r)[1:] for r in index.spans(there.spark, there.location).orderBy("start").collect()]
    assert sum(n for *_, n in found) == 100 and found[-1][2] == len(before)
    there.data["a"] = before + b"more\nand more\n"
    assert there.refresh()["a"][:3] == ("grown", 14, 102)
    there.check()


def test_lookups(spark, there):
    rng = random.Random(6)
    there.put(big=BOM + some_lines(rng, 400), cut=some_lines(rng, 30) + b"tail\xff", long=b"x" * 5000 + b"\r\n" + some_lines(rng, 5), none=BOM)
    there.refresh()
    there.put(big=there.data["big"] + some_lines(rng, 30))
    there.refresh()
    for name, data in there.data.items():
        want, path = plain(data), there.path(name)
        asked = spark.createDataFrame([(path, i) for i in [*range(-2, len(want) + 3), 1, 1]], "path string, line_no long")
        got = sorted(tuple(r)[1:] for r in index.fetch_lines(spark, there.location, asked).collect())
        assert got == sorted(want + want[1:2] * 2)
        assert got == sorted(tuple(r)[1:] for r in position.get_lines(files.numbered_files(spark, path), asked).select("path", "line_no", "byte_off", "n_bytes", "text").collect())
        offsets = {-5, 0, 1, 2, 3, len(data) - 1, len(data), len(data) + 9, *(rng.randrange(len(data) + 1) for _ in range(30))}
        probes = spark.createDataFrame([(path, o) for o in offsets], "path string, offset long")
        held = {r["probe"]: (r["line_no"], r["byte_off"], r["n_bytes"], r["text"]) for r in index.lines_at(spark, there.location, probes, 100).collect()}
        assert held == {o: max([x for x in want if x[1] <= o], default=want[0]) for o in offsets if want}
        pages = {}
        for r in index.pages_at(spark, there.location, probes, 3, 100).collect():
            pages.setdefault(r["offset"], []).append((r["turn"], r["line_no"], r["text"]))
        assert {o: sorted(p) for o, p in pages.items()} == {o: p for o in offsets if (p := [(i, x[0], x[3]) for i, x in enumerate([x for x in want if x[1] >= o][:3], 1)])}


def test_filters_choose_what_is_read(spark, there):
    rng = random.Random(7)
    there.put(big=some_lines(rng, 700), other=some_lines(rng, 50) + b"last")
    there.refresh()
    table, big, other = index.indexed(spark, there.location), plain(there.data["big"]), plain(there.data["other"])
    rows = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    path = F.col("path") == there.path("big")
    assert rows(table.where(path & F.col("line_no").between(10, 200) & F.col("text").contains("d 11"))) == [x for x in big if 10 <= x[0] <= 200 and "d 11" in x[3]]
    assert rows(table.where(path & F.col("line_no").isin(5, 7, 100, 9999))) == [x for x in big if x[0] in (5, 7, 100)]
    assert rows(table.where("line_no in (3, 49, 50, 699)")) == sorted([x for x in big if x[0] in (3, 49, 50, 699)] + [x for x in other if x[0] in (3, 49, 50)])
    assert rows(table.where(path & (F.col("byte_off") > 300) & (F.col("byte_off") <= 900))) == [x for x in big if 300 < x[1] <= 900]
    assert rows(table.where("line_no = 3 and line_no = 4")) == rows(table.where("path = 'none'")) == []
    assert rows(search.search(table, Pattern("wörd 1+[02468]$", regex=True))) == sorted(x for x in big + other if x[3][-1] in "02468" and "wörd 1" in x[3] and set(x[3].rsplit(" ", 1)[1][:-1]) == {"1"})
    assert rows(search.search(table, Pattern("last"))) == [other[-1]]


def test_parts_that_the_filters_leave(spark, there):
    """Of many spans only those that can hold a wanted line are planned."""
    from pyspark.sql import datasource as api

    there.put(big=some_lines(random.Random(8), 2000))
    there.refresh()
    read = lambda filters: _planned(there, filters)
    size = len(there.data["big"])
    assert read([]) == size
    assert 0 < read([api.In(("line_no",), (17, 900, 1500))]) < 1200
    assert 0 < read([api.GreaterThan(("byte_off",), 4000), api.LessThanOrEqual(("byte_off",), 4100)]) < 800
    assert read([api.EqualTo(("path",), "no")]) == 0


def _planned(there, filters):
    reader = index.IndexReader({"location": f"file:{there.location}", "version": "1", "tasks": "3"})
    assert list(reader.pushFilters(filters)) == filters
    return sum(stop - start for part in reader.partitions() for _, start, stop, _ in part.pieces)


def test_no_index(spark, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        index.indexed(spark, f"{tmp_path}/none")
    assert index.spans(spark, f"{tmp_path}/none").count() == 0
