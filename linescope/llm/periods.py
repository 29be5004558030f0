"""Runs: stretches of words that repeat with one period, all of them, in each text.

Words become numbers. For each period q every q-th place of a text is a grid; a run of at least four periods matches
itself q words on at three places of the grid in a row, so only such places are looked at: how far the match goes on, to
both sides, says where the run begins and ends. All grids together have n * (1 + 1/2 + 1/3 + ...) places. How far two
places of a text match is asked of an index of sampled suffixes, in constant time.

A difference cover modulo ``V`` is a set of remainders such that any two places come to remainders in the set after the
same few words, fewer than ``V``. Only suffixes at such places are sorted: by their first ``V`` words and then by doubling
of sorted lengths, as the place ``V * 2**k`` further on is a sample too. A table of minima over the common prefixes of
neighbours in that order answers for any two samples.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescope.llm import tokens

#: A difference cover: every remainder modulo V is a difference of two of its numbers.
V, COVER = 13, np.array([0, 1, 3, 9])
#: Periods of a run at least, words of a run at least, and places of grids that are looked at in one step.
PERIODS, SHORTEST, STEP = 4, 6, 1 << 20
#: Times that only the first places of matches are asked for, before all that are left are.
ROUNDS = 8

_slot = np.full(V, -1)
_slot[COVER] = np.arange(len(COVER))
#: For two remainders the words after which both are in the cover.
_shift = np.array([[min(d for d in range(V) if _slot[(a + d) % V] >= 0 and _slot[(b + d) % V] >= 0) for b in range(V)] for a in range(V)])


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


class Extensions:
    """How many words match from two places of a sequence of numbers on; negative numbers must occur once each."""

    def __init__(self, words: np.ndarray):
        n = -(-(len(words) + V) // V) * V + V
        low = min(0, int(words.min(initial=0)))
        self.words = np.concatenate((words, low - 1 - np.arange(n - len(words))))  # ends that match nothing
        blocks = (n - V) // V
        places = (np.arange(blocks)[:, None] * V + COVER).ravel()
        codes = _ranks(self.words)
        bits = max(1, int(codes.max()).bit_length())
        rank, at = np.zeros(len(places), np.int32), 0
        while at < V:  # the first V words, as many to a key as it holds
            used = max(1, int(rank.max()).bit_length())
            key = rank.astype(np.int64)
            while at < V and used + bits <= 62:
                key, used, at = (key << bits) | codes[places + at], used + bits, at + 1
            rank = _ranks(key)
        levels, step, m = [rank], len(COVER), len(places)
        while int(levels[-1].max()) + 1 < m and step < m:
            rank = levels[-1].astype(np.int64)
            further = np.zeros(m, np.int64)
            further[:-step] = rank[step:] + 1
            levels.append(_ranks(rank * (m + 1) + further))
            step *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        self.minima = self._sparse(self._prefixes(order, levels))

    def _prefixes(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that neighbours in the order share, by the longest sorted lengths in which they are equal."""
        a, b = order[:-1].copy(), order[1:].copy()
        total = np.zeros(len(a), np.int64)
        m = len(order)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < m) & (b < m)
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            total[same] += V << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        first, second = order[:-1], order[1:]
        p, q = (x // len(COVER) * V + COVER[x % len(COVER)] + total for x in (first, second))
        return total + self._few(p, q, np.full(len(p), V))

    def _few(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that match, at most ``most`` (V or fewer)."""
        found, last = np.zeros(len(p), np.int64), len(self.words) - 1
        alive = np.arange(len(p))
        for d in range(V):
            alive = alive[most[alive] > d]
            x, y = np.minimum(p[alive] + d, last), np.minimum(q[alive] + d, last)
            alive = alive[(self.words[x] == self.words[y]) & (x != y)]
            if not len(alive):
                break
            found[alive] += 1
        return found

    @staticmethod
    def _sparse(prefixes: np.ndarray) -> list[np.ndarray]:
        table, width = [prefixes.astype(np.int32)], 1
        while 2 * width <= len(prefixes):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def __call__(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For places p <> q the number of words that match from there on."""
        shift = _shift[p % V, q % V]
        found = self._few(p, q, shift)
        on = np.flatnonzero(found == shift)
        a, b = ((x[on] + shift[on]) for x in (p, q))
        a, b = (self.rank[x // V * len(COVER) + _slot[x % V]] for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            which = np.flatnonzero(level == k)
            row = self.minima[k]
            found[on[which]] += np.minimum(row[low[which]], row[high[which] - (1 << k)])
        return found


def grids(words: np.ndarray, reach: np.ndarray):
    """(places, periods) at which a word equals the one a period on, as do the next two places of the grid.

    ``reach[q - 1]`` is how many words from the beginning may hold a run of period q; it falls with q.
    """
    counts = np.maximum(reach - 1, 0) // np.arange(1, len(reach) + 1)
    upto = np.concatenate(([0], np.cumsum(counts)))
    begin = 0
    while begin < len(counts):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + STEP, "right")) - 1)
        many = counts[begin:end]
        q = np.repeat(np.arange(begin + 1, end + 1), many)
        at = (np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)) * q
        same = words[at] == words[at + q]
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & (q[:-2] == q[2:]))
        if len(three):
            yield at[three], q[three]
        begin = end


def runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs ``(start, length, period)`` of texts that stand behind each other, by start and period.

    ``sizes`` are the texts' words; starts count through. A run has its smallest period, at least ``PERIODS`` of it and
    ``SHORTEST`` words, and no word beside it in its text goes on with the period.
    """
    none = np.zeros((0, 3), np.int64)
    longest = int(sizes.max(initial=0)) // PERIODS
    if not longest:
        return none
    order = np.argsort(-sizes, kind="stable")  # long texts first, so that those that can hold a period come first
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    laid = np.concatenate([np.append(words[bounds[i] : bounds[i + 1]], -1 - i) for i in order.tolist()])
    ends = np.cumsum(sizes[order] + 1)
    able = np.searchsorted(-sizes[order], -PERIODS * np.arange(1, longest + 1), "right")
    found = list(grids(laid, ends[able - 1]))
    if not found:
        return none
    at, q = (np.concatenate(x) for x in zip(*found))
    text = np.searchsorted(ends, at, "right")
    inside = at + 3 * q < ends[text]
    at, q, text = at[inside], q[inside], text[inside]
    if not len(at):
        return none
    # the index holds those texts only that have such places
    chosen = np.unique(text)
    begins = ends - sizes[order] - 1
    parts = [laid[begins[t] : ends[t]] for t in chosen.tolist()]
    base = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    joined = np.concatenate(parts)
    forward, backward = Extensions(joined), Extensions(joined[::-1].copy())
    place = at - begins[text] + base[np.searchsorted(chosen, text)]
    out, last, left = [], len(joined) - 1, np.arange(len(place))
    group = np.cumsum(np.append(True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + q[1:]))) - 1
    while len(left):
        # places of a grid one after another mostly lie in one match: ask for the first, then for those behind its end
        some = left[np.unique(group[left], return_index=True)[1]] if len(out) < ROUNDS else left[:STEP]
        p, d = place[some], q[some]
        after = forward(p, p + d)
        before = np.zeros(len(p), np.int64)
        inner = np.flatnonzero(p > 0)
        before[inner] = backward(last - p[inner] + 1, last - p[inner] - d[inner] + 1)
        length = after + before + d
        fits = length >= np.maximum(PERIODS * d, SHORTEST)
        out.append(np.unique(np.stack(((p - before)[fits], length[fits], d[fits]), axis=1), axis=0))
        if len(out) <= ROUNDS:
            reach = np.zeros(group[-1] + 1, np.int64)
            reach[group[some]] = p + after
            left = left[place[left] >= reach[group[left]]]
        else:
            left = left[len(some) :]
    all_ = np.unique(np.concatenate(out), axis=0)  # by start, length and period: the first of a stretch has its smallest
    if not len(all_):
        return none
    smallest = np.append(True, (all_[1:, :2] != all_[:-1, :2]).any(axis=1))
    all_ = all_[smallest]
    which = np.searchsorted(base, all_[:, 0], "right") - 1
    own = order[chosen[which]]
    all_[:, 0] += bounds[own] - base[which]
    return all_[np.lexsort((all_[:, 2], all_[:, 0]))]


def cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all words of the texts, words of each text, and the words that the numbers stand for."""
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    strings = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    joined = b" " + b" ".join(strings) + b" "
    data = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(blank[data].astype(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    opens = np.cumsum([0] + [len(s) + 1 for s in strings])
    sizes = np.diff(np.searchsorted(starts, opens + 1))
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    held = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[~blank[data]])).dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes, held.dictionary


def strongest(found: np.ndarray) -> int:
    """Which of the runs has the most periods, exactly; of equals the first in their order."""
    best = 0
    for i, (_, length, period) in enumerate(found.tolist()):
        if length * int(found[best, 2]) > int(found[best, 1]) * period:
            best = i
    return best


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


def described(texts: pa.Array, moved=None) -> list[list]:
    """The columns of ``SCHEMA`` for texts; ``moved`` gives for each text the places that its words are taken from, or None."""
    words, sizes, known = cut_words(texts)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    if moved:
        for i, n in enumerate(sizes.tolist()):
            taken = moved(i, n)
            if taken is not None:
                words[bounds[i] : bounds[i + 1]] = words[bounds[i] + taken]
    all_ = runs(words, sizes)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, all_[:, 0] + all_[:, 2], 1)
    np.add.at(cover, all_[:, 0] + all_[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    offsets = np.searchsorted(kept, bounds)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), known.take(pa.array(words[kept])))
    collapsed = pc.binary_join(lists, " ").to_pylist()
    first = np.searchsorted(all_[:, 0], bounds)
    columns = [[] for _ in range(7)]
    for i, text in enumerate(collapsed):
        own = all_[first[i] : first[i + 1]] - np.array([bounds[i], 0, 0])
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in own.tolist())
        best = own[strongest(own)].tolist() if len(own) else [None] * 3
        milli = 1000 * best[1] // best[2] if len(own) else None
        for column, value in zip(columns, (len(own), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), text)):
            column.append(value)
    return columns


def _described(docs: DataFrame, key: str, text: str, moved, out: str, last) -> DataFrame:
    fields = f"{SCHEMA.rsplit(',', 1)[0]}, {out} string"
    names = [key, *[f.split()[0] for f in fields.split(", ")]]

    def find(batches):
        def rows():
            for b in (s for batch in batches for s in tokens.slices(batch, 1, tokens.FEW)):
                keys = b.column(0).to_pylist() if moved else None
                columns = described(b.column(1), moved and (lambda i, n: moved(keys[i], n)))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string()), pa.array(last(columns[6]), pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=names)

        yield from tokens.tidied(rows())

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(find, f"`{key}` {kind}, {fields}")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its runs, and its text without what they repeat.

    ``(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed)``: ``start`` (the number of a word),
    ``length`` and ``period`` are those of the run with the most periods (of equals the first, then the one of the
    smallest period), null if there is none; ``exponent_milli`` is its periods times 1000, rounded down. ``runs_sha256``
    is over a line ``start,length,period`` for each run. ``collapsed`` has each run's first period only, words joined by
    single spaces. Null and empty texts have no words; a key may be null or repeated, each row stands for itself.
    """
    return _described(docs, key, text, None, "collapsed", lambda texts: texts)


def planted(key: int | None, n: int) -> np.ndarray | None:
    """For a tenth of all keys the places from which words are taken, so that a text ends in a run; else None.

    A row without a key is left as it is.
    """
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``repeated_runs`` after a run was planted in a tenth of the texts, with ``collapsed_sha256`` for the text."""
    digests = lambda texts: [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    return _described(docs, key, text, planted, "collapsed_sha256", digests)
