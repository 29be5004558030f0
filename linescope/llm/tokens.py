"""Whole-corpus encoding with a ``tokenizers`` vocabulary, at the speed of its distinct pieces.

Byte-level BPE cuts a text into pieces (contractions, letters, numbers, other signs, white space) and merges within a
piece only. The cuts depend on classes of neighbouring characters, so they are found for a whole batch as vectors; Arrow
finds the distinct pieces, the library's model encodes those that the worker has not met lately, and the batch's ids are
gathered from theirs. Texts that hold an added token of the vocabulary, or characters whose class could depend on the
library's Unicode version, are left to its whole ``encode``, and so are all texts under another kind of vocabulary.
"""

from __future__ import annotations

import ctypes
import json
import unicodedata
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker remembers in each of two generations, texts' bytes that it encodes at once, and bytes that
#: other operators look at once, which hold more arrays for each byte.
REMEMBERED, AT_ONCE, FEW = 250_000, 1 << 20, 1 << 20
#: Longer pieces are not remembered.
LONGEST = 80
#: Classes of characters. Texts are put behind each other with a noncharacter between.
BETWEEN, LETTER, NUMBER, OTHER, SPACE, BLANK, ODD = range(7)
SEPARATOR = "\U0010ffff"
#: What follows an apostrophe in a contraction.
CONTRACTED = ("s", "t", "m", "d", "re", "ve", "ll")


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Classes of the Latin blocks and of general punctuation; all other characters are odd."""
    table = np.full(0x110000, ODD, np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]:
        kind = unicodedata.category(chr(c))
        table[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    table[[9, 10, 11, 12, 13, 0x85, 0xA0]] = BLANK
    table[0x1C:0x20] = ODD
    table[32], table[ord(SEPARATOR)] = SPACE, BETWEEN
    return table


def cuts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin, of code points and their classes; the last one is a separator."""
    before, after = np.roll(kinds, 1), np.roll(kinds, -1)
    blank, blank_before = (kinds == SPACE) | (kinds == BLANK), (before == SPACE) | (before == BLANK)
    # a run of blanks leaves its last one to what follows, where a space joins the piece and others stand alone
    inside = blank & blank_before & ((after == SPACE) | (after == BLANK) | (after == BETWEEN))
    joined = ~blank & (before == SPACE) & (kinds != BETWEEN)
    begins = ~(inside | joined | (~blank & (kinds == before)))
    begins |= kinds == BETWEEN
    begins[0] = True
    quotes = np.flatnonzero(begins & (points == ord("'")))
    if len(quotes):
        padded = np.concatenate((points, points[-1:], points[-1:]))
        for tail in CONTRACTED:
            at = quotes[np.logical_and.reduce([padded[quotes + 1 + i] == ord(c) for i, c in enumerate(tail)])]
            begins[at + 1] = False
            begins[at + 1 + len(tail)] = True
    return np.flatnonzero(begins)


def _byte_alphabet() -> str:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as U+0100 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


class Remembered:
    """A map that forgets what was not asked for lately: two generations of at most about ``REMEMBERED`` entries."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def many(self, keys: list[str]) -> list:
        young, old, make = self.young, self.old, self.make
        out = []
        for k in keys:
            found = young.get(k)
            if found is None:
                found = old.get(k)
                if found is None:
                    found = make(k)
                if len(k) <= LONGEST:
                    young[k] = found
            out.append(found)
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return out

    def forget(self) -> None:
        self.young, self.old = {}, {}


def by_pieces(settings: dict) -> bool:
    """Whether a tokenizer is plain byte-level BPE, for which ``cuts`` and the byte alphabet hold."""
    model, before = settings["model"], settings.get("pre_tokenizer") or {}
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    unusual = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return (
        all(before.get(k) == v for k, v in usual.items())
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in unusual)
        and not any(settings.get(k) for k in ("normalizer", "truncation", "padding"))
    )


class Encoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = by_pieces(json.loads(self.tokenizer.to_str()))
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.pieces = Remembered(self._piece)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> bytes:
        """A piece's ids as bytes, which take less than an array does."""
        if piece == SEPARATOR:
            return b""
        return array("I", [t.id for t in self.model.tokenize(charmap_decode(piece.encode(), "strict", self.alphabet)[0])]).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order as uint32, and where each text's ids begin (with the end); null texts have none."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        strings = [t or "" for t in texts.to_pylist()]
        if not self.fast:
            found = [np.array(self.whole(t), np.uint32) for t in strings]
            return np.concatenate(found), np.concatenate(([0], np.cumsum([len(f) for f in found])))
        joined = SEPARATOR.join(strings) + SEPARATOR
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = _classes()[points]
        begins = cuts(points, kinds)
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ends = np.cumsum(sizes)
        offsets = np.append((ends - sizes)[begins], ends[-1])
        known = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(joined.encode())).dictionary_encode()
        ids = self.pieces.many(known.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), np.uint32)
        where = np.cumsum(lengths) - lengths
        at = known.indices.to_numpy(zero_copy_only=False)
        n = lengths[at]
        upto = np.cumsum(n)
        out = pool[np.repeat(where[at] - (upto - n), n) + np.arange(upto[-1])]
        bounds = np.concatenate(([0], upto[kinds[begins] == BETWEEN]))
        odd = np.unique(np.searchsorted(np.flatnonzero(kinds == BETWEEN), np.flatnonzero(kinds == ODD)))
        if len(bounds) != len(strings) + 1:  # a text holds the separator
            odd = np.arange(len(strings))
        held = [i for i, t in enumerate(strings) if any(a in t for a in self.added)]
        if len(odd) or held:
            special = {*odd.tolist(), *held}
            parts = [np.array(self.whole(t), np.uint32) if i in special else out[bounds[i] : bounds[i + 1]] for i, t in enumerate(strings)]
            out = np.concatenate(parts)
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return out, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that its memory of pieces lasts over tasks."""
    return Encoder(path)


def tidied(batches, *remembered: Remembered):
    """The same batches; at their end the worker, which Spark keeps for later tasks, gives back the memory they took.

    With it goes what is ``remembered``, which the workers would else hold beside other operators' arrays.
    """
    yield from batches
    for pieces in remembered:
        pieces.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: int, at_once: int = AT_ONCE):
    """A batch in parts of about ``at_once`` bytes of the text in ``column``; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total + size > at_once and i > begin:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)
