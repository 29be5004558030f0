"""Many patterns at once: which of them a line has, at about the cost of reading it.

Texts that patterns consist of, or that their matches must have, go into one automaton, which passes over a batch of
lines once however many there are. Plain patterns are decided by that; other ones are tried by Java on the lines that can
have them. Patterns of which no such text is known are tried on every line.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from linescope.functions.patterns import Pattern, matches, required

#: Patterns up to which each is an expression of its own, and such expressions in one array.
FEW, AT_ONCE = 16, 40


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Characters to what Java's (?iu) compares: the lower case of their upper case, where each is one character."""
    table = np.arange(sys.maxunicode + 1, dtype="<u4")
    for code in range(sys.maxunicode + 1):
        upper = chr(code).upper()
        upper = upper if len(upper) == 1 else chr(code)
        lower = upper.lower()
        table[code] = ord("i" if code == 0x130 else lower if len(lower) == 1 else upper)
    return table


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].tobytes().decode("utf-32-le", "surrogatepass")


def _found(needles: list[tuple[int, str, bool]]):
    """An Arrow UDF: of each text the numbers of the ``(number, text, fold)`` that it has, ascending."""
    import ahocorasick

    def automaton(texts: dict[str, list[int]]):
        tree = ahocorasick.Automaton()
        for text, numbers in texts.items():
            tree.add_word(text, numbers[0])
        tree.make_automaton()
        return tree

    by_text: tuple[dict, dict] = ({}, {})
    for number, text, fold in needles:
        by_text[fold].setdefault(folded(text) if fold else text, []).append(number)
    # numbers with the same text share the automaton's first one
    also = {numbers[0]: numbers for texts in by_text for numbers in texts.values() if len(numbers) > 1}
    trees: dict[bool, object] = {}

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        if not trees:
            trees.update({bool(fold): automaton(t) for fold, t in enumerate(by_text) if t})
        lines = [t or "" for t in texts.to_pylist()]
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lines])))
        joined = "\n".join(lines)
        places, numbers = [], []
        for fold, tree in trees.items():
            for at, number in tree.iter(folded(joined) if fold else joined):
                places.append(at)
                numbers.append(number)
        number = np.array(numbers, np.int64)
        line = np.searchsorted(begins, np.array(places, np.int64), "right") - 1
        pairs = np.unique(line << 32 | number)
        if also:
            shared = [(p & ~0xFFFFFFFF) | n for p in pairs.tolist() for n in also.get(p & 0xFFFFFFFF, ())]
            pairs = np.unique(np.concatenate((pairs, np.array(shared, np.int64))))
        bounds = np.searchsorted(pairs >> 32, np.arange(len(lines) + 1))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()))

    return find


def matching(text: Column, patterns: list[Pattern]) -> Column:
    """The numbers of the patterns that a line matches, ascending, as array<int>; empty for null."""
    each = lambda some: [F.when(matches(text, patterns[i], None), F.lit(i)) for i in some]
    if len(patterns) <= FEW:
        return F.array_compact(F.array(*each(range(len(patterns))))).cast("array<int>")
    # literals of lines without a line end; one that has it never matches, as ``matches`` has it
    needles = {i: (p.text, True) if p.ignore_case and not p.regex else (required(p), False) for i, p in enumerate(patterns)}
    needles = {i: (t, fold) for i, (t, fold) in needles.items() if t and not set(t) & {"\r", "\n"}}
    others = [i for i in range(len(patterns)) if i not in needles]
    groups = [F.array_compact(F.array(*each(others[at : at + AT_ONCE]))).cast("array<int>") for at in range(0, len(others), AT_ONCE)]
    if needles:
        certain = F.array(*[F.lit(p.plain) for p in patterns])
        java = F.array(*[F.lit(p.java()) for p in patterns])
        has = _found([(i, t, fold) for i, (t, fold) in needles.items()])(text)
        groups.append(has if all(patterns[i].plain for i in needles) else F.filter(has, lambda i: F.get(certain, i) | F.rlike(text, F.get(java, i))))
    return F.array_sort(F.flatten(F.array(*groups)))
