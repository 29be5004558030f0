"""Where the groups of an expression are, found by Java's engine itself.

A replacement can put marks between what groups have captured, but not where they stand. So the expression is written
anew with what lies between its groups captured too, which changes no match: then every match is a row of captured pieces
without gaps, and lengths say where each group begins and ends. A group under a quantifier captures its last turn, which
ends where all turns end, so all turns together become a piece. Groups inside something that repeats, looks around or
gives nothing back do not line up like that: such expressions have no ``Layout``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from linescope.functions.arrays import let, sums_before
from linescope.functions.patterns import Pattern, mark_of

SPANS = "array<struct<start: int, len: int>>"


@dataclass
class Group:
    """A parenthesis with what it opens with, its alternatives, its quantifier and, if it captures, its number."""

    prefix: str
    alternatives: list
    number: int | None = None
    quantifier: str = ""
    looks: bool = False

    @property
    def once(self) -> bool:
        return self.quantifier[:1] in ("", "?")


class Syntax:
    """The parentheses of an expression. Other text is kept as it is; a number stands for a backreference."""

    def __init__(self, body: str):
        self.body, self.at, self.count = body, 0, 0
        #: Whether classes hold others or intersections, and whether white space may be left out.
        self.sets = self.comments = False
        self.alternatives = self._alternatives()
        if self.at < len(body):
            raise ValueError(f"a parenthesis too many in {body!r}")

    def _alternatives(self) -> list:
        out = [[]]
        while self.at < len(self.body) and self.body[self.at] != ")":
            if self.body[self.at] == "|":
                self.at += 1
                out.append([])
            else:
                out[-1].append(self._item())
        return out

    def _take(self, n: int) -> str:
        self.at += n
        return self.body[self.at - n : self.at]

    def _item(self):
        c = self.body[self.at]
        if c == "\\":
            return self._escape()
        if c == "[":
            return self._class()
        if c == "(":
            return self._group()
        return self._take(1)

    def _escape(self):
        rest = self.body[self.at + 1 :]
        if rest.startswith("Q"):
            end = rest.find("\\E")
            return self._take(len(rest) + 1 if end < 0 else end + 3)
        if rest[:1] in ("x", "p", "P", "N", "k") and rest[1:2] in ("{", "<"):
            end = rest.find("}" if rest[1] == "{" else ">")
            return self._take(len(rest) + 1 if end < 0 else end + 2)
        if rest[:1].isdigit() and rest[0] != "0":
            number, n = int(rest[0]), 1
            while rest[n : n + 1].isdigit() and number * 10 + int(rest[n]) <= self.count:
                number, n = number * 10 + int(rest[n]), n + 1
            self.at += n + 1
            return number
        return self._take(2)

    def _class(self) -> str:
        begin, depth = self.at, 0
        while self.at < len(self.body):
            if self.body.startswith("\\Q", self.at):
                end = self.body.find("\\E", self.at)
                self.at = len(self.body) if end < 0 else end + 2
                continue
            c = self._take(2 if self.body[self.at] == "\\" else 1)
            if c == "[":
                depth += 1
                self.sets |= depth > 1
                self.at += self.body.startswith("^", self.at)
                self.at += self.body.startswith("]", self.at)  # the first one is a member
            elif c == "]":
                depth -= 1
                if not depth:
                    break
            elif c == "&" and self.body.startswith("&", self.at):
                self.sets = True
        return self.body[begin : self.at]

    def _group(self):
        rest, number, looks = self.body[self.at + 1 :], None, False
        if not rest.startswith("?"):
            prefix = "("
        elif rest[1:2] == "<" and rest[2:3] not in ("=", "!"):
            prefix = "(" + rest[: rest.index(">") + 1]
        elif rest[1:2] in ("=", "!", "<"):
            prefix, looks = "(" + rest[: 3 if rest[1] == "<" else 2], True
        else:
            end = next((i for i, c in enumerate(rest) if c in ":>)"), len(rest) - 1)
            prefix = "(" + rest[: end + 1]
            self.comments |= "x" in prefix.split("-")[0]
            if prefix.endswith(")"):
                return Group(self._take(len(prefix)), [], looks=True)  # flags for what follows
        self.at += len(prefix)
        if prefix == "(" or (prefix.startswith("(?<") and not looks):
            self.count += 1
            number = self.count
        group = Group(prefix, self._alternatives(), number, looks=looks)
        if self._take(1) != ")":
            raise ValueError(f"a parenthesis is open in {self.body!r}")
        begin = self.at
        if self.body[self.at : self.at + 1] in ("*", "+", "?"):
            self.at += 1
        elif self.body.startswith("{", self.at):
            self.at = self.body.index("}", self.at) + 1
        if self.at > begin and self.body[self.at : self.at + 1] in ("?", "+"):
            self.at += 1
        group.quantifier = self.body[begin : self.at]
        return group


def _captures(item) -> bool:
    return isinstance(item, Group) and (item.number is not None or any(_captures(i) for a in item.alternatives for i in a))


class NoLayout(Exception):
    pass


@dataclass
class Layout:
    """An expression written anew, the groups of its pieces in order, and for each old group the pieces that it spans.

    ``last`` are groups that a quantifier repeats: each one's own number and the piece at whose end it stands.
    """

    pieces: list[int] = field(default_factory=list)
    spans: dict[int, tuple[int, int]] = field(default_factory=dict)
    last: dict[int, tuple[int, int]] = field(default_factory=dict)
    pattern: str = ""

    def __post_init__(self):
        self._out, self._n, self._new = [], 0, {}

    @classmethod
    def of(cls, body: str) -> Layout | None:
        syntax = Syntax(body)
        if syntax.comments:
            return None
        layout = cls()
        try:
            layout._write(syntax.alternatives)
        except NoLayout:
            return None
        layout.pattern = "".join(f"(?:\\{layout._new.get(t, t)})" if isinstance(t, int) else t for t in layout._out)
        return layout

    def _open(self, prefix: str = "(") -> int:
        self._n += 1
        self._out.append(prefix)
        return self._n

    def _write(self, alternatives: list) -> None:
        for i, items in enumerate(alternatives):
            self._out += ["|"] if i else []
            run = []
            for item in [*items, None]:
                flags = isinstance(item, Group) and not item.alternatives
                if item is not None and not flags and not _captures(item):
                    run.append(item)
                    continue
                if run:
                    self.pieces.append(self._open())
                    self._plain([run])
                    self._out.append(")")
                    run = []
                if flags:
                    self._out.append(item.prefix)
                elif item is not None:
                    self._group(item)

    def _plain(self, alternatives: list) -> None:
        """Alternatives as they are, nothing in them being captured anew."""
        for i, items in enumerate(alternatives):
            self._out += ["|"] if i else []
            for item in items:
                if isinstance(item, Group):
                    self._out.append(item.prefix)
                    self._plain(item.alternatives)
                    self._out += [")" if item.alternatives else "", item.quantifier]
                else:
                    self._out.append(item)

    def _group(self, item: Group) -> None:
        inner = any(_captures(i) for a in item.alternatives for i in a)
        # what gives nothing back may keep captures of an attempt that failed, also in Java's own matcher
        if item.looks or (inner and not item.once) or item.prefix == "(?>" or item.quantifier[1:].endswith("+"):
            raise NoLayout
        first = len(self.pieces)
        if item.number is None:
            self._out.append(item.prefix)
            self._write(item.alternatives)
        elif not item.once:
            self.pieces.append(self._open())
            self._new[item.number] = number = self._open(item.prefix)
            self._plain(item.alternatives)
            self._out += [")", item.quantifier]
            self.last[item.number] = (number, first)
        else:
            self._new[item.number] = number = self._open(item.prefix)
            if inner:
                self._write(item.alternatives)
            else:
                self.pieces.append(number)
                self._plain(item.alternatives)
            self.spans[item.number] = (first, len(self.pieces))
        self._out += [")", item.quantifier if item.once else ""]


def group_spans(text: Column, pattern: Pattern, layout: Layout) -> Column:
    """Spans of the groups that captured something, else of the whole match if it is not empty, match by match."""
    flags = pattern.java()[: -len(pattern.text)]
    tails = list(layout.last.items())
    fields = [f"${n}" for n in layout.pieces] + [f"${number}" for _, (number, _) in tails]
    width, own = len(fields) + 1, len(layout.pieces)

    def placed(mark: Column) -> Column:
        changed = F.concat(mark, *[x for f in fields for x in (F.lit(f), mark)])
        return let(F.split(F.regexp_replace(text, F.lit(flags + layout.pattern), changed), mark, -1), found)

    def found(parts: Column) -> Column:
        # what repeated groups captured stands twice: it takes no place
        sizes = F.transform(parts, lambda x, i: F.when(i % width > own, 0).otherwise(F.length(x)))
        return let(F.struct(sums_before(sizes).alias("starts"), F.transform(parts, F.length).alias("sizes")), spans)

    def spans(at: Column) -> Column:
        def match(i: Column) -> Column:
            place = lambda k: F.get(at["starts"], i * width + 1 + k)
            span = lambda begin, size: F.struct(begin.cast("int").alias("start"), size.cast("int").alias("len"))
            groups = [span(place(a), place(b) - place(a)) for a, b in layout.spans.values()]
            for t, (_, (_, piece)) in enumerate(tails):
                size = F.get(at["sizes"], i * width + 1 + own + t)
                groups.append(span(place(piece + 1) - size, size))
            some = F.filter(F.array(*groups), lambda s: s["len"] > 0)
            whole = F.filter(F.array(span(place(0), place(own) - place(0))), lambda s: s["len"] > 0)
            return let(some, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))

        n = F.floor(F.size(at["starts"]) / width).cast("int")
        return F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)")), match))

    return F.when(text.isNotNull(), let(mark_of(text), placed)).cast(SPANS)
