"""Prioritized rules: tagging, classifying and painting lines."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linescope.functions.arrays import let
from linescope.functions.cells import colour
from linescope.functions.groups import Layout, Syntax, group_spans
from linescope.functions.many import FEW, matching
from linescope.functions.patterns import Pattern, matches, spans

#: Rules in one expression; more are dealt over several, as generated code is limited in size.
AT_ONCE = 40
#: Borders of spans in one group of a sweep.
BORDERS = 256
SPANS = "array<struct<start: int, len: int, rule_pos: int, fg: bigint, bg: bigint>>"


@dataclass(frozen=True)
class Rule:
    """A pattern with its place in the list (the first that matches wins) and colours as ARGB numbers, None for none."""

    rule_pos: int
    pattern: Pattern
    fg: int | None = None
    bg: int | None = None
    whole_line: bool = False


def usable_rules(rules: DataFrame) -> DataFrame:
    """Rules of (set_id, rule_pos, pattern, is_regex, ignore_case, fg, bg, whole_line, enabled) that can paint.

    Disabled rules, empty patterns and rules without a valid colour are dropped; colours become ARGB numbers.
    """
    coloured = rules.withColumns({"fg": colour(F.col("fg")), "bg": colour(F.col("bg"))})
    return coloured.where("enabled and length(pattern) > 0 and (fg is not null or bg is not null)")


def compiled(usable: DataFrame) -> tuple[list[Rule], list[str]]:
    """The rules of a (small) set in order, and the patterns that are not valid and are left out."""
    good, bad = [], []
    for r in usable.orderBy("rule_pos").collect():
        try:
            pattern = Pattern(r["pattern"], r["is_regex"], r["ignore_case"]).check()
            if has_groups(pattern) and not Layout.of(pattern.text):
                with_groups(pattern)
            good.append(Rule(r["rule_pos"], pattern, r["fg"], r["bg"], r["whole_line"]))
        except ValueError:
            bad.append(r["pattern"])
    return good, bad


def _each(rules: list[Rule], make) -> Column:
    """One array of what ``make`` gives for each rule, nulls left out, in groups of bounded size."""
    groups = [F.array_compact(F.array(*[make(r) for r in rules[at : at + AT_ONCE]])) for at in range(0, len(rules), AT_ONCE)]
    return groups[0] if len(groups) == 1 else F.flatten(F.array(*groups))


def rule_hits(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each line and rule that matches it, in one scan, however many rules there are."""
    return lines.withColumn("rule_pos", F.explode(_matched(rules)))


def classify_lines(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each line with the first rule that matches it, null if none does."""
    if len(rules) > FEW:
        return lines.withColumn("rule_pos", F.get(_matched(rules), F.lit(0)))
    first = F.coalesce(*[F.when(matches(F.col("text"), r.pattern, None), F.lit(r.rule_pos)) for r in rules])
    return lines.withColumn("rule_pos", first)


def _matched(rules: list[Rule]) -> Column:
    """``rule_pos`` of the rules that match a line, in their order."""
    places = F.array(*[F.lit(r.rule_pos) for r in rules])
    return F.transform(matching(F.col("text"), [r.pattern for r in rules]), lambda i: F.get(places, i))


def _painted_by(r: Rule) -> Column:
    text, pos = F.col("text"), F.lit(r.rule_pos)
    fg, bg = F.lit(r.fg).cast("bigint").alias("fg"), F.lit(r.bg).cast("bigint").alias("bg")
    if r.whole_line:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("len"), pos.alias("rule_pos"), fg, bg))
        return F.when(matches(text, r.pattern, None) & (F.length(text) > 0), whole)
    if has_groups(r.pattern):
        seen, layout = F.when(matches(text, r.pattern, None), text), Layout.of(r.pattern.text)
        found = group_spans(seen, r.pattern, layout) if layout else repeated_groups(r.pattern)(seen)
    else:
        found = spans(text, r.pattern)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), pos.alias("rule_pos"), fg, bg))


def has_groups(pattern: Pattern) -> bool:
    """Whether a regular expression captures."""
    return pattern.regex and Syntax(pattern.text).count > 0


def with_groups(pattern: Pattern) -> regex.Pattern:
    """A pattern with groups for the ``regex`` module, whose syntax has nearly all of Java's; ValueError if it lacks some.

    Needed only for groups inside something that repeats or looks around. Quotations, names of groups and ends of text
    are written anew; ``\\w`` knows no joiners there. Classes with others inside or with ``&&`` mean something else there
    and are refused.
    """
    if Syntax(pattern.text).sets:
        raise ValueError(f"groups that repeat are not found beside such classes: {pattern.text!r}")
    parts = []
    for i, part in enumerate(regex.split(r"\\Q(.*?)(?:\\E|$)", pattern.text, flags=regex.DOTALL)):
        if i % 2:
            parts.append(regex.escape(part))
            continue
        part = regex.sub(r"\(\?<([a-zA-Z]\w*)>", r"(?P<\1>", part)
        part = regex.sub(r"(?<!\\)((?:\\\\)*)\\k<(\w+)>", r"\1(?P=\2)", part)
        part = regex.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1(?=\\n?\\z)", part)
        parts.append(regex.sub(r"(?<!\\)((?:\\\\)*)\\z", r"\1\\Z", part))
    try:
        return regex.compile("".join(parts), regex.IGNORECASE if pattern.ignore_case else 0)
    except regex.error as error:
        raise ValueError(f"groups of this pattern cannot be found: {pattern.text!r} ({error})") from error


def repeated_groups(pattern: Pattern):
    """An Arrow UDF for patterns with groups that have no layout: spans of the groups that matched something, else of the whole match."""
    compiled = with_groups(pattern)
    source, flags = compiled.pattern, compiled.flags

    @F.pandas_udf("array<struct<start: int, len: int>>")
    def find(texts: pd.Series) -> pd.Series:
        found = regex.compile(source, flags)

        def one(text):
            out = []
            for m in found.finditer(text or ""):
                groups = [m.span(g) for g in range(1, found.groups + 1) if m.start(g) >= 0 and m.end(g) > m.start(g)]
                out += groups or ([m.span()] if m.end() > m.start() else [])
            return [{"start": s, "len": e - s} for s, e in out]

        return texts.map(one)

    return find


def raw_spans(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """``lines`` with ``raw``, the spans of all rules: whole lines, groups or matches."""
    found = F.flatten(_each(rules, _painted_by)) if rules else F.expr("array()")
    return lines.withColumn("raw", found.cast(SPANS))


def rule_spans(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each raw span."""
    return raw_spans(lines, rules).withColumn("span", F.explode("raw")).select("*", "span.*").drop("span", "raw")


def resolved(raw: Column) -> Column:
    """Overlapping spans made ascending and disjoint: for each channel the smallest ``rule_pos`` wins at each character.

    All in one row, by a sweep over the spans' borders: between two borders each channel takes the colour of the winner
    among the spans that are open, and neighbours of equal colours are joined. A colour of 0 wins like any other and then
    stands for none. An array grows by copying, so the sweep's pieces are put together in groups of ``BORDERS`` borders:
    the time stays close to linear in the number of spans.
    """

    def border(place: str):
        def make(s: Column, i: Column) -> Column:
            at, kind = (s["start"], 1) if place == "start" else (s["start"] + s["len"], 0)
            return F.struct(at.alias("at"), F.lit(kind).alias("kind"), i.alias("i"), s["rule_pos"].alias("rule_pos"), s["fg"].alias("fg"), s["bg"].alias("bg"))

        return make

    def winner(active: Column, channel: str) -> Column:
        coloured = F.filter(active, lambda x: x[channel].isNotNull())
        first = F.array_min(F.transform(coloured, lambda x: F.struct(x["rule_pos"].alias("p"), x[channel].alias("c"))))
        return F.coalesce(first["c"], F.lit(0).cast("bigint"))

    def step(acc: Column, e: Column) -> Column:
        colours = [winner(acc["active"], c).alias(c) for c in ("fg", "bg")]
        piece = F.struct(acc["at"].alias("start"), (e["at"] - acc["at"]).alias("len"), *colours)
        shown = F.filter(F.array(piece), lambda x: (x["fg"] != 0) | (x["bg"] != 0))
        out = F.when(e["at"] > acc["at"], F.concat(acc["out"], shown)).otherwise(acc["out"])
        span = F.struct(e["i"].alias("i"), e["rule_pos"].alias("rule_pos"), e["fg"].alias("fg"), e["bg"].alias("bg"))
        active = F.when(e["kind"] == 1, F.concat(acc["active"], F.array(span))).otherwise(F.filter(acc["active"], lambda x: x["i"] != e["i"]))
        return F.struct(e["at"].alias("at"), active.alias("active"), out.alias("out"))

    none = F.expr("cast(array() as array<struct<start: int, len: int, fg: bigint, bg: bigint>>)")
    idle = F.expr("cast(array() as array<struct<i: int, rule_pos: int, fg: bigint, bg: bigint>>)")

    def swept(borders: Column) -> Column:
        last = F.floor((F.size(borders) - 1) / BORDERS).cast("int")
        groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(borders, g * BORDERS + 1, F.lit(BORDERS)))
        state = lambda at, active, out: F.struct(at.alias("at"), active.alias("active"), out.alias("out"))

        def group(acc: Column, part: Column) -> Column:
            return F.aggregate(part, state(acc["at"], acc["active"], none), step, lambda x: state(x["at"], x["active"], F.concat(acc["out"], F.array(x["out"]))))

        return F.flatten(F.aggregate(groups, state(F.lit(0), idle, F.expr("cast(array() as array<array<struct<start: int, len: int, fg: bigint, bg: bigint>>>)")), group, lambda acc: acc["out"]))

    def joined(pieces: Column) -> Column:
        """Pieces that touch and have the same colours as one."""

        def opens(x: Column, i: Column) -> Column:
            before = F.get(pieces, i - 1)
            touches = (before["start"] + before["len"] == x["start"]) & (before["fg"] == x["fg"]) & (before["bg"] == x["bg"])
            return F.when(F.coalesce(touches, F.lit(False)), F.lit(None)).otherwise(i)

        def whole(firsts: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                first, last = F.get(pieces, i), F.get(pieces, F.coalesce(F.get(firsts, k + 1), F.size(pieces)) - 1)
                return F.struct(first["start"].alias("start"), (last["start"] + last["len"] - first["start"]).alias("len"), first["fg"].alias("fg"), first["bg"].alias("bg"))

            return F.transform(firsts, one)

        return let(F.array_compact(F.transform(pieces, opens)), whole)

    def coloured(s: Column) -> Column:
        fg, bg = (F.coalesce(s[c], F.lit(0).cast("bigint")).alias(c) for c in ("fg", "bg"))
        return F.struct(s["start"].alias("start"), s["len"].alias("len"), fg, bg)

    def ordered(spans_: Column) -> Column:
        """Spans in order: if none overlaps the one behind it, they are the pieces."""
        meets = F.exists(F.sequence(F.lit(1), F.size(spans_) - 1), lambda i: F.get(spans_, i - 1)["start"] + F.get(spans_, i - 1)["len"] > F.get(spans_, i)["start"])
        alone = F.filter(F.transform(spans_, coloured), lambda x: (x["len"] > 0) & ((x["fg"] != 0) | (x["bg"] != 0)))
        borders = F.array_sort(F.concat(F.transform(spans_, border("start")), F.transform(spans_, border("end"))))
        return F.when(F.size(spans_) == 1, alone).otherwise(let(F.when(meets, let(borders, swept)).otherwise(alone), joined))

    return F.when(F.size(raw) == 0, none).otherwise(let(F.array_sort(raw), ordered))


def painted_spans(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each disjoint coloured span of each line: ``start``, ``len``, ``fg``, ``bg``."""
    return _exploded(raw_spans(lines, rules))


def overlay_search(lines: DataFrame, rules: list[Rule], pattern: Pattern, bg: int) -> DataFrame:
    """``painted_spans`` under a search: within its matches the background is ``bg`` and the rules' foreground is gone."""
    first, none, colour_ = F.lit(-1).alias("rule_pos"), F.lit(0).cast("bigint").alias("fg"), F.lit(bg).cast("bigint").alias("bg")
    found = F.transform(spans(F.col("text"), pattern.check()), lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), first, none, colour_))
    rows = raw_spans(lines, rules)
    return _exploded(rows.withColumn("raw", F.concat("raw", found.cast(SPANS))))


def _exploded(rows: DataFrame) -> DataFrame:
    # no filter on the number of spans: it would be moved below them, and find them twice
    return rows.withColumn("span", F.explode(resolved(F.col("raw")))).select("*", "span.*").drop("span", "raw")


def _set(*patterns: str, ignore_case: bool = True) -> list[Rule]:
    colours = (0xFFD32F2F, 0xFFEF6C00, 0xFF2E7D32, 0xFF1565C0, 0xFF6A1B9A, 0xFF00838F, 0xFF757575)
    return [Rule(i, Pattern(p, True, ignore_case), fg=colours[i % len(colours)]) for i, p in enumerate(patterns)]


def preset_rules(name: str) -> list[Rule]:
    """The rules of a bundled set, most severe or most specific first."""
    return _set(*PRESETS[name], ignore_case=name not in ("geojson", "kml"))


#: Bundled sets. Levels and names count as whole words only.
PRESETS = {
    "levels": (r"\b(?:fatal|critical|panic)\b", r"\b(?:errors?|exception|failed|failure)\b", r"\bwarn(?:ing)?s?\b", r"\bnotice\b", r"\binfo(?:rmation)?\b", r"\bdebug\b", r"\b(?:trace|verbose)\b"),
    "syslog": (r"\b(?:emerg|alert|crit)\b", r"\b(?:err|error)\b", r"\bwarn(?:ing)?\b", r"\b[a-z][a-z0-9_.-]*\[[0-9]+\]:", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    "access": (r'" 5[0-9]{2} ', r'" 4[0-9]{2} ', r'" 3[0-9]{2} ', r'" 2[0-9]{2} ', r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    "jsonlog": (r'"level": *"(?:fatal|error)"', r'"level": *"warn(?:ing)?"', r'"level": *"info"', r'"(?:msg|message)": *"', r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"),
    "geojson": (r'"type": *"FeatureCollection"', r'"type": *"Feature"', r'"geometry":', r'"coordinates":', r'"properties":', r'"(?:Multi)?(?:Point|LineString|Polygon)"', r'"bbox":'),
    "kml": (r"<kml\b", r"<Document\b", r"<Folder\b", r"<Placemark\b", r"<name>", r"<coordinates>", r"<Style\b"),
    "nmea": (r"^\$[A-Z]{2}GGA,", r"^\$[A-Z]{2}RMC,", r"^\$[A-Z]{2}GSA,", r"^\$[A-Z]{2}GSV,", r"^\$[A-Z]{2}VTG,"),
}


#: Names of a rule's columns in JSON.
JSON_NAMES = {
    "pattern": "Pattern",
    "is_regex": "IsRegex",
    "ignore_case": "IgnoreCase",
    "fg": "Foreground",
    "bg": "Background",
    "whole_line": "WholeLine",
    "enabled": "Enabled",
}


def import_rule_sets(sets: DataFrame, known: DataFrame) -> DataFrame:
    """New rules of imported sets: ``sets`` has (pos, json), a JSON array of {Id, Name, Rules: [...]} each.

    Sets with an empty or already known ``set_id`` are skipped, the first of several with one id wins, and imported
    sets can be edited.
    """
    flags = ", ".join(f"{f}: boolean" for f in ("IsRegex", "IgnoreCase", "WholeLine", "Enabled"))
    rule = f"struct<Pattern: string, Foreground: string, Background: string, {flags}>"
    parsed = sets.select("pos", F.posexplode(F.from_json("json", f"array<struct<Id: string, Name: string, Rules: array<{rule}>>>")).alias("at", "s"))
    parsed = parsed.where("length(s.Id) > 0").join(known.select(F.col("set_id").alias("_known")), F.col("s.Id") == F.col("_known"), "left_anti")
    first = F.row_number().over(Window.partitionBy("s.Id").orderBy("pos", "at"))
    rows = parsed.withColumn("_first", first).where("_first = 1").select("s", F.posexplode_outer("s.Rules").alias("rule_pos", "r"))
    return rows.select(
        F.col("s.Id").alias("set_id"),
        F.col("s.Name").alias("set_name"),
        "rule_pos",
        *[F.col(f"r.{there}").alias(here) for here, there in JSON_NAMES.items()],
        F.lit(False).alias("read_only"),
    )


def export_rule_sets(rules: DataFrame) -> DataFrame:
    """One JSON object ``json`` per set, its rules in order."""
    item = F.struct("rule_pos", F.struct(*[F.col(here).alias(there) for here, there in JSON_NAMES.items()]).alias("r"))
    sets = rules.groupBy("set_id", "set_name").agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = F.struct(F.col("set_id").alias("Id"), F.col("set_name").alias("Name"), F.col("items.r").alias("Rules"))
    return sets.select("set_id", F.to_json(whole).alias("json"))
