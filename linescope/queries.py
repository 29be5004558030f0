"""The registered queries over the given tables, each beside the DuckDB SQL that has the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linescope.functions.cells import display_width
from linescope.functions.patterns import Pattern
from linescope.operators import blocks, marks, position, rules, search, tokens
from linescope.operators.rules import Rule
from linescope.plans.ordered import BYTES as BYTE_RANGE
from linescope.plans.ordered import LINES as LINE_RANGE
from linescope.plans.ordered import width_for
from linescope.sources import index
from linescope.sources import lines as L
from linescope.sources.encoding import detect_newline, newline_style, profile_files
from linescope.sources.files import numbered_files
from linescope.sources.shared import fresh_folder
from linescope.streaming import segments, tables, tail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# --- shared inputs ---------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` of the documents, a document being a file."""
    return L.lines_from_column(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "path")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` of the documents: path, size, terminated, total_lines, without splitting the texts."""
    text = F.coalesce("text", F.lit(""))
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    ended = text.endswith("\n")
    total = feeds + F.when(ended | (text == ""), 0).otherwise(1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.octet_length(text).cast("long").alias("size"), ended.alias("terminated"), total.cast("long").alias("total_lines")
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rendered as a log."""
    text = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("event_type"), F.col("props"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), text.alias("text"))


def lines_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""src AS (SELECT {key} AS path, string_split(COALESCE({text}, ''), chr(10)) AS s FROM {source}),
raw AS (SELECT path, unnest(s) AS line, unnest(range(len(s))) AS line_no, len(s) AS parts FROM src),
kept AS (SELECT path, line, line_no FROM raw WHERE NOT (line_no = parts - 1 AND line = '')),
lines AS (SELECT path, line_no, CAST(COALESCE(SUM(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_off, CAST(strlen(line) AS INTEGER) AS n_bytes,
  CASE WHEN ends_with(line, chr(13)) THEN line[:-2] ELSE line END AS text FROM kept)"""


LINES = lines_sql()
FILES = """files AS (SELECT doc_id AS path, CAST(strlen(text) AS BIGINT) AS size, ends_with(text, chr(10)) AS terminated,
  COALESCE(n, 0) AS total_lines FROM documents LEFT JOIN (SELECT path AS p, COUNT(*) AS n FROM lines GROUP BY 1) ON p = doc_id)"""
HALF = "probes AS (SELECT path, CAST(floor(size / 2) AS BIGINT) AS \"offset\" FROM files)"


def register(name: str, sql: str | None = None, parts: tuple[str, ...] = (LINES,)):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return query

    return add


def half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe in the middle of each document."""
    return files(spark, sf_dir).select("path", F.floor(F.col("size") / 2).alias("offset"))


# --- lines and files -------------------------------------------------------------------------------------------------


@register("lines_documents", "SELECT * FROM lines")
def lines_documents(spark, sf_dir):
    return documents(spark, sf_dir)


@register("lines_conversations", "SELECT path.a AS conv_id, path.b AS turn, line_no, byte_off, n_bytes, text FROM lines", (lines_sql("conversations", "{'a': conv_id, 'b': turn}"),))
def lines_conversations(spark, sf_dir):
    return L.lines_from_column(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@register("lines_pages", "SELECT path AS page_id, line_no, byte_off, n_bytes, text FROM lines", (lines_sql("pages", "page_id", "html"),))
def lines_pages(spark, sf_dir):
    return L.lines_from_column(table(spark, sf_dir, "pages"), "page_id", "html")


@register(
    "newline_profile",
    """SELECT doc_id AS path, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'CrLf' WHEN contains(text, chr(10)) THEN 'Lf'
  WHEN contains(text, chr(13)) THEN 'Cr' ELSE 'Lf' END AS newline FROM documents""",
    (),
)
def newline_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), newline_style(F.col("text")).alias("newline"))


@register(
    "file_stats",
    """SELECT doc_id AS path, COUNT(line_no) AS total_lines, CAST(COALESCE(SUM(n_bytes + 1), 0) AS BIGINT) AS size, MIN(n_bytes) AS min_bytes, MAX(n_bytes) AS max_bytes
  FROM documents LEFT JOIN lines ON path = doc_id GROUP BY doc_id""",
)
def file_stats(spark, sf_dir):
    return L.file_stats(documents(spark, sf_dir), files=files(spark, sf_dir))


@register(
    "checkpoints",
    """SELECT path, line_no // 16 AS k, line_no, byte_off FROM lines WHERE line_no % 16 = 0
UNION ALL SELECT path, total_lines // 16, total_lines, size FROM files WHERE (total_lines % 16 = 0 AND terminated) OR total_lines = 0""",
    (LINES, FILES),
)
def checkpoints(spark, sf_dir):
    return L.line_checkpoints(documents(spark, sf_dir), files(spark, sf_dir), 16)


# --- positions -------------------------------------------------------------------------------------------------------

MIDDLE = "wanted AS (SELECT path, CAST(floor(total_lines / 2) AS BIGINT) AS line_no FROM files)"


def middle(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.floor(F.col("total_lines") / 2).alias("line_no"))


@register("get_lines", "SELECT path, line_no, byte_off, text FROM wanted JOIN lines USING (path, line_no)", (LINES, FILES, MIDDLE))
def get_lines(spark, sf_dir):
    return position.get_lines(documents(spark, sf_dir), middle(spark, sf_dir)).select("path", "line_no", "byte_off", "text")


@register("get_lines_missing", "SELECT doc_id AS path, CAST(20 AS BIGINT) AS line_no FROM documents WHERE doc_id NOT IN (SELECT path FROM lines WHERE line_no = 20)")
def get_lines_missing(spark, sf_dir):
    wanted = files(spark, sf_dir).select("path", F.lit(20).cast("long").alias("line_no"))
    return position.missing_lines(documents(spark, sf_dir), wanted)


@register("line_to_offset", "SELECT path, line_no, byte_off FROM wanted JOIN lines USING (path, line_no)", (LINES, FILES, MIDDLE))
def line_to_offset(spark, sf_dir):
    return position.line_to_offset(documents(spark, sf_dir), middle(spark, sf_dir))


@register(
    "offset_to_line",
    "SELECT p.path, p.probe, l.line_no FROM probes p ASOF JOIN lines l ON p.path = l.path AND p.probe >= l.byte_off",
    (LINES, FILES, "probes AS (SELECT path, unnest([CAST(floor(size / 3) AS BIGINT), CAST(floor(size / 2) AS BIGINT), size + 10]) AS probe FROM files)"),
)
def offset_to_line(spark, sf_dir):
    size = F.col("size")
    probes = files(spark, sf_dir).select("path", F.explode(F.array(F.floor(size / 3), F.floor(size / 2), size + 10)).alias("offset"))
    return position.offset_to_line(documents(spark, sf_dir), probes, width_of(spark, sf_dir, BYTE_RANGE))


@register(
    "page_at",
    """SELECT path, line_no, byte_off, text FROM (SELECT l.*, row_number() OVER (PARTITION BY l.path ORDER BY byte_off) AS turn
  FROM lines l JOIN probes p ON l.path = p.path AND byte_off >= "offset") WHERE turn <= 5""",
    (LINES, FILES, HALF),
)
def page_at(spark, sf_dir):
    return position.page_at(documents(spark, sf_dir), half(spark, sf_dir), 5).select("path", "line_no", "byte_off", "text")


@register(
    "jump_percent",
    """SELECT path, line_no, byte_off FROM (SELECT l.*, row_number() OVER (PARTITION BY l.path ORDER BY byte_off) AS turn
  FROM lines l JOIN (SELECT path, size, (SELECT MAX(byte_off) FROM lines x WHERE x.path = files.path) AS last FROM files) f
  ON l.path = f.path AND byte_off >= least(CAST(floor(size * 0.75::DOUBLE) AS BIGINT), last)) WHERE turn <= 3""",
    (LINES, FILES),
)
def jump_percent(spark, sf_dir):
    return position.jump_percent(documents(spark, sf_dir), files(spark, sf_dir), F.lit(0.75), 3).select("path", "line_no", "byte_off")


@register(
    "centered_window",
    """SELECT w.path, w.line_no AS target, l.line_no, l.text FROM wanted w JOIN lines l ON l.path = w.path
  AND l.line_no BETWEEN greatest(w.line_no - 3, 0) AND greatest(w.line_no - 3, 0) + 6""",
    (LINES, FILES, MIDDLE),
)
def centered_window(spark, sf_dir):
    targets = middle(spark, sf_dir).withColumnRenamed("line_no", "target")
    return position.centered_window(documents(spark, sf_dir), targets, 7).select("path", "target", "line_no", "text")


@register("last_lines", "SELECT path, line_no, text FROM lines QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 3")
def last_lines(spark, sf_dir):
    return position.last_lines(documents(spark, sf_dir), 3).select("path", "line_no", "text")


@register(
    "adjacent_lines",
    """SELECT path, line_no, byte_off, COALESCE(lead(byte_off) OVER w, byte_off + n_bytes + 1) AS next_off,
  COALESCE(lag(byte_off) OVER w, byte_off) AS prev_off FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no)""",
)
def adjacent_lines(spark, sf_dir):
    return position.adjacent_lines(documents(spark, sf_dir)).select("path", "line_no", "byte_off", "next_off", "prev_off")


@register(
    "line_range",
    """SELECT path, line_no, text, COUNT(*) OVER (PARTITION BY path) AS rows, COUNT(*) OVER (PARTITION BY path) > 4 AS too_many
  FROM lines WHERE line_no BETWEEN 2 AND 6""",
)
def line_range(spark, sf_dir):
    ranges = files(spark, sf_dir).select("path", F.lit(2).alias("top"), F.lit(6).alias("bottom"))
    return position.line_range(documents(spark, sf_dir), ranges, copy_cap=4).select("path", "line_no", "text", "rows", "too_many")


@register("clamp_text", "SELECT path, line_no, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS shown, length(text) > 40 AS is_clamped FROM lines")
def clamp_text(spark, sf_dir):
    return position.clamp_text(documents(spark, sf_dir), max_chars=40).select("path", "line_no", "shown", "is_clamped")


@register("sample_lines", "SELECT * FROM lines ORDER BY md5(concat_ws(':', path, line_no, '42')), path, line_no LIMIT 1000")
def sample_lines(spark, sf_dir):
    return position.sample_lines(documents(spark, sf_dir))


# --- search ----------------------------------------------------------------------------------------------------------

THE = Pattern("the")
LICENSE = Pattern("LICENSE", ignore_case=True)
HITS_THE = "hits AS (SELECT * FROM lines WHERE contains(text, 'the'))"
HITS_LICENSE = "hits AS (SELECT * FROM lines WHERE regexp_matches(text, 'license', 'i'))"
FILTERS = {"the": THE, "license": LICENSE, "key": Pattern("token = "), "opening": Pattern("^[A-Z][a-z]+ [a-z]+tion", regex=True)}
MANY = """many AS (SELECT path, line_no, 'the' AS filter_name FROM lines WHERE contains(text, 'the')
UNION ALL SELECT path, line_no, 'license' FROM lines WHERE regexp_matches(text, 'license', 'i')
UNION ALL SELECT path, line_no, 'key' FROM lines WHERE contains(text, 'token = ')
UNION ALL SELECT path, line_no, 'opening' FROM lines WHERE regexp_matches(text, '^[A-Z][a-z]+ [a-z]+tion'))"""


def _found(name: str, pattern: Pattern, predicate: str) -> None:
    @register(name, f"SELECT path, line_no, byte_off FROM lines WHERE {predicate}")
    def query(spark, sf_dir):
        return search.search(documents(spark, sf_dir), pattern).select("path", "line_no", "byte_off")


_found("search_literal", THE, "contains(text, 'the')")
_found("search_literal_ci", LICENSE, "regexp_matches(text, 'license', 'i')")
_found("search_regex", FILTERS["opening"], "regexp_matches(text, '^[A-Z][a-z]+ [a-z]+tion')")
_found("search_regex_ci", Pattern("(license|token) ", regex=True, ignore_case=True), "regexp_matches(text, '(license|token) ', 'i')")


@register("search_capped", "SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY byte_off) AS hit_no FROM hits QUALIFY hit_no <= 3", (LINES, HITS_THE))
def search_capped(spark, sf_dir):
    return search.cap_hits(search.search(documents(spark, sf_dir), THE), 3).select("path", "line_no", "hit_no")


@register(
    "search_summary",
    """SELECT path, least(n, 5) AS total_hits, n >= 5 AS truncated, n / lines AS hit_ratio FROM
  (SELECT doc_id AS path, CAST(SUM(CASE WHEN contains(l.text, 'the') THEN 1 ELSE 0 END) AS BIGINT) AS n, NULLIF(COUNT(line_no), 0) AS lines FROM documents LEFT JOIN lines l ON path = doc_id GROUP BY doc_id)""",
)
def search_summary(spark, sf_dir):
    return search.search_summary(documents(spark, sf_dir), THE, 5, files(spark, sf_dir))


@register("search_many", "SELECT * FROM many", (LINES, MANY))
def search_many(spark, sf_dir):
    return search.search_many(documents(spark, sf_dir), FILTERS).select("path", "line_no", "filter_name")


#: A filter for each two letters and a third one, all looked for at once.
HUNDREDS = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "lnrs"]


@register("search_hundreds", f"SELECT filter_name, path, line_no FROM lines JOIN (SELECT unnest([{', '.join(repr(h) for h in HUNDREDS)}]) AS filter_name) ON contains(text, filter_name)")
def search_hundreds(spark, sf_dir):
    return search.search_many(documents(spark, sf_dir), {h: Pattern(h) for h in HUNDREDS}).select("filter_name", "path", "line_no")


@register("filter_counts", "SELECT filter_name, COUNT(*) AS n FROM many GROUP BY 1", (LINES, MANY))
def filter_counts(spark, sf_dir):
    return search_many(spark, sf_dir).groupBy("filter_name").agg(F.count("*").alias("n"))


@register(
    "match_segments",
    """SELECT path, line_no, CAST(row_number() OVER (PARTITION BY path, line_no ORDER BY place) - 1 AS INTEGER) AS seg_no, segment, is_match FROM (
  SELECT path, line_no, 2 * i AS place, g AS segment, false AS is_match FROM parts UNION ALL
  SELECT path, line_no, 2 * i + 1, 'tion', true FROM parts WHERE i < n - 1) WHERE segment <> ''""",
    (LINES, "cut AS (SELECT path, line_no, string_split(text, 'tion') AS gs FROM lines WHERE contains(text, 'tion'))", "parts AS (SELECT path, line_no, unnest(gs) AS g, unnest(range(len(gs))) AS i, len(gs) AS n FROM cut)"),
)
def match_segments(spark, sf_dir):
    return search.match_segments(documents(spark, sf_dir), Pattern("tion")).select("path", "line_no", "seg_no", "segment", "is_match")


@register("next_hit", 'SELECT p.path, p."offset", (SELECT MIN(byte_off) FROM hits h WHERE h.path = p.path AND h.byte_off > p."offset") AS next_off FROM probes p', (LINES, FILES, HALF, HITS_THE))
def next_hit(spark, sf_dir):
    return search.next_mark(search.search(documents(spark, sf_dir), THE), half(spark, sf_dir))


@register("prev_hit", 'SELECT p.path, p."offset", (SELECT MAX(byte_off) FROM hits h WHERE h.path = p.path AND h.byte_off < p."offset") AS prev_off FROM probes p', (LINES, FILES, HALF, HITS_THE))
def prev_hit(spark, sf_dir):
    return search.prev_mark(search.search(documents(spark, sf_dir), THE), half(spark, sf_dir))


@register(
    "hit_rank",
    """SELECT p.path, p."offset", least(CAST(SUM(CASE WHEN h.byte_off < p."offset" THEN 1 ELSE 0 END) AS BIGINT), COUNT(*) - 1) AS hit_index
  FROM probes p JOIN hits h ON h.path = p.path GROUP BY 1, 2""",
    (LINES, FILES, HALF, HITS_THE),
)
def hit_rank(spark, sf_dir):
    return search.hit_rank(search.search(documents(spark, sf_dir), THE), half(spark, sf_dir))


@register("hit_ordinals", "SELECT path, byte_off, row_number() OVER (PARTITION BY path ORDER BY byte_off) AS hit_no FROM hits", (LINES, HITS_THE))
def hit_ordinals(spark, sf_dir):
    return search.ordinals(search.search(documents(spark, sf_dir), THE)).select("path", "byte_off", "hit_no")


def spans_sql(pattern: str, where: str = "true") -> tuple[str, str]:
    """CTEs with ``spans`` (path, line_no, start, len, matched) of a pattern."""
    cut = f"""found AS (SELECT path, line_no, text, regexp_extract_all(text, '{pattern}') AS hs, regexp_split_to_array(text, '{pattern}') AS gs
  FROM lines WHERE regexp_matches(text, '{pattern}') AND {where})"""
    each = "each AS (SELECT path, line_no, unnest(hs) AS matched, unnest(gs[1:len(hs)]) AS gap, unnest(range(len(hs))) AS i FROM found)"
    spans = """spans AS (SELECT path, line_no, i, CAST(SUM(length(gap) + length(matched)) OVER (PARTITION BY path, line_no ORDER BY i) - length(matched) AS INTEGER) AS start,
  CAST(length(matched) AS INTEGER) AS len, matched FROM each)"""
    return cut, f"{each}, {spans}"


@register("match_spans", "SELECT path, line_no, start, len, matched FROM spans", (LINES, *spans_sql("[a-z]+tion")))
def match_spans(spark, sf_dir):
    return search.match_spans(documents(spark, sf_dir), Pattern("[a-z]+tion", regex=True)).select("path", "line_no", "start", "len", "matched")


def width_of(spark: SparkSession, sf_dir: str, width: int) -> int | None:
    """Ranges for windows along the documents, if the largest one is large enough to need them."""
    return width_for(table(spark, sf_dir, "documents"), F.octet_length("text"), width)


# --- blocks ----------------------------------------------------------------------------------------------------------

EITHER = Pattern("the|license", regex=True, ignore_case=True)
HITS_EITHER = "hits AS (SELECT * FROM lines WHERE regexp_matches(text, 'the|license', 'i'))"


def blocks_sql(n: int) -> str:
    return f"""ranged AS (SELECT h.path, line_no, greatest(line_no - {n}, 0) AS s, least(line_no + {n}, total_lines - 1) AS e FROM hits h JOIN files f ON f.path = h.path),
opened AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY path ORDER BY line_no) + 1 THEN 0 ELSE 1 END AS opens FROM ranged),
numbered AS (SELECT *, CAST(SUM(opens) OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) - 1 AS block_id FROM opened),
blocks AS (SELECT path, block_id, MIN(s) AS start_line, MAX(e) AS end_line, MAX(e) - MIN(s) + 1 AS line_count, COUNT(*) AS n_hits,
  list(line_no ORDER BY line_no) AS hit_list FROM numbered GROUP BY 1, 2)"""


def _register_blocks(n: int) -> None:
    @register(f"context_blocks_n{n}", "SELECT path, block_id, start_line, end_line, line_count, n_hits, array_to_string(hit_list, ',') AS hit_lines FROM blocks", (LINES, FILES, HITS_EITHER, blocks_sql(n)))
    def query(spark, sf_dir):
        hits = search.search(documents(spark, sf_dir), EITHER)
        found = blocks.context_blocks(hits, files(spark, sf_dir), n, width_of(spark, sf_dir, LINE_RANGE), hit_list=True)
        return found.withColumn("hit_lines", F.array_join(F.transform("hit_lines", lambda x: x.cast("string")), ","))


for _n in (0, 1, 5):
    _register_blocks(_n)

ROWS = """placed AS (SELECT *, COALESCE(SUM(line_count + 1) OVER (PARTITION BY path ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row0,
  lead(block_id) OVER (PARTITION BY path ORDER BY block_id) IS NULL AS final FROM blocks),
hit_numbers AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS hit_no FROM hits),
result_rows AS (SELECT p.path, CAST(row0 + l.line_no - start_line AS BIGINT) AS row_no, CASE WHEN h.hit_no IS NULL THEN 'context' ELSE 'hit' END AS kind, l.line_no, h.hit_no, l.text
  FROM placed p JOIN lines l ON l.path = p.path AND l.line_no BETWEEN start_line AND end_line LEFT JOIN hit_numbers h ON h.path = l.path AND h.line_no = l.line_no
  UNION ALL SELECT path, CAST(row0 + line_count AS BIGINT), 'separator', NULL, NULL, NULL FROM placed WHERE NOT final)"""
LICENSE_ROWS = (LINES, FILES, HITS_LICENSE, blocks_sql(1), ROWS)


@register("block_hits", "SELECT path, block_id, line_no FROM numbered", (LINES, FILES, HITS_EITHER, blocks_sql(2)))
def block_hits(spark, sf_dir):
    return blocks.block_hits(search.search(documents(spark, sf_dir), EITHER), files(spark, sf_dir), 2, width_of(spark, sf_dir, LINE_RANGE)).select("path", "block_id", "line_no")


@register("block_rows", "SELECT * FROM result_rows", LICENSE_ROWS)
def block_rows(spark, sf_dir):
    lines = documents(spark, sf_dir)
    hits, width = search.search(lines, LICENSE), width_of(spark, sf_dir, LINE_RANGE)
    return blocks.block_rows(blocks.context_blocks(hits, files(spark, sf_dir), 1, width), lines, hits, width)


@register("hit_rows", "SELECT path, row_number() OVER w - 1 AS row_no, 'hit' AS kind, line_no, row_number() OVER w AS hit_no, text FROM hits WINDOW w AS (PARTITION BY path ORDER BY line_no)", (LINES, HITS_LICENSE))
def hit_rows(spark, sf_dir):
    return blocks.hit_rows(search.search(documents(spark, sf_dir), LICENSE), width_of(spark, sf_dir, LINE_RANGE))


@register("select_rows", "SELECT * FROM result_rows r WHERE row_no IN (SELECT unnest([MIN(row_no), MAX(row_no)]) FROM result_rows x WHERE x.path = r.path)", LICENSE_ROWS)
def select_rows(spark, sf_dir):
    shown = block_rows(spark, sf_dir)
    ends = shown.groupBy("path").agg(F.min("row_no").alias("a"), F.max("row_no").alias("b"))
    return blocks.select_rows(shown, ends.select("path", F.explode(F.array("a", "b")).alias("row_no")))


@register(
    "export_lines",
    "SELECT path, row_no, CASE WHEN kind = 'separator' THEN '⋯' ELSE format('{:,}', line_no + 1) || chr(9) || text END AS out FROM result_rows",
    LICENSE_ROWS,
)
def export_lines(spark, sf_dir):
    return L.rendered(block_rows(spark, sf_dir)).select("path", "row_no", "out")


# --- rules -----------------------------------------------------------------------------------------------------------

RULES = [
    Rule(0, Pattern("token = "), fg=0xFFFF0000, bg=0xFFFFFF00, whole_line=True),
    Rule(1, LICENSE, fg=0xFF00FF00),
    Rule(2, Pattern("ation"), bg=0xFF0000FF),
    Rule(3, Pattern("tion"), fg=0xFF123456, bg=0xFF654321),
]
RULE_HITS = """rule_hits AS (SELECT path, line_no, 0 AS rule_pos FROM lines WHERE contains(text, 'token = ')
UNION ALL SELECT path, line_no, 1 FROM lines WHERE regexp_matches(text, 'license', 'i')
UNION ALL SELECT path, line_no, 2 FROM lines WHERE contains(text, 'ation')
UNION ALL SELECT path, line_no, 3 FROM lines WHERE contains(text, 'tion'))"""
CLASSES = "classes AS (SELECT l.path, l.line_no, MIN(rule_pos) AS rule_pos FROM lines l LEFT JOIN rule_hits r ON r.path = l.path AND r.line_no = l.line_no GROUP BY 1, 2)"


def one_rule_sql(pos: int, pattern: str, fg: int | None, bg: int | None) -> str:
    return f"""r{pos}g AS (SELECT path, line_no, regexp_extract_all(text, '{pattern}') AS hs, regexp_split_to_array(text, '{pattern}') AS gs FROM lines WHERE regexp_matches(text, '{pattern}')),
r{pos}e AS (SELECT path, line_no, unnest(hs) AS m, unnest(gs[1:len(hs)]) AS gap, unnest(range(len(hs))) AS i FROM r{pos}g),
r{pos} AS (SELECT path, line_no, CAST(SUM(length(gap) + length(m)) OVER (PARTITION BY path, line_no ORDER BY i) - length(m) AS INTEGER) AS start,
  CAST(length(m) AS INTEGER) AS len, {pos} AS rule_pos, {'NULL' if fg is None else fg}::BIGINT AS fg, {'NULL' if bg is None else bg}::BIGINT AS bg FROM r{pos}e)"""


RAW_SPANS = (
    one_rule_sql(1, "(?i)license", 0xFF00FF00, None),
    one_rule_sql(2, "ation", None, 0xFF0000FF),
    one_rule_sql(3, "tion", 0xFF123456, 0xFF654321),
    f"""raw_spans AS (SELECT path, line_no, 0 AS start, CAST(length(text) AS INTEGER) AS len, 0 AS rule_pos, {0xFFFF0000}::BIGINT AS fg, {0xFFFFFF00}::BIGINT AS bg
  FROM lines WHERE contains(text, 'token = ') UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)""",
)
PAINTED = """borders AS (SELECT path, line_no, start AS b FROM raw_spans UNION SELECT path, line_no, start + len FROM raw_spans),
pieces AS (SELECT path, line_no, b AS a, lead(b) OVER (PARTITION BY path, line_no ORDER BY b) AS z FROM borders),
painted AS (SELECT p.path, p.line_no, a, z, COALESCE(arg_min(fg, rule_pos) FILTER (fg IS NOT NULL), 0) AS fg, COALESCE(arg_min(bg, rule_pos) FILTER (bg IS NOT NULL), 0) AS bg
  FROM pieces p JOIN raw_spans s ON s.path = p.path AND s.line_no = p.line_no AND s.start <= a AND a < s.start + s.len WHERE z IS NOT NULL GROUP BY 1, 2, 3, 4),
opened AS (SELECT *, CASE WHEN lag(z) OVER w = a AND lag(fg) OVER w = fg AND lag(bg) OVER w = bg THEN 0 ELSE 1 END AS opens FROM painted WINDOW w AS (PARTITION BY path, line_no ORDER BY a)),
runs AS (SELECT *, SUM(opens) OVER (PARTITION BY path, line_no ORDER BY a) AS run FROM opened)"""


@register(
    "usable_rules",
    """SELECT set_id, rule_pos, pattern, fg, bg FROM (SELECT p_brand AS set_id, p_partkey AS rule_pos, CASE WHEN p_size > 45 THEN '' ELSE p_name END AS pattern,
  CASE p_size % 3 WHEN 1 THEN CAST('0xFF' || format('{:06X}', p_size * 5000) AS BIGINT) END AS fg, CASE WHEN p_size % 2 = 0 THEN CAST('0x80' || format('{:06X}', p_size) AS BIGINT) END AS bg
  FROM part WHERE p_retailprice > 950) WHERE length(pattern) > 0 AND (fg IS NOT NULL OR bg IS NOT NULL)""",
    (),
)
def usable_rules(spark, sf_dir):
    size = F.col("p_size")
    own = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("set_id"),
        F.col("p_partkey").alias("rule_pos"),
        F.when(size > 45, "").otherwise(F.col("p_name")).alias("pattern"),
        F.when(size % 3 == 1, F.concat(F.lit("#"), F.lpad(F.hex(size * 5000), 6, "0"))).when(size % 3 == 2, F.col("p_type")).alias("fg"),
        F.when(size % 2 == 0, F.concat(F.lit("80"), F.lpad(F.hex(size), 6, "0"))).alias("bg"),
        (F.col("p_retailprice") > 950).alias("enabled"),
    )
    return rules.usable_rules(own).drop("enabled")


@register("rule_hits", "SELECT * FROM rule_hits", (LINES, RULE_HITS))
def rule_hits(spark, sf_dir):
    return rules.rule_hits(documents(spark, sf_dir), RULES).select("path", "line_no", "rule_pos")


@register("rule_counts", "SELECT rule_pos, COUNT(*) AS n FROM rule_hits GROUP BY 1", (LINES, RULE_HITS))
def rule_counts(spark, sf_dir):
    return rule_hits(spark, sf_dir).groupBy("rule_pos").agg(F.count("*").alias("n"))


@register("classify_lines", "SELECT * FROM classes", (LINES, RULE_HITS, CLASSES))
def classify_lines(spark, sf_dir):
    return rules.classify_lines(documents(spark, sf_dir), RULES).select("path", "line_no", "rule_pos")


@register("class_counts", "SELECT quality, rule_pos, COUNT(*) AS n FROM classes JOIN labels ON doc_id = path GROUP BY 1, 2", (LINES, RULE_HITS, CLASSES))
def class_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "quality")
    return classify_lines(spark, sf_dir).join(labels, "path").groupBy("quality", "rule_pos").agg(F.count("*").alias("n"))


@register("rule_spans", "SELECT path, line_no, start, len, rule_pos, fg, bg FROM raw_spans", (LINES, *RAW_SPANS))
def rule_spans(spark, sf_dir):
    return rules.rule_spans(documents(spark, sf_dir), RULES).select("path", "line_no", "start", "len", "rule_pos", "fg", "bg")


@register("painted_spans", "SELECT path, line_no, MIN(a) AS start, CAST(MAX(z) - MIN(a) AS INTEGER) AS len, fg, bg FROM runs GROUP BY path, line_no, run, fg, bg", (LINES, *RAW_SPANS, PAINTED))
def painted_spans(spark, sf_dir):
    return rules.painted_spans(documents(spark, sf_dir), RULES).select("path", "line_no", "start", "len", "fg", "bg")


OVERLAID = (
    one_rule_sql(9, "on", 0, 0xFFABCDEF),
    "all_spans AS (SELECT * FROM raw_spans UNION ALL SELECT path, line_no, start, len, -1, fg, bg FROM r9)",
    PAINTED.replace("raw_spans", "all_spans"),
)


@register("overlay_search", "SELECT path, line_no, MIN(a) AS start, CAST(MAX(z) - MIN(a) AS INTEGER) AS len, fg, bg FROM runs GROUP BY path, line_no, run, fg, bg", (LINES, *RAW_SPANS, *OVERLAID))
def overlay_search(spark, sf_dir):
    return rules.overlay_search(documents(spark, sf_dir), RULES, Pattern("on"), 0xFFABCDEF).select("path", "line_no", "start", "len", "fg", "bg")


def matches_sql(name: str, pattern: str) -> str:
    """CTEs with ``name`` (path, line_no, start, m) of the matches of a pattern."""
    return f"""{name}g AS (SELECT path, line_no, regexp_extract_all(text, '{pattern}') AS hs, regexp_split_to_array(text, '{pattern}') AS gs FROM lines WHERE regexp_matches(text, '{pattern}')),
{name}e AS (SELECT path, line_no, unnest(hs) AS m, unnest(gs[1:len(hs)]) AS gap, unnest(range(len(hs))) AS i FROM {name}g),
{name} AS (SELECT path, line_no, CAST(SUM(length(gap) + length(m)) OVER (PARTITION BY path, line_no ORDER BY i) - length(m) AS INTEGER) AS start, m FROM {name}e)"""


@register(
    "capture_spans",
    f"""SELECT path, line_no, start, 5 AS len, 0 AS rule_pos, {0xFFFF0000}::BIGINT AS fg, NULL::BIGINT AS bg FROM keys
UNION ALL SELECT path, line_no, start + 9, CAST(length(m) - 10 AS INTEGER), 0, {0xFFFF0000}, NULL FROM keys
UNION ALL SELECT path, line_no, start, CAST(length(a) AS INTEGER), 1, NULL, {0xFF00FF00} FROM halves
UNION ALL SELECT path, line_no, CAST(start + length(a) + 1 AS INTEGER), CAST(length(b) AS INTEGER), 1, NULL, {0xFF00FF00} FROM halves""",
    (
        LINES,
        matches_sql("keys", 'token = "[0-9a-f]+"'),
        matches_sql("quads", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
        r"halves AS (SELECT *, split_part(m, '.', 1) AS a, split_part(m, '.', 2) AS b FROM quads)",
    ),
)
def capture_spans(spark, sf_dir):
    own = [Rule(0, Pattern(r'(token) = "([0-9a-f]+)"', regex=True), fg=0xFFFF0000), Rule(1, Pattern(r"(\d+)\.(\d+)\.\d+\.\d+", regex=True), bg=0xFF00FF00)]
    return rules.rule_spans(documents(spark, sf_dir), own).select("path", "line_no", "start", "len", "rule_pos", "fg", "bg")


def presets_sql(name: str, text: str, source: str) -> str:
    flag = "" if name in ("geojson", "kml") else ", 'i'"
    whens = " ".join(f"WHEN regexp_matches({text}, '{p}'{flag}) THEN {i}" for i, p in enumerate(rules.PRESETS[name]))
    return f"SELECT '{name}' AS preset, rule_pos, COUNT(*) AS n FROM (SELECT CASE {whens} END AS rule_pos FROM {source}) GROUP BY 1, 2"


LOG = "log AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' ' || props AS text FROM events)"


@register(
    "preset_counts",
    " UNION ALL ".join([presets_sql("levels", "text", "log"), presets_sql("syslog", "text", "log"), presets_sql("jsonlog", "text", "log"), presets_sql("access", "text", "log"), presets_sql("nmea", "text", "log"), presets_sql("geojson", "html", "pages"), presets_sql("kml", "html", "pages")]),
    (LOG,),
)
def preset_counts(spark, sf_dir):
    log, pages, out = log_lines(spark, sf_dir), table(spark, sf_dir, "pages").select(F.col("html").alias("text")), None
    for name in rules.PRESETS:
        tagged = rules.classify_lines(pages if name in ("geojson", "kml") else log, rules.preset_rules(name))
        counts = tagged.groupBy(F.lit(name).alias("preset"), "rule_pos").agg(F.count("*").alias("n"))
        out = counts if out is None else out.union(counts)
    return out


@register(
    "import_sets",
    """SELECT set_id, p_brand AS set_name, CAST(row_number() OVER (PARTITION BY set_id ORDER BY p_partkey) - 1 AS INTEGER) AS rule_pos, p_name AS pattern, p_size > 25 AS is_regex,
  true AS ignore_case, '#FF0000' AS fg, NULL::VARCHAR AS bg, false AS whole_line, p_size % 2 = 0 AS enabled, false AS read_only
  FROM (SELECT *, p_brand || '/' || (p_partkey // 100) AS set_id FROM part) WHERE p_brand NOT LIKE '%1'""",
    (),
)
def import_sets(spark, sf_dir):
    """Rule sets of a hundred parts by brand, exported to JSON and imported again where some are known already."""
    part, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    own = part.select(
        F.concat("p_brand", F.lit("/"), F.floor(key / 100).cast("string")).alias("set_id"), F.col("p_brand").alias("set_name"), key.alias("rule_pos"), F.col("p_name").alias("pattern"),
        (size > 25).alias("is_regex"), F.lit(True).alias("ignore_case"), F.lit("#FF0000").alias("fg"), none.alias("bg"), F.lit(False).alias("whole_line"), (size % 2 == 0).alias("enabled"),
    )
    sets = rules.export_rule_sets(own).select(F.lit(0).alias("pos"), F.concat(F.lit("["), F.col("json"), F.lit("]")).alias("json"))
    return rules.import_rule_sets(sets, own.where("set_name like '%1'").select("set_id").distinct())


# --- marks and histories ---------------------------------------------------------------------------------------------


@register("hit_histogram", "SELECT h.path, least(greatest(CAST(floor(byte_off * 20 / size) AS BIGINT), 0), 20) AS y, COUNT(*) AS n FROM hits h JOIN files f ON f.path = h.path GROUP BY 1, 2", (LINES, FILES, HITS_THE))
def hit_histogram(spark, sf_dir):
    return marks.hit_histogram(search.search(documents(spark, sf_dir), THE), files(spark, sf_dir), 20)


@register("mark_positions", "SELECT h.path, byte_off, CAST(floor(byte_off / size * 1000) AS BIGINT) AS place FROM hits h JOIN files f ON f.path = h.path", (LINES, FILES, HITS_LICENSE))
def mark_positions(spark, sf_dir):
    placed = marks.mark_positions(search.search(documents(spark, sf_dir), LICENSE), files(spark, sf_dir))
    return placed.select("path", "byte_off", F.floor(F.col("share") * 1000).alias("place"))


@register("toggle_fold", "SELECT user_id, event_type, MAX(ts) AS last FROM events GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1", ())
def toggle_fold(spark, sf_dir):
    return marks.toggle_fold(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@register("next_mark", 'SELECT p.path, p."offset", (SELECT MIN(byte_off) FROM hits h WHERE h.path = p.path AND h.byte_off > p."offset") AS next_off FROM probes p', (LINES, FILES, HALF, HITS_LICENSE))
def next_mark(spark, sf_dir):
    return search.next_mark(search.search(documents(spark, sf_dir), LICENSE), half(spark, sf_dir))


LAST_EDITS = """last AS (SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS turn FROM events)
  WHERE turn = 1 AND event_type <> 'error')"""
FIRST_PUTS = """gone AS (SELECT user_id, MAX({'t': ts, 'e': event_id}) FILTER (event_type = 'error') AS g FROM events GROUP BY 1),
firsts AS (SELECT user_id, MIN({'t': ts, 'e': event_id}) AS put FROM events JOIN gone USING (user_id)
  WHERE event_type <> 'error' AND (g IS NULL OR {'t': ts, 'e': event_id} > g) GROUP BY 1)"""


def edits(spark, sf_dir) -> DataFrame:
    """Events as edits of their user's row: an error deletes it."""
    return table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))


@register("replay_edits", "SELECT *, row_number() OVER (ORDER BY ts, event_id) AS place FROM last", (LAST_EDITS,))
def replay_edits(spark, sf_dir):
    return marks.replay_edits(edits(spark, sf_dir), "user_id", "event_type", "ts", "event_id")


@register("replay_edits_first", "SELECT last.*, row_number() OVER (ORDER BY put) AS place FROM last JOIN firsts USING (user_id)", (LAST_EDITS, FIRST_PUTS))
def replay_edits_first(spark, sf_dir):
    return marks.replay_edits(edits(spark, sf_dir), "user_id", "event_type", "ts", "event_id", first=True)


@register(
    "mru_topk",
    """SELECT user_id, event_type, last, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS place
  FROM (SELECT user_id, event_type, MAX(ts) AS last FROM events GROUP BY 1, 2)) WHERE place <= 3""",
    (),
)
def mru_topk(spark, sf_dir):
    return marks.mru(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", 3)


@register(
    "latest_state",
    """SELECT s.path, s.size, s.mtime, s.props FROM (SELECT user_id AS path, CAST(floor(value) AS BIGINT) AS size, ts AS mtime, props, event_id AS saved FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) s JOIN (SELECT user_id AS path, CAST(floor(value) AS BIGINT) AS size, ts AS mtime FROM events
  WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) f ON f.path = s.path AND f.size = s.size AND f.mtime = s.mtime
  ORDER BY saved DESC, s.path LIMIT 500""",
    (),
)
def latest_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.floor("value").alias("size"), F.col("ts").alias("mtime"), "props", F.col("event_id").alias("saved"), "event_type")
    last = events.where("event_type <> 'error'").groupBy("path").agg(F.max_by(F.struct("size", "mtime"), "saved").alias("f")).select("path", "f.*")
    return marks.latest_state(events.drop("event_type"), last, "saved").select("path", "size", "mtime", "props")


# --- tokens and widths -----------------------------------------------------------------------------------------------


def _tokens(spark, sf_dir, mode: str) -> DataFrame:
    return tokens.tokens(documents(spark, sf_dir), mode).select("path", "line_no", "start", "end", "token")


TOKEN_ROWS = 'SELECT path, line_no, start, start + len AS "end", matched AS token FROM spans'
WIDE, NARROW = spans_sql(r"\S+"), spans_sql(r"[\p{L}\p{Nd}_]+|[^\s\p{L}\p{Nd}_]+")


@register("tokens_wide", TOKEN_ROWS, (LINES, *WIDE))
def tokens_wide(spark, sf_dir):
    return _tokens(spark, sf_dir, "wide")


@register("tokens_narrow", TOKEN_ROWS, (LINES, *NARROW))
def tokens_narrow(spark, sf_dir):
    return _tokens(spark, sf_dir, "narrow")


@register("token_topk", "SELECT matched AS token, COUNT(*) AS n FROM spans GROUP BY 1 ORDER BY n DESC, token LIMIT 50", (LINES, *WIDE))
def token_topk(spark, sf_dir):
    return tokens.token_counts(documents(spark, sf_dir)).orderBy(F.desc("n"), "token").limit(50)


@register(
    "token_at",
    """SELECT p.path, p.line_no, p.index, s.start, s.matched AS token FROM probes p
  LEFT JOIN spans s ON s.path = p.path AND s.line_no = p.line_no AND p.index >= s.start AND p.index < s.start + s.len""",
    (LINES, *NARROW, "probes AS (SELECT path, line_no, unnest([10, CAST(length(text) // 2 AS INTEGER)]) AS index FROM lines)"),
)
def token_at(spark, sf_dir):
    """The narrow tokens over the eleventh and over the middle character of each line."""
    lines = documents(spark, sf_dir)
    places = F.array(F.lit(10), F.floor(F.length("text") / 2).cast("int"))
    return tokens.token_at(lines, lines.select("path", "line_no", F.explode(places).alias("index")), "narrow").select("path", "line_no", "index", "start", "token")


@register("display_width", "SELECT path, CAST(MAX(length(text)) AS INTEGER) AS widest, CAST(SUM(length(text)) AS BIGINT) AS cells FROM lines GROUP BY 1")
def display_widths(spark, sf_dir):
    cells = display_width(F.col("text"))
    return documents(spark, sf_dir).select("path", cells.alias("c")).groupBy("path").agg(F.max("c").alias("widest"), F.sum("c").alias("cells"))


# --- files and streams -----------------------------------------------------------------------------------------------

#: Documents as text files, a thousand of them in one by their ids.
FILE_LINES = """fsrc AS (SELECT doc_id // 1000 AS path, doc_id, string_split(COALESCE(text, ''), chr(10)) AS s FROM documents),
fraw AS (SELECT path, doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM fsrc),
flines AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY doc_id, i) - 1 AS line_no,
  CAST(COALESCE(SUM(strlen(line) + 1) OVER (PARTITION BY path ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_off,
  CAST(strlen(line) AS INTEGER) AS n_bytes, CASE WHEN ends_with(line, chr(13)) THEN line[:-2] ELSE line END AS text FROM fraw)"""


def written(spark: SparkSession, sf_dir: str, mark: bool = False) -> str:
    """The folder with the documents as text files, with a mark of byte order at their beginning if it is wished."""
    where = fresh_folder(spark, "files")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"), F.floor(F.col("doc_id") / 1000).alias("bucket"))
    if mark:
        first = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")) == 1
        docs = docs.withColumn("value", F.when(first, F.concat(F.lit("\ufeff"), F.col("value"))).otherwise(F.col("value")))
    docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("value", "bucket").write.partitionBy("bucket").text(where)
    return where


def by_bucket(df: DataFrame) -> DataFrame:
    """The number of a file as its path."""
    return df.withColumn("path", F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long"))


def raw_lines(spark: SparkSession, where: str) -> DataFrame:
    return L.read_lines(spark, f"{where}/bucket=*")


@register("file_lines", "SELECT path, text FROM flines", (FILE_LINES,))
def file_lines(spark, sf_dir):
    return by_bucket(raw_lines(spark, written(spark, sf_dir))).select("path", "text")


@register("file_numbers", "SELECT * FROM flines", (FILE_LINES,))
def file_numbers(spark, sf_dir):
    return by_bucket(L.number_lines(raw_lines(spark, written(spark, sf_dir))))


@register("file_numbered", "SELECT * FROM flines", (FILE_LINES,))
def file_numbered(spark, sf_dir):
    return by_bucket(numbered_files(spark, f"{written(spark, sf_dir)}/bucket=*"))


def index_of(spark: SparkSession, sf_dir: str) -> str:
    """An index of the documents as text files, of small spans, so that files have many."""
    where = fresh_folder(spark, "index")
    index.refresh(spark, f"{written(spark, sf_dir)}/bucket=*", where, stride=8192)
    return where


def some_of(spark: SparkSession, where: str, upto: str, step: int, name: str) -> DataFrame:
    """Every ``step``-th number from 0 up to a column of the index's manifest."""
    return index.manifest(spark, where).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1, F.lit(step).cast("long"))).alias(name))


@register("index_lines", "SELECT * FROM flines", (FILE_LINES,))
def index_lines(spark, sf_dir):
    return by_bucket(index.all_lines(spark, index_of(spark, sf_dir)))


@register("index_fetch", "SELECT * FROM flines WHERE line_no % 7 = 0", (FILE_LINES,))
def index_fetch(spark, sf_dir):
    where = index_of(spark, sf_dir)
    return by_bucket(index.fetch_lines(spark, where, some_of(spark, where, "lines", 7, "line_no")))


OFFSETS = 'probes AS (SELECT path, unnest(range(0, size, 10007)) AS "offset" FROM (SELECT path, CAST(SUM(n_bytes + 1) AS BIGINT) AS size FROM flines GROUP BY path))'


@register("index_offsets", 'SELECT p.path, p."offset" AS probe, l.line_no, l.byte_off FROM probes p ASOF JOIN flines l ON p.path = l.path AND p."offset" >= l.byte_off', (FILE_LINES, OFFSETS))
def index_offsets(spark, sf_dir):
    where = index_of(spark, sf_dir)
    found = index.lines_at(spark, where, some_of(spark, where, "bytes", 10_007, "offset"), 8192)
    return by_bucket(found.select("path", "probe", "line_no", "byte_off"))


@register(
    "index_pages",
    """SELECT path, "offset", turn, line_no, text FROM (SELECT p."offset", l.*, row_number() OVER (PARTITION BY p.path, p."offset" ORDER BY byte_off) AS turn
  FROM probes p JOIN (SELECT path AS at, "offset", MIN(byte_off) AS low FROM probes JOIN flines USING (path) WHERE byte_off >= "offset" GROUP BY ALL) f ON f.at = p.path AND f."offset" = p."offset"
  JOIN (SELECT path AS there, byte_off AS low, line_no AS first FROM flines) s ON s.there = p.path AND s.low = f.low
  JOIN flines l ON l.path = p.path AND l.line_no BETWEEN first AND first + 2)""",
    (FILE_LINES, OFFSETS),
)
def index_pages(spark, sf_dir):
    where = index_of(spark, sf_dir)
    found = index.pages_at(spark, where, some_of(spark, where, "bytes", 10_007, "offset"), 3, 8192)
    return by_bucket(found.select("path", "offset", F.col("turn").cast("long").alias("turn"), "line_no", "text"))


@register("index_search", "SELECT path, line_no, byte_off, text FROM flines WHERE contains(text, 'tion') AND regexp_matches(text, '^[A-Z].*tion ') AND line_no > 20", (FILE_LINES,))
def index_search(spark, sf_dir):
    """Filters on the number and on the text go into the source, with what a match must have."""
    lines = index.indexed(spark, index_of(spark, sf_dir)).where("line_no > 20")
    return by_bucket(search.search(lines, Pattern("^[A-Z].*tion ", regex=True)).select("path", "line_no", "byte_off", "text"))


@register("file_search", "SELECT path, line_no, byte_off, text FROM flines WHERE regexp_matches(text, 'license', 'i')", (FILE_LINES,))
def file_search(spark, sf_dir):
    return by_bucket(search.search_files(raw_lines(spark, written(spark, sf_dir)), LICENSE)).select("path", "line_no", "byte_off", "text")


@register("file_decoded", "SELECT path, COUNT(*) AS n, CAST(SUM(strlen(text)) AS BIGINT) AS chars FROM flines GROUP BY 1", (FILE_LINES,))
def file_decoded(spark, sf_dir):
    """Read as Latin-1, a text has as many characters as bytes."""
    decoded = by_bucket(L.decode_lines(raw_lines(spark, written(spark, sf_dir)), "ISO-8859-1"))
    return decoded.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("file_profiles", "SELECT path, CAST(SUM(n_bytes + 1) AS BIGINT) AS size, 0 AS bom_len, false AS has_bom, 'UTF-8' AS encoding, 'Lf' AS newline FROM flines GROUP BY 1", (FILE_LINES,))
def file_profiles(spark, sf_dir):
    return by_bucket(profile_files(spark, f"{written(spark, sf_dir)}/bucket=*"))


@register("file_newlines", "SELECT DISTINCT path, 'Lf' AS newline FROM flines", (FILE_LINES,))
def file_newlines(spark, sf_dir):
    return by_bucket(detect_newline(spark, f"{written(spark, sf_dir)}/bucket=*"))


@register("lines_table", "SELECT * FROM lines")
def lines_table(spark, sf_dir):
    where = fresh_folder(spark, "lines")
    L.save_lines_table(documents(spark, sf_dir), where)
    return L.open_lines_table(spark, where)


def finished(writer) -> None:
    """Run a stream over what there is now."""
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows that a stream has for now, by way of a table."""
    where = fresh_folder(spark, "stream")
    finished(stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/progress"))
    return by_bucket(spark.read.schema(stream.schema).parquet(f"{where}/rows"))


@register("tail_lines", "SELECT path, byte_off, text FROM flines", (FILE_LINES,))
def tail_lines(spark, sf_dir):
    return streamed(spark, tail.tail_lines(spark, f"{written(spark, sf_dir)}/bucket=*/part-*"))


@register("tail_numbered", "SELECT path, line_no, byte_off, text FROM flines", (FILE_LINES,))
def tail_numbered(spark, sf_dir):
    return streamed(spark, tail.tail_numbered(tail.tail_lines(spark, f"{written(spark, sf_dir)}/bucket=*/part-*")))


@register("tail_search", "SELECT path, byte_off, 'the' AS filter_name FROM flines WHERE contains(text, 'the') UNION ALL SELECT path, byte_off, 'license' FROM flines WHERE regexp_matches(text, 'license', 'i')", (FILE_LINES,))
def tail_search(spark, sf_dir):
    stream = tail.tail_lines(spark, f"{written(spark, sf_dir)}/bucket=*/part-*")
    return streamed(spark, tail.tail_search(stream, {"the": THE, "license": LICENSE}).select("path", "byte_off", "filter_name"))


@register("tail_marked", "SELECT path, CASE WHEN byte_off = 0 THEN 3 ELSE byte_off + 3 END AS byte_off, text FROM flines", (FILE_LINES,))
def tail_marked(spark, sf_dir):
    """Files that begin with a mark of byte order: it is in no line, and lines stand three bytes further on."""
    where = written(spark, sf_dir, mark=True)
    return streamed(spark, tail.tail_lines(spark, f"{where}/bucket=*/part-*"))


#: The documents cut into segments that hold 5,000 characters of a thousand documents each, wherever that is in a line.
SEGMENTS = 5000


@register("segment_lines", "SELECT path, line_no, byte_off, text FROM flines", (FILE_LINES,))
def segment_lines(spark, sf_dir):
    """Documents as logs of a thousand each, whose segments come as rows of a stream and end anywhere in a line."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).cast("string").alias("log"), "doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    size = F.greatest(F.ceil(F.length("text") / SEGMENTS), F.lit(1))
    cut = docs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    cut = cut.withColumn("content", F.substring(F.col("text"), (F.col("i") * SEGMENTS + 1).cast("int"), F.lit(SEGMENTS)).cast("binary"))
    place = F.row_number().over(Window.partitionBy("log").orderBy("doc_id", "i")) - 1
    where = fresh_folder(spark, "segments")
    cut.select("log", place.cast("long").alias("number"), "content").repartition(7, "number").write.parquet(where)
    stream = spark.readStream.schema("log string, number long, content binary").option("maxFilesPerTrigger", 3).parquet(where)
    found = segments.segment_lines(stream).withColumn("path", F.concat(F.lit("bucket="), F.col("path")))
    return streamed(spark, found)


@register("tail_hits", "SELECT path, byte_off, text FROM flines WHERE regexp_matches(text, 'license', 'i')", (FILE_LINES,))
def tail_hits(spark, sf_dir):
    """Hits of a tail in a table to which each batch appends its own once."""
    hits = tail.tail_search(tail.tail_lines(spark, f"{written(spark, sf_dir)}/bucket=*/part-*"), LICENSE)
    where = fresh_folder(spark, "hits")
    finished(tables.append_hits(hits, f"{where}/table", f"{where}/progress"))
    return by_bucket(tables.open_hits(spark, f"{where}/table", hits.schema).drop("batch"))


@register("upserted", "SELECT user_id, event_type, ts, event_id FROM last", (LAST_EDITS,))
def upserted(spark, sf_dir):
    """The last edit of each user, kept by a stream in buckets."""
    where = fresh_folder(spark, "upserts")
    edits(spark, sf_dir).repartition(5).write.parquet(f"{where}/log")
    schema = spark.read.parquet(f"{where}/log").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/log").withColumn("at", F.struct("ts", "event_id"))
    finished(tables.upsert_stream(stream, "user_id", "at", f"{where}/table", f"{where}/progress", value="event_type"))
    return tables.open_upserted(spark, f"{where}/table", stream.schema, "event_type").select("user_id", "event_type", "ts", "event_id")


@register("wide_lines", "SELECT path, line_no, 2 + 2 * (byte_off) AS byte_off, 2 * n_bytes AS n_bytes, text FROM wlines", ("""wsrc AS (SELECT p_partkey % 7 AS path, p_partkey AS k, p_name || ' ' || p_type AS line FROM part),
wlines AS (SELECT path, line, row_number() OVER w - 1 AS line_no, CAST(COALESCE(SUM(length(line) + 1) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_off,
  CAST(length(line) AS INTEGER) AS n_bytes, line AS text FROM wsrc WINDOW w AS (PARTITION BY path ORDER BY k))""",))
def wide_lines(spark, sf_dir):
    """Names of parts as UTF-16 files with a mark of byte order, read by code units over small ranges."""
    where = fresh_folder(spark, "wide")
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("bucket"), "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("value"))
    first = F.row_number().over(Window.partitionBy("bucket").orderBy("p_partkey")) == 1
    parts = parts.withColumn("value", F.when(first, F.concat(F.lit("\ufeff"), F.col("value"))).otherwise(F.col("value")))
    dealt = parts.repartition("bucket").sortWithinPartitions("bucket", "p_partkey").select("value", "bucket")
    dealt.write.partitionBy("bucket").option("encoding", "UTF-16LE").option("header", "false").option("quote", "\0").option("emptyValue", "").csv(where)
    return by_bucket(numbered_files(spark, f"{where}/bucket=*", "UTF-16LE", width=5000))
