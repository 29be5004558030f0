"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

SQUARE = "list_reduce(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda s, v: s + v)"

NEAREST = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt({SQUARE.format(a='q.e', b='c.e')}) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 10"""

NEAR = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a), counts AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""

#: Targets by water filling: sources in order of their cap per weight; up to one of them all are capped.
MIXED = r"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(COALESCE(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents),
named AS (SELECT source, CAST(SUM(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[r % 3 + 1] AS w, r % 3 AS kind FROM named),
filled AS (SELECT *, 2.0::DOUBLE * ss / w AS ratio, SUM(ss) OVER () AS total, COALESCE(SUM(ss) OVER (ORDER BY 2.0::DOUBLE * ss / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  SUM(w) OVER (ORDER BY 2.0::DOUBLE * ss / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM weighed),
levels AS (SELECT (1.5::DOUBLE * total - 2.0::DOUBLE * capped) / free AS level, ratio, r FROM filled),
level AS (SELECT arg_min(level, (ratio, r)) AS level FROM levels WHERE level <= ratio),
sources AS (SELECT source, ss, kind, least(2.0::DOUBLE * ss, level * w) AS target FROM weighed, level),
ordered AS (SELECT d.*, ss, kind, target, CAST(floor(target) AS BIGINT) AS t, CAST(COALESCE(SUM(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
taken AS (SELECT *, greatest(0, least(size, t - c)) + greatest(0, least(size, t - c - ss)) AS taken, c / target AS x FROM ordered)
SELECT doc_id, size, ss AS source_size, target, taken, CASE WHEN taken > 0 THEN CASE WHEN x >= 1.0 THEN 1.0 WHEN x <= 0 THEN 0.0
  WHEN kind = 0 THEN 0.0::DOUBLE + 2.0::DOUBLE * x / (1.5::DOUBLE + sqrt(2.25::DOUBLE + -2.0::DOUBLE * x))
  WHEN kind = 1 THEN 0.0::DOUBLE + 2.0::DOUBLE * x / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * x))
  ELSE 0.0::DOUBLE + 2.0::DOUBLE * x / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * x)) END::DOUBLE END AS position FROM taken"""

#: All lines of a document that are lost are lost together, so a document's lines are joined with the keys it loses.
COMMON = r"""WITH cut AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, MAX(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING COUNT(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, line, pos, last IS NOT NULL AND last <> doc_id AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, COUNT(*) AS n_lines, CAST(SUM(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

#: Shares of all kept terms in all sources, also of those that a source lacks.
DIVERGED = r"""WITH d AS (SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
  translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
each AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
held AS (SELECT r, lang, source, term, COUNT(*) AS n FROM each GROUP BY ALL),
counts AS (SELECT lang, source, term, SUM(n) AS n, COUNT(*) AS docs FROM held GROUP BY ALL),
kept AS (SELECT lang, term, SUM(n) AS total FROM counts GROUP BY ALL HAVING SUM(docs) >= 3),
langs AS (SELECT lang, COUNT(term) AS v, COALESCE(SUM(total), 0) AS size FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
own AS (SELECT lang, source, SUM(n) AS size FROM counts JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, COALESCE(size, 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN own USING (lang, source)),
shares AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n, 1 + 1000000000 * (COALESCE(c.n, 0) + 1) // (g.size + l.v) AS p, 1 + 1000000000 * (k.total + 1) // (l.size + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, COALESCE(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200"""

ORACLE_SQL = {"op5_additive": NEAREST, "op6_mixing": MIXED, "op9_cover_tree": NEAR, "op11_line_dedup": COMMON, "op13_divergence": DIVERGED}
