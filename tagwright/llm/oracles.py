"""DuckDB SQL twins of the queries that SQL can express; only the correctness check runs them."""

from __future__ import annotations

from tagwright.llm import linededup, mixing, secretscan, substring
from tagwright.llm.common import WORD


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_HEX = "('0x' || substr(md5({x}), {a}, {n}))::BIGINT"


def _hex(x: str, a: int, n: int) -> str:
    return _HEX.format(x=x, a=a, n=n)


# pattern rules and dates as in queries.listed / queries.captured
URL_FILTER = f"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
             list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS segs,
             DATE '2020-01-01' + CAST({_hex("'f' || page_id", 1, 6)} % 1461 AS INTEGER) AS fetched FROM pages),
candidates AS (SELECT DISTINCT unnest([host, CASE WHEN len(string_split(host, '.')) >= 4 THEN array_to_string(string_split(host, '.')[2:], '.') END,
             CASE WHEN len(segs) > 0 THEN host || '/' || segs[1] END]) AS pattern FROM p WHERE host <> ''),
listed AS (SELECT pattern, DATE '2020-01-01' + CAST({_hex('pattern', 5, 4)} % 1000 AS INTEGER) AS d1,
             {_hex('pattern', 9, 2)} % 2 = 0 AS off, {_hex('pattern', 14, 2)} % 3 = 0 AS again,
             CAST(1 + {_hex('pattern', 11, 3)} % 400 AS INTEGER) AS days FROM candidates
           WHERE pattern IS NOT NULL AND {_hex('pattern', 1, 4)} % 4 = 0),
entries AS (SELECT pattern, d1 AS d, 1 AS on_list FROM listed UNION ALL SELECT pattern, d1 + days, 0 FROM listed WHERE off
            UNION ALL SELECT pattern, d1 + days + 100, 1 FROM listed WHERE off AND again),
state AS (SELECT p.page_id, e.pattern, arg_max(e.on_list, e.d) AS on_list FROM p JOIN entries e ON e.d <= p.fetched AND (p.host = e.pattern
            OR ends_with(p.host, '.' || e.pattern) OR starts_with(p.host || '/' || array_to_string(p.segs, '/') || '/', e.pattern || '/'))
          GROUP BY ALL),
best AS (SELECT page_id, arg_max(pattern, lpad(length(pattern)::VARCHAR, 6, '0') || pattern) AS pattern FROM state WHERE on_list = 1 GROUP BY 1)
SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, b.pattern IS NOT NULL AS blocked, b.pattern FROM p LEFT JOIN best b ON p.page_id = b.page_id
"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
n AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, {lit(WORD)})) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
      FROM (SELECT doc_id, pos, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM l) t WHERE line <> ''),
-- equal lines at two places, the later one in b; maximal runs of them along a diagonal
m AS (SELECT a.doc_id AS of, b.doc_id, b.i, b.pos, b.words, b.i - a.i AS diagonal FROM n a JOIN n b ON a.line = b.line
      AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))),
o AS (SELECT *, i - row_number() OVER (PARTITION BY of, doc_id, diagonal ORDER BY i) AS island FROM m),
r AS (SELECT doc_id, list(pos) AS ats FROM o GROUP BY of, doc_id, diagonal, island HAVING count(*) >= 3 OR sum(words) >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(ats) AS pos FROM r),
k AS (SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN raw END, chr(10) ORDER BY l.pos) AS text, count(*) AS n_lines, count(g.pos) AS n_removed
      FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM k
"""

_LETTERS = "length(regexp_replace(text, '\\P{L}+', '', 'g'))"
MIXING = f"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), {lit(WORD)})) AS size,
             greatest({mixing.MIN_WEIGHT}::DOUBLE, coalesce({_LETTERS}::DOUBLE / nullif(length(text), 0), 0)) AS wt,
             coalesce(md5(text), 'null') AS tk FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5('mix:' || doc_id || ':' || tk), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / wt AS key FROM d),
src AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM src),
b AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights,
        coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
      FROM a WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap / weight * (weights - weight_before) <= total - cap_before AS capped FROM b),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE least(cap, (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))
        / (sum(CASE WHEN NOT capped THEN weight END) OVER ()) * weight) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.tk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN rest > 0 AND upto + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

_N = substring.WINDOW
PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {lit(WORD)}) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - {_N - 2})) AS i, w FROM d WHERE len(w) >= {_N}),
h AS (SELECT doc_id, i, array_to_string(w[i:i + {_N - 1}], ' ') AS g FROM s),
m AS (SELECT g, min(doc_id) AS low FROM h GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {_N})) AS i FROM h JOIN m USING (g) WHERE doc_id > low),
x AS (SELECT doc_id, list(i) AS gi FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gi), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gi IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
    lambda z: NOT list_contains(gi, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""


def _spans(kind: str, order: int) -> str:
    e, group, least = secretscan.RULES[kind]
    total = "coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    return (f"SELECT doc_id, '{kind}' AS kind, {order} AS ord, "
            f"({total.format(x='p[1:i]')} + {total.format(x='h[1:i - 1]')})::BIGINT AS s, "
            f"({total.format(x='p[1:i]')} + {total.format(x='h[1:i]')})::BIGINT AS e FROM ("
            f"SELECT doc_id, string_split_regex(text, {lit(e)}) AS p, regexp_extract_all(text, {lit(e)}, 0) AS h, "
            f"regexp_extract_all(text, {lit(e)}, {group}) AS g, generate_subscripts(regexp_extract_all(text, {lit(e)}, 0), 1) AS i FROM t) q "
            f"WHERE length(g[i]) >= {least}")


def secrets() -> str:
    every = " UNION ALL ".join(_spans(k, i) for i, k in enumerate(secretscan.RULES))
    base = ", ".join(f"'{k}'" for k in secretscan.BASE)
    text = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secretscan.BASE)
    return (f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({every}), "
            f"g AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY s, ord) FILTER (kind IN ({base})) AS base, "
            f"string_agg({text}, ',' ORDER BY s, ord) AS spans FROM a GROUP BY doc_id) "
            "SELECT t.doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secretscan.BASE)
            + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON t.doc_id = g.doc_id")


HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

_TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_SHARE = "(1 + (1000000000::HUGEINT * ({n} + 2)) // ({size} + 2 * {terms}))"
_DIVERGES = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {lit(_TERM)}) AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
l AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
v AS (SELECT g.lang, count(l.term) AS terms, coalesce(sum(l.total), 0)::BIGINT AS lang_size FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN l ON g.lang = l.lang GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN l USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS size FROM (SELECT DISTINCT lang, source FROM d) g
      LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", size="g.size", terms="v.terms")} AS p,
        {_SHARE.format(n="l.total", size="v.lang_size", terms="v.terms")} AS q
      FROM g JOIN v ON g.lang = v.lang JOIN l ON g.lang = l.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum({_DIVERGES.format(p="a.p", q="b.p")}) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ({_DIVERGES.format(p="p", q="q")})::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""

NEAR_COPIES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {lit(WORD)}) AS w
      FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
e AS (SELECT doc_id, unnest(x) AS g, len(x) AS n FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n
      HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.x)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.x)
"""
