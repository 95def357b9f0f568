"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from siltworks.llm import quality_rules as rules

_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_bare = "regexp_replace({}, '[\\x20\\x09-\\x0D]', '', 'g')"


def _count(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, {_quoted(chars)}, '')))"


_line_bad = " OR ".join(
    [
        f"NOT contains({_quoted(rules.ENDINGS)}, right(rtrim(replace(x, chr(13), ''), ' '), 1))",
        f"2 * {_count('x', '!')} > {_count('trim(x, chr(32))', ' ')} + 1",
        f"10 * {_count('x', rules.SYMBOLS)} > length(x)",
        f"({_count('x', rules.SEPARATORS)} >= 3 AND 3 * {_count('x', rules.SEPARATORS)} >= {_count('trim(x, chr(32))', ' ')} + 1)",
        *[f"contains(lower(x), {_quoted(b)})" for b in rules.BOILERPLATE],
    ]
)

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""

_words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_words} AS w FROM documents),
b AS (SELECT item_id, len(w) AS n, least(len(w), 5) AS k, w FROM (SELECT item_id, {_words} AS w FROM benchmark) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM b),
bg AS (SELECT item_id, n, k, q, array_to_string(w[q + 1:q + k], ' ') AS g FROM (SELECT *, unnest(generate_series(0, n - k)) AS q FROM b)),
dg AS (SELECT doc_id, size, k, p, array_to_string(w[p + 1:p + k], ' ') AS g
       FROM (SELECT doc_id, len(w) AS size, w, k, unnest(generate_series(0, len(w) - k)) AS p FROM d, ks)),
win AS (SELECT DISTINCT doc_id, item_id, n, bg.k, greatest(0, least(p - q, size - n)) AS s, least(size, n) AS m
        FROM dg JOIN bg ON dg.g = bg.g AND dg.k = bg.k),
wg AS (SELECT win.doc_id, win.item_id, win.s, win.n, win.k, win.m, dg.g, count(*) AS c
       FROM win JOIN dg ON dg.doc_id = win.doc_id AND dg.k = win.k AND dg.p BETWEEN win.s AND win.s + win.m - win.k GROUP BY ALL),
ig AS (SELECT item_id, g, count(*) AS c FROM bg GROUP BY ALL),
sc AS (SELECT doc_id, wg.item_id, s, n, sum(least(wg.c, ig.c))::INT AS shared, (m - k + 1 + n - k + 1 - sum(least(wg.c, ig.c)))::INT AS total
       FROM wg JOIN ig ON ig.item_id = wg.item_id AND ig.g = wg.g GROUP BY doc_id, wg.item_id, s, n, k, m)
SELECT doc_id, item_id, s::INT AS start, n::INT AS n_words, shared, total FROM sc WHERE 100 * shared >= 80 * total
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, s) = 1
"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_words} AS w FROM documents),
x AS (SELECT doc_id, i, len(w) AS n, w[i] AS a, w[i - 1] AS b, w[i - 2] AS c FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM d)),
u AS (SELECT doc_id, a, count(*) AS k FROM x GROUP BY ALL),
v AS (SELECT doc_id, a, b, count(*) AS k FROM x WHERE i > 1 GROUP BY ALL),
t AS (SELECT doc_id, a, b, c, count(*) AS k FROM x WHERE i > 2 GROUP BY ALL),
u1 AS (SELECT doc_id, a, sum(k) OVER (PARTITION BY a) - k AS k FROM u),
v1 AS (SELECT doc_id, a, b, sum(k) OVER (PARTITION BY a, b) - k AS k FROM v),
t1 AS (SELECT doc_id, a, b, c, sum(k) OVER (PARTITION BY a, b, c) - k AS k FROM t),
z AS (SELECT sum(k) AS z FROM u),
s AS (
  SELECT x.doc_id,
         CASE WHEN x.i > 2 AND t1.k > 0 THEN ln(t1.k / vc.k)
              WHEN x.i > 1 AND v1.k > 0 THEN ln(v1.k / uc.k) + CASE WHEN x.i > 2 THEN ln(0.4) ELSE 0 END
              ELSE ln(greatest(u1.k, 0.5) / greatest(z.z - x.n, 1)) + least(x.i - 1, 2) * ln(0.4) END AS s
  FROM x CROSS JOIN z
  JOIN u1 ON u1.doc_id = x.doc_id AND u1.a = x.a
  LEFT JOIN v1 ON x.i > 1 AND v1.doc_id = x.doc_id AND v1.a = x.a AND v1.b = x.b
  LEFT JOIN t1 ON x.i > 2 AND t1.doc_id = x.doc_id AND t1.a = x.a AND t1.b = x.b AND t1.c = x.c
  LEFT JOIN u1 uc ON x.i > 1 AND uc.doc_id = x.doc_id AND uc.a = x.b
  LEFT JOIN v1 vc ON x.i > 2 AND vc.doc_id = x.doc_id AND vc.a = x.b AND vc.b = x.c),
r AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0.0), 4)::DOUBLE AS log_score, round(coalesce(s / len(w), 0.0), 4)::DOUBLE AS mean_log_score
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: {_bare.format('x')} <> '') AS lines FROM d),
g AS (SELECT doc_id, words, i, array_to_string(words[i:i + {rules.WINDOW - 1}], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {rules.WINDOW - 1})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, {rules.WINDOW - 1}) AS s(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length({_bare.format('text')})::BIGINT AS word_chars,
             {_count('text', rules.SYMBOLS)}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
             coalesce(list_sum(list_transform(list_filter(list_distinct(lines), lambda x: NOT ({_line_bad})), lambda x: length({_bare.format('x')}))), 0)::BIGINT AS kept_chars
      FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id),
b AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND 100 * kept_chars >= {rules.MIN_KEPT_PERCENT} * word_chars AS kept FROM b
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe,
         replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '~', '~0'), chr(10), '~1') AS safe_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + CASE WHEN opens THEN length('<|im_start|>' || safe_role || chr(10) || '<|im_end|>' || chr(10)) ELSE length('<|im_sep|>') END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

def _crc32(x: str) -> str:
    """Unsigned CRC-32 of the decimal digits of an integer."""
    bits = f"flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    {crc32} AS h
  FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM e),
t AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM f),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
r AS (SELECT doc_id, min(i) AS a, count(*) + q AS length, q FROM s GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12),
m AS (SELECT doc_id, a, length, min(q) AS q FROM r GROUP BY ALL),
k AS (SELECT doc_id, i, word FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = t.doc_id AND t.i >= m.a + m.q AND t.i < m.a + m.length)),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_runs, first({'a': a, 'length': length, 'q': q} ORDER BY length DESC, a, q) AS best,
  string_agg(a || ',' || length || ',' || q || chr(10), '' ORDER BY a, q) AS lines FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.a::BIGINT AS start, best.length::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.length // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""".replace("{crc32}", _crc32("doc_id"))

OP12_SQL = rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS n FROM k),
c AS (SELECT DISTINCT conv_id, {_crc32("conv_id")} % 4 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS part, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND n <= h
  UNION ALL SELECT c.conv_id, 1, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND n > h),
o AS (SELECT conv_id, text, row_number() OVER w AS depth, list([role, text]) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)),
m AS (SELECT conv_id, depth, path, text FROM o UNION ALL SELECT conv_id, 0, [], '' FROM c),
e AS (SELECT conv_id, max(depth) AS len FROM m GROUP BY conv_id),
v AS (
  SELECT path, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS saved,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM m JOIN e ON e.conv_id = m.conv_id GROUP BY path, depth),
a AS (SELECT m.conv_id AS c, m.depth, v.conv_id FROM m JOIN v ON v.path = m.path AND v.depth = m.depth),
p AS (SELECT v.*, a.conv_id AS parent_conv_id FROM v LEFT JOIN a ON a.c = v.conv_id AND a.depth = v.depth - 1),
n AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
f AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN n ON n.conv_id = p.conv_id AND n.depth = p.depth),
s AS (
  SELECT a.conv_id, a.depth, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM f JOIN a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, ends_sha256
FROM f JOIN s ON s.conv_id = f.conv_id AND s.depth = f.depth
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
i AS (SELECT r, x, unnest(range(1, length(x) // 2 - 398)) AS s FROM d WHERE length(x) >= 800),
h AS (SELECT r, s, md5_number(substring(x, 2 * s - 1, 800)) AS k FROM i),
t AS (SELECT r, s FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 400, true) AS opens FROM t),
n AS (SELECT r, s, sum(opens::INT) OVER (PARTITION BY r ORDER BY s) AS k FROM g),
p AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM n GROUP BY r, k),
o AS (SELECT r, a, b, lag(b, 1, 1) OVER (PARTITION BY r ORDER BY a) AS before FROM p),
q AS (SELECT r, count(*) AS n, sum(b - a) AS gone, max(b) AS last, list([before, a - before] ORDER BY a) AS parts FROM o GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(parts, lambda y: substring(x, 2 * y[1] - 1, 2 * y[2])), ''), '') || substring(x, 2 * coalesce(last, 1) - 1))) AS kept_sha256
FROM d LEFT JOIN q ON q.r = d.r
"""
