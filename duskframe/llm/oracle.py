"""The queries of this subpackage that SQL can express, in SQL for DuckDB."""

from __future__ import annotations

import string

from . import licenses


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_quote(name)}, {_quote(text)})" for name, text in sorted(licenses.TEMPLATES.items()))
_MARKS = " || ".join(f"chr({ord(c)})" for c in licenses._MARKS)


def _grams(text: str) -> str:
    words = f"list_filter(string_split(translate(lower({text}), {_MARKS}, repeat(' ', {len(licenses._MARKS)})), ' '), lambda w: w <> '')"
    return f"(SELECT CASE WHEN len(w) < 2 THEN [] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END FROM (SELECT {words} AS w))"


LICENSES = rf"""
WITH t0 AS (SELECT license, {_grams("line")} AS s FROM (VALUES {_TEMPLATES}) AS v(license, line)),
t AS (SELECT license, s, list_distinct(s) AS g FROM t0),
l AS (SELECT doc_id, text, regexp_split_to_array(text, '\r\n|\r|\n') AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS unit, unnest(lines) AS line FROM l UNION ALL SELECT doc_id, 0, text FROM l WHERE len(lines) > 1),
g AS (SELECT doc_id, unit, list_distinct({_grams("line")}) AS g FROM u),
c AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g JOIN t ON len(g.g) > 0 AND len(g.g) BETWEEN len(t.g) / 2 AND len(t.g) * 2),
w AS (SELECT doc_id, {_grams("text")} AS s FROM documents WHERE text IS NOT NULL),
h AS (SELECT w.doc_id, w.s, t.license, t.s AS ts, t.g AS tg FROM w JOIN t ON (2 - {licenses.THRESHOLD}) * len(list_intersect(list_distinct(w.s), t.g)) >= {licenses.THRESHOLD} * len(t.g) - 1e-9),
v AS (SELECT doc_id, license, p - list_position(ts, s[p]) + 1 AS d FROM (SELECT doc_id, license, s, ts, unnest(range(1, len(s) + 1)) AS p FROM h) WHERE list_contains(ts, s[p])),
e AS (SELECT doc_id, license, d FROM (SELECT doc_id, license, d, row_number() OVER (PARTITION BY doc_id, license ORDER BY count(*) DESC, d) AS k FROM v GROUP BY doc_id, license, d) WHERE k = 1),
f AS (SELECT h.doc_id, h.license, greatest(e.d, 1) AS a, e.d + len(ts) - 1 AS z, tg, list_distinct(s[greatest(e.d, 1):e.d + len(ts) - 1]) AS g FROM h JOIN e ON h.doc_id = e.doc_id AND h.license = e.license),
x AS (SELECT doc_id, license, a, z, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM f),
y AS (SELECT * FROM x WHERE dice >= {licenses.THRESHOLD} - 1e-12),
z AS (SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM y o WHERE o.doc_id = y.doc_id AND o.a <= y.z AND y.a <= o.z AND (o.dice > y.dice OR (o.dice = y.dice AND o.license < y.license)))),
m0 AS (SELECT * FROM c WHERE dice >= {licenses.THRESHOLD} - 1e-12),
m AS (SELECT doc_id, unit, license, dice FROM m0 UNION ALL SELECT doc_id, -a, license, dice FROM z WHERE NOT EXISTS (SELECT 1 FROM m0 WHERE m0.doc_id = z.doc_id AND m0.license = z.license)),
b AS (SELECT doc_id, unit, license, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS k FROM m WHERE dice >= {licenses.THRESHOLD} - 1e-12) WHERE k = 1)
SELECT d.doc_id, count(b.unit) AS n_units, count(DISTINCT b.license) AS n_licenses, arg_min(b.license, struct_pack(x := -b.dice, y := b.license)) AS license, round(max(b.dice), 9) AS dice
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN b ON d.doc_id = b.doc_id GROUP BY d.doc_id
"""

_REACH = """
sym AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id AS a, id AS c FROM ids UNION SELECT sym.a, r.c FROM r JOIN sym ON r.a = sym.b),
least AS (SELECT a, min(c) AS c FROM r GROUP BY a)"""

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
ids AS (SELECT doc_id AS id FROM documents),{_REACH}
SELECT s.doc_id, len(s.s) AS n_shingles, least.c AS component_id, s.doc_id = least.c AS kept FROM s JOIN least ON s.doc_id = least.a
"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(y.v, y.v)) >= 0.9),
ids AS (SELECT vec_id AS id FROM embeddings),{_REACH}
SELECT least.a AS vec_id, (SELECT count(*) FROM sym WHERE sym.a = least.a) AS n_links, least.c AS component_id, least.a = least.c AS kept FROM least
"""

_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"  # noqa: E731
_LEAF = lambda n: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', n, 'text')))})"  # noqa: E731
#: CRC-32 of an ASCII text, bit by bit: a step for each character, then eight shifts.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"

MERKLE = rf"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF("n_chars + 1")} ELSE {_LEAF("n_chars")} END AS claim FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM f),
n AS (SELECT g, 0 AS level, i, m, leaf AS h FROM leaves
  UNION ALL SELECT g, level + 1, i // 2, (m + 1) // 2, sha256(CASE WHEN i + 1 < m THEN h || r ELSE h END) FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY i) AS r FROM n WHERE m > 1) WHERE i % 2 = 0),
s AS (SELECT g, level AS height, h AS subroot FROM n WHERE m = 1),
t AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m, subroot FROM s),
u AS (SELECT 0 AS level, i, m, subroot AS h FROM t
  UNION ALL SELECT level + 1, i // 2, (m + 1) // 2, sha256(CASE WHEN i + 1 < m THEN h || r ELSE h END) FROM (SELECT *, lead(h) OVER (ORDER BY i) AS r FROM u WHERE m > 1) WHERE i % 2 = 0),
w AS (SELECT leaves.g, doc_id, leaf, 0 AS level, leaves.i AS j, 0 AS part, claim AS x, '' AS proof FROM leaves
  UNION ALL SELECT w.g, doc_id, leaf,
    CASE WHEN part = 0 AND level = height THEN 0 ELSE level + 1 END,
    CASE WHEN part = 0 AND level = height THEN t.i ELSE j // 2 END,
    CASE WHEN part = 0 AND level = height THEN 1 ELSE part END,
    CASE WHEN part = 0 AND level = height THEN x ELSE sha256(CASE WHEN j % 2 = 1 THEN coalesce(a.h, b.h) || x ELSE x || coalesce(a.h, b.h, '') END) END,
    CASE WHEN part = 0 AND level = height THEN proof ELSE proof || coalesce(a.h, b.h, '') END
  FROM w JOIN s ON w.g = s.g JOIN t ON w.g = t.g
  LEFT JOIN (SELECT g AS ag, level AS al, i AS ai, h FROM n) a ON part = 0 AND ag = w.g AND al = level AND ai = xor(j, 1) AND level < height
  LEFT JOIN (SELECT level AS bl, i AS bi, h FROM u) b ON part = 1 AND bl = level AND bi = xor(j, 1)
  WHERE part = 0 OR level < (SELECT max(level) FROM u)),
root AS (SELECT h AS root FROM u WHERE m = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM w JOIN s ON w.g = s.g, root WHERE part = 1 AND level = (SELECT max(level) FROM u)
"""

FILL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '[ 	-]*[^ 	-]+|[ 	-]+') AS k, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(k) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b FROM k),
p AS (SELECT *, array_to_string(k[1:a], '') AS prefix, array_to_string(k[a + 1:b], '') AS middle, array_to_string(k[b + 1:], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

LINES = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM e),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, i, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

SQL: dict[str, str] = {"op1_license_scan": LICENSES, "op3_minhash_groups": MINHASH, "op8_vector_groups": VECTORS, "op11_merkle_manifest": MERKLE, "op12_fill_in_middle": FILL, "op13_line_dedup": LINES}
