"""DuckDB SQL for the queries that SQL can express at the size of the check, written plainly: all windows, all pairs."""

from __future__ import annotations

from .licenses import RULES, SENTENCES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

#: Every string of 50 bytes of every document, as hexadecimal text; the smallest document of each.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
low AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i FROM w JOIN low USING (s) WHERE doc_id > first),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM gone),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN head IS NULL THEN x ELSE head || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: All pairs that share a shingle, and what is reachable.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

_LISTED = ", ".join(f"({k}, '{text}', {len(text.split())})" for k, text in enumerate(SENTENCES.values(), 1))
_NUMBER = {name: k for k, name in enumerate(SENTENCES, 1)}
_RULED = ", ".join(f"({r}, '{name}', {[_NUMBER[x] for x in sequence]})" for r, (name, sequence) in enumerate(RULES))
#: Pieces as rows; known sentences as runs of pieces whose words are theirs, taken from the left; then all places of all rules,
#: taken in the rules' order where no sentence is taken twice.
LICENSES = f"""
WITH RECURSIVE known(id, words, n) AS (VALUES {_LISTED}), rules(r, name, seq) AS (VALUES {_RULED}),
s AS (SELECT DISTINCT doc_id, text, [trim(regexp_replace(x, '[^a-z0-9+]+', ' ', 'g')) FOR x IN string_split(regexp_replace({_LOWER}, '[.!?;:]([\\x20\\x09-\\x0D]|$)', chr(10), 'g'), chr(10))] AS all_s FROM documents),
t AS (SELECT doc_id, text, [x FOR x IN all_s IF x <> '' AND NOT regexp_full_match(x, '[0-9]{{1,2}}')] AS x FROM s WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, unnest(range(1, len(x) + 1)) AS i, x FROM t),
w AS (SELECT doc_id, text, i, i + g AS j, array_to_string(x[i:i + g], ' ') AS words FROM p, (SELECT unnest(range(0, 12)) AS g) WHERE i + g <= len(x) AND split_part(x[i], ' ', 1) IN (SELECT split_part(words, ' ', 1) FROM known)),
c AS (SELECT doc_id, text, i, max(row(j, id)) AS m FROM w JOIN known USING (words) GROUP BY ALL),
g AS (SELECT doc_id, text, 1 AS i, 0 AS k, 0 AS id, (SELECT max(len(x)) FROM t) AS n FROM (SELECT DISTINCT doc_id, text FROM c)
  UNION ALL SELECT g.doc_id, g.text, CASE WHEN c.i IS NULL THEN g.i + 1 ELSE c.m[1] + 1 END, g.k + 1, coalesce(c.m[2], 0), n FROM g JOIN t USING (doc_id, text) LEFT JOIN c ON c.doc_id = g.doc_id AND c.text = g.text AND c.i = g.i WHERE g.i <= len(t.x)),
f AS (SELECT doc_id, text, list(id ORDER BY k) AS f FROM g WHERE k > 0 GROUP BY ALL),
q AS (SELECT doc_id, text, r, name, a, a + len(seq) - 1 AS b FROM (SELECT *, unnest(range(1, len(f) + 1)) AS a FROM f) JOIN rules ON f[a:a + len(seq) - 1] = seq),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY r, a) AS u FROM q),
z AS (SELECT doc_id, text, 0 AS u, []::BIGINT[] AS used, []::VARCHAR[] AS names FROM f UNION ALL
  SELECT z.doc_id, z.text, o.u, CASE WHEN list_has_any(used, range(a, b + 1)) THEN used ELSE used || range(a, b + 1) END, CASE WHEN list_has_any(used, range(a, b + 1)) THEN names ELSE names || [name] END FROM z JOIN o ON o.doc_id = z.doc_id AND o.text = z.text AND o.u = z.u + 1),
y AS (SELECT doc_id, text, max_by(names, u) AS names FROM z GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(len([x FOR x IN f.f IF x > 0]), 0) AS INTEGER) AS n_known, array_to_string(list_sort(list_distinct(coalesce(y.names, []))), ',') AS licenses, CAST(coalesce(len(y.names), 0) AS INTEGER) AS n_matches
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND f.text = d.text LEFT JOIN y ON y.doc_id = d.doc_id AND y.text = d.text"""

#: All pairs of different lines whose lengths are near; a line with a word may differ in one of twenty characters, in two at most.
LINES = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(x))) AS k, unnest(x) AS line FROM t),
f AS (SELECT line, min(row(doc_id, k)) AS f FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY line),
near AS (SELECT DISTINCT a.line, true AS near FROM f a JOIN f b ON length(b.line) BETWEEN length(a.line) - 2 AND length(a.line) + 2 AND b.f < a.f WHERE length(a.line) >= 20 AND length(b.line) >= 20 AND levenshtein(a.line, b.line) <= least(2, length(a.line) // 20, length(b.line) // 20)),
v AS (SELECT doc_id, k, line, coalesce(near OR row(doc_id, k) <> f, false) AS gone FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line))
SELECT d.doc_id, CAST(count(v.k) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed, CASE WHEN any_value(d.text) IS NOT NULL THEN md5(coalesce(string_agg(v.line, chr(10) ORDER BY v.k) FILTER (NOT gone), '')) END AS kept_md5
FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id"""

_AT = lambda k: f"('c' || (turn + {k}))"
_NUMBER_AT = lambda k: f"('0x' || h[{k}])::INT"
_ANSWER = lambda when, move, to, content: f"""SELECT conv_id, turn + {move} AS turn, 'tool' AS role, '{{"content":"' || h[{content}:{content + 7}] || '","role":"tool","tool_call_id":"' || {to} || '"}}' AS message, NULL AS id, NULL AS name, NULL AS good, NULL AS waits, {to} AS answers FROM k WHERE {when}"""
#: Calls and results as the query derives them; first ones, links, what stands behind what by walking all ways, circles by
#: what reaches itself, and each conversation's messages in order.
CHATS = f"""
WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn, role, text, md5(conv_id || ':' || turn) AS h FROM conversations),
k AS (SELECT *, CASE WHEN h[2] < 'a' THEN 'search' WHEN h[2] < 'e' THEN 'total' ELSE 'forecast' END AS name FROM c WHERE role = 'assistant' AND h[1] < '8'),
m AS (SELECT conv_id, turn, role, '{{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, '')) AS VARCHAR) || '}}' AS message, NULL AS id, NULL AS name, NULL AS good, NULL AS waits, NULL AS answers FROM c WHERE (role = 'assistant' AND h[1] < '8') IS NOT TRUE
UNION SELECT conv_id, turn, role, '{{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":"assistant","tool_calls":[{{"arguments":{{' ||
  CASE WHEN name = 'search' THEN '"limit":' || {_NUMBER_AT(3)} || ',"query":"' || h[1:8] || '"' WHEN h[4] < 'c' THEN '"a":' || {_NUMBER_AT(3)} || ',"b":' || {_NUMBER_AT(4)} ELSE '"a":' || {_NUMBER_AT(3)} END || '}},"id":"' || {_AT(0)} || '","name":"' || name || '"}}]}}',
  {_AT(0)}, name, CASE name WHEN 'search' THEN h[3] < 'c' WHEN 'total' THEN h[4] < 'c' END, [x FOR x IN [CASE WHEN h[5] < '8' THEN {_AT(-2)} END, CASE WHEN h[6] >= 'c' THEN {_AT(2)} END] IF x IS NOT NULL], NULL FROM k
UNION {_ANSWER("h[7] < 'c'", 0, _AT(0), 9)} UNION {_ANSWER("h[7] IN ('c', 'd')", -1, _AT(0), 9)} UNION {_ANSWER("h[7] = 'f'", 0, _AT(0), 9)} UNION {_ANSWER("h[7] = 'f'", 1, _AT(0), 17)} UNION {_ANSWER("h[8] = '0'", 0, "('x' || turn)", 9)}),
n AS (SELECT *, row(turn, md5(message)) AS p FROM m),
calls AS (SELECT conv_id, id, min(p) AS called FROM n WHERE id IS NOT NULL GROUP BY ALL),
results AS (SELECT conv_id, answers AS id, min(p) AS p FROM n WHERE answers IS NOT NULL GROUP BY ALL),
linked AS (SELECT * FROM results JOIN calls USING (conv_id, id)),
edges AS (SELECT conv_id, p, called AS o FROM linked UNION SELECT w.conv_id, w.p, l.p FROM (SELECT conv_id, p, unnest(waits) AS id FROM n) w JOIN linked l USING (conv_id, id)),
reach AS (SELECT conv_id, p, o FROM edges UNION SELECT r.conv_id, r.p, e.o FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.p = r.o),
circle AS (SELECT DISTINCT r.conv_id, r.p FROM reach r JOIN reach s ON s.conv_id = r.conv_id AND s.p = r.o WHERE s.p = s.o),
walk AS (SELECT conv_id, p, p[1] AS t, 0 AS l FROM n UNION SELECT w.conv_id, e.p, w.t, w.l + 1 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.o = w.p WHERE NOT EXISTS (SELECT 1 FROM circle c WHERE c.conv_id = e.conv_id AND c.p = e.p)),
place AS (SELECT conv_id, p, max(row(t, l)) AS stand FROM walk GROUP BY ALL),
f AS (SELECT n.*, x.p IS NOT NULL AS linked, n.answers IS NOT NULL AND x.p IS NULL AS out, y.p IS NOT NULL AS cyclic, row_number() OVER (PARTITION BY n.conv_id ORDER BY stand, n.p[2]) - 1 AS position
FROM n JOIN place USING (conv_id, p) LEFT JOIN linked x ON x.conv_id = n.conv_id AND x.p = n.p LEFT JOIN circle y ON y.conv_id = n.conv_id AND y.p = n.p)
SELECT conv_id, CAST(position // 1024 AS INTEGER) AS part, count(*) FILTER (NOT out) AS n_messages, count(id) AS n_calls, count(*) FILTER (linked) AS n_linked, count(*) FILTER (name = 'forecast') AS n_unknown, count(*) FILTER (NOT good) AS n_invalid, count(*) FILTER (out) AS n_left_out, bool_or(cyclic) AS cyclic,
  '[' || coalesce(string_agg(message, ',' ORDER BY position) FILTER (NOT out), '') || ']' AS chat FROM f GROUP BY conv_id, position // 1024"""

#: Every window of the size of an item that starts at a shared shingle or ends with the document.
LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m, [array_to_string(w[p:p + least(len(w), 5) - 1], ' ') FOR p IN range(1, len(w) - least(len(w), 5) + 2)] AS s FROM b WHERE len(w) > 0),
c AS (SELECT item_id, k, m, g, count(*) AS c FROM (SELECT item_id, k, m, unnest(s) AS g FROM i) GROUP BY ALL),
g AS (SELECT doc_id, k, n, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, len(w) - k + 1 AS n, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, n, m, p, g, c FROM g JOIN c USING (k, g)),
t AS (SELECT DISTINCT doc_id, item_id, n, m, greatest(1, least(p, n - m + 1)) AS q FROM h),
o AS (SELECT doc_id, item_id, n, m, q, sum(least(x, c)) AS k FROM (SELECT t.doc_id, t.item_id, t.n, t.m, q, g, c, count(*) AS x FROM t JOIN h ON h.doc_id = t.doc_id AND h.item_id = t.item_id AND h.p >= q AND h.p < q + t.m GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, round(max(CAST(k AS DOUBLE) / (m + least(n, m) - k)), 6) AS similarity FROM o WHERE 100 * k >= 75 * (m + least(n, m) - k) GROUP BY doc_id, item_id"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of a column of ASCII text, bit by bit."""
    bits = f"flatten([[(ascii(c) >> k) & 1 FOR k IN range(8)] FOR c IN string_split({text}, '')])"
    return f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1))), 4294967295)"


def _levels(start: str, name: str, depth: int) -> str:
    """Nodes (g, i, n, h) of a tree of eights, level by level, each with the list of its run."""
    parts = [f"{name}0 AS ({start})"]
    for k in range(depth):
        parts.append(f"{name}r{k} AS (SELECT g, i // 8 AS p, list(h ORDER BY i) AS run FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        parts.append(f"{name}{k + 1} AS (SELECT g, i, n, h FROM {name}{k} WHERE n = 1 UNION ALL SELECT g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {name}{k} WHERE n > 1 GROUP BY g, i // 8, n)")
    return ", ".join(parts)


def _climbed(start: str, name: str, depth: int, of: str) -> str:
    """start (g, i, h, proof, ...) carried up: at each level the node's place in its run is left to the folded digest."""
    out = start
    for k in range(depth):
        left, right = "array_to_string(run[1:i % 8], '')", "array_to_string(run[i % 8 + 2:], '')"
        out = f"SELECT u.* REPLACE (u.i // 8 AS i, CASE WHEN run IS NULL THEN h ELSE sha256({left} || h || {right}) END AS h, CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof) FROM ({out}) u LEFT JOIN {name}r{k} r ON r.g = u.{of} AND r.p = u.i // 8"
    return out


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
#: Up to 8^7 documents and 8^3 languages.
MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce('.' || lang, '') AS g, {_LEAF('text')} AS leaf,
  {_LEAF("(CASE WHEN " + _crc32("CAST(doc_id AS VARCHAR)") + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)")} AS shown FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_levels("SELECT g, i, n, leaf AS h FROM e", "l", 7)},
{_levels("SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, h FROM l7", "t", 3)},
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS ord FROM l7),
a AS ({_climbed("SELECT doc_id, g, leaf, i, shown AS h, '' AS proof FROM e", "l", 7, "g")}),
b AS ({_climbed("SELECT doc_id, leaf, subroot, '' AS whole, ord AS i, h, proof FROM a JOIN s USING (g)", "t", 3, "whole")})
SELECT doc_id, leaf, subroot, t3.h AS root, sha256(proof) AS proof_sha256, b.h AS folded_root, b.h = t3.h AS verified FROM b, t3"""

#: The DP row by row with whole edit strings, runs of up to two inserts before any edit.
REPAIRS = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS c FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) FROM c WHERE c <> 0),
o AS (SELECT *, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS two FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
edits AS (SELECT k, op FROM (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest(['D', 'K', 'R']) AS op)),
d AS (SELECT conv_id, 0 AS i, '' AS st, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM n
  UNION ALL SELECT conv_id, i, st, cost, audit, said FROM (
    SELECT conv_id, i, CASE op WHEN 'D' THEN m WHEN 'K' THEN x ELSE nx END AS st, cost + 5 * k + CASE op WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost,
      audit || repeat('I', k) || op AS audit, said || CASE WHEN k = 0 THEN [] WHEN k = 1 AND st = 'u' THEN ['assistant:'] WHEN k = 1 THEN ['user:'] WHEN st = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END
      || CASE op WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN nx = 'u' THEN 'user:' ELSE 'assistant:' END || text] END AS said
    FROM (SELECT d.conv_id, r.i, d.st, d.cost, d.audit, d.said, r.x, r.role, r.text, r.fault, k, op, CASE WHEN k = 0 THEN d.st WHEN (d.st = 'u') = (k = 2) THEN 'u' ELSE 'a' END AS m, CASE WHEN (CASE WHEN k = 0 THEN d.st WHEN (d.st = 'u') = (k = 2) THEN 'u' ELSE 'a' END) = 'u' THEN 'a' ELSE 'u' END AS nx
      FROM d JOIN f r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1, edits)
    WHERE op = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR (x = 's' AND m = '') OR (x IN ('u', 'a') AND x = nx)))
    QUALIFY row_number() OVER (PARTITION BY conv_id, CASE op WHEN 'D' THEN m WHEN 'K' THEN x ELSE nx END ORDER BY cost + 5 * k + CASE op WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, audit || repeat('I', k) || op) = 1)),
z AS (SELECT d.conv_id, cost + CASE st WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END AS cost, audit || CASE st WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit, said || CASE st WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END AS said
  FROM d JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.n = d.i QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY cost + CASE st WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END, audit || CASE st WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END) = 1),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""
