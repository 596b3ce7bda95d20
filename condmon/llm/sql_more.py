"""SQL of the operators on conversations, phrases and archives."""

from __future__ import annotations


def _edited(cell: str, cost: str, letter: str) -> str:
    """SQL of a cell, nine digits of cost and the letters, after one more edit."""
    return f"lpad((CAST({cell}[1:9] AS INT) + {cost})::VARCHAR, 9, '0') || {cell}[10:] || {letter}"


def _after_row(cells: dict[str, str]) -> dict[str, str]:
    deleted = {x: _edited(c, "3", "'D'") for x, c in cells.items()}
    go = lambda x, role: f"CASE WHEN NOT must THEN {_edited(cells[x], f'late + CASE WHEN i = {role!r} THEN 0 ELSE 2 END', f'CASE WHEN i = {role!r} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')} END"
    kept = f"CASE WHEN NOT must AND i = 's' THEN {_edited(cells['b'], 'late', chr(39) + 'K' + chr(39))} END"
    return {"b": deleted["b"], "s": f"least({deleted['s']}, {kept})", "u": f"least({deleted['u']}, {go('b', 'u')}, {go('s', 'u')}, {go('a', 'u')})", "a": f"least({deleted['a']}, {go('u', 'a')})"}


_INSERT = {x: _edited(x, "2", "'I'") for x in "bsua"}
_STEP = ", ".join(f"{sql} AS {x}" for x, sql in _after_row({x: f"w.{x}" for x in "bsua"}).items())

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, x::BIGINT)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda j: ascii(substr(name, j, 1))::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM src, tab),
dmg AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dmg),
flt AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
               left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM num),
stp AS (SELECT *, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::INT AS late FROM flt),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM stp GROUP BY 1),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, '000000000' AS b, NULL::VARCHAR AS s, '000000002I' AS u, '000000004II' AS a FROM sums
  UNION ALL
  SELECT conv_id, k, b, s, u, least(a, {_INSERT['u']}) AS a FROM (
    SELECT conv_id, k, b, s, least(u, {_INSERT['b']}, {_INSERT['s']}, {_INSERT['a']}) AS u, a FROM (
      SELECT w.conv_id, w.k + 1 AS k, {_STEP} FROM walk w JOIN stp r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1))),
best AS (SELECT w.conv_id, least(b, a) AS cell FROM walk w JOIN sums ON sums.conv_id IS NOT DISTINCT FROM w.conv_id AND k = n),
lets AS (SELECT conv_id, unnest(string_split(cell[10:], '')) AS letter, unnest(range(length(cell) - 9)) AS place FROM best WHERE length(cell) > 9),
alg AS (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY place) AS k FROM lets),
got AS (SELECT g.conv_id, g.place, letter, role, text, i, row_number() OVER (PARTITION BY g.conv_id ORDER BY g.place) - 1 AS e
        FROM alg g LEFT JOIN stp r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.k = g.k AND letter <> 'I' WHERE letter <> 'D'),
sys AS (SELECT *, max((e = 0 AND letter = 'K' AND i = 's')::INT) OVER (PARTITION BY conv_id) AS has_s FROM got),
rep AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - has_s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY e)) AS repaired_sha256 FROM sys GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cell[1:9]::BIGINT, 0) AS cost, coalesce(cell[10:], '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM o.conv_id"""

ARCHIVES = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, max(page_id) OVER (PARTITION BY t) AS largest,
             list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::BIGINT) AS parts FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM d"""

PHRASES = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece, unnest(range(len(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')))) AS no FROM d),
q AS (SELECT id, no, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM q GROUP BY 1),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda j: array_to_string(ws[j:j + m - 1], ' '))) AS phrase FROM q, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, c.a, c.ws, k, h.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (h.f::HUGEINT * r.f) AS score
      FROM c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:c.m], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > b.m AND 100 * f.f >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x) WHERE rank <= 2000"""
