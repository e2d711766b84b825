"""DuckDB SQL for the queries that SQL can express."""

import re

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
shown AS (
  SELECT *, contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR contains(role, '<|im_start|>') OR contains(role, '<|im_end|>')
            OR ends_with(role, '<|esc|>') OR contains(role, chr(10)) AS clash FROM turns),
sized AS (
  SELECT *, 12 + 1 + 11 + CASE WHEN clash THEN 7 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
                          ELSE length(role) + length(text) END AS chars FROM shown)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, true AS round_trip
FROM sized GROUP BY conv_id
"""

OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

OP5 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

OP8 = r"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""

#: ``w(key, cost, letter)`` is written out by ``walked``: cost added to the first 12 digits, letter appended.
OP13 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(regexp_extract_all(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '.'), lambda c: ord(c)::BIGINT) AS bytes FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS nth FROM hashed),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, nth) AS copy FROM damaged),
numbered AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS inked
  FROM ordered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (
  SELECT *, CASE WHEN inked = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(inked, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(before || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM numbered),
sizes AS (SELECT conv_id, count(*) AS n FROM faults GROUP BY conv_id),
-- A standing is its cost in 12 digits, then the audit: least() of such texts is least cost, then first audit.
-- What is after a turn: s0 start, s1 system, s2 user, s3 assistant; repaired texts go along.
walk AS (
  SELECT c.conv_id, 0::BIGINT AS i, {'k': '000000000000', 'r': []::VARCHAR[]} AS s0, {'k': '500000000000', 'r': []::VARCHAR[]} AS s1, {'k': '000000000005I', 'r': ['user:']} AS s2, {'k': '000000000010II', 'r': ['user:', 'assistant:']} AS s3
  FROM (SELECT DISTINCT conv_id FROM faults) c
  UNION ALL
  SELECT conv_id, i, s0, s1, u AS s2, list_min([s3, {'k': w(u.k, 5, 'I'), 'r': list_append(u.r, 'assistant:')}]) AS s3 FROM (
    SELECT conv_id, i, s0, s1, s3, list_min([s2, {'k': w(s0.k, 5, 'I'), 'r': list_append(s0.r, 'user:')}, {'k': w(s1.k, 5, 'I'), 'r': list_append(s1.r, 'user:')}, {'k': w(s3.k, 5, 'I'), 'r': list_append(s3.r, 'user:')}]) AS u FROM (
      SELECT p.conv_id, f.i, {'k': w(s0.k, 2, 'D'), 'r': s0.r} AS s0,
        list_min(list_filter([{'k': w(s1.k, 2, 'D'), 'r': s1.r}, CASE WHEN stays AND role[1] = 's' THEN {'k': w(s0.k, extra, 'K'), 'r': list_append(s0.r, role || ':' || text)} END], lambda x: x IS NOT NULL)) AS s1,
        list_min(list_filter([{'k': w(s2.k, 2, 'D'), 'r': s2.r}, CASE WHEN stays AND role[1] = 'u' THEN {'k': w(ready.k, extra, 'K'), 'r': list_append(ready.r, role || ':' || text)} WHEN stays THEN {'k': w(ready.k, extra + 1, 'R'), 'r': list_append(ready.r, 'user:' || text)} END], lambda x: x IS NOT NULL)) AS s2,
        list_min(list_filter([{'k': w(s3.k, 2, 'D'), 'r': s3.r}, CASE WHEN stays AND role[1] = 'a' THEN {'k': w(s2.k, extra, 'K'), 'r': list_append(s2.r, role || ':' || text)} WHEN stays THEN {'k': w(s2.k, extra + 1, 'R'), 'r': list_append(s2.r, 'assistant:' || text)} END], lambda x: x IS NOT NULL)) AS s3
      FROM (SELECT conv_id, i, s0, s1, s2, s3, list_min([s0, s1, s3]) AS ready FROM walk) p JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM faults) f
        ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1) q) z),
best AS (SELECT walk.conv_id, list_min([s0, s3]) AS b FROM walk JOIN sizes ON walk.conv_id IS NOT DISTINCT FROM sizes.conv_id AND walk.i = sizes.n),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.k[:12]::BIGINT, 0)::BIGINT AS cost, coalesce(b.k[13:], '') AS audit, sha256(coalesce(array_to_string(b.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def walked(sql: str) -> str:
    return re.sub(r"\bw\(([\w.]+), ([\w +]+), ('\w')\)", r"lpad((\1[:12]::BIGINT + \2)::VARCHAR, 12, '0') || \1[13:] || \3", sql)


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op2_minhash_near_dedup": OP2, "op5_exact_top_k": OP5, "op8_warc": OP8, "op13_conversation_repair": walked(OP13)}
