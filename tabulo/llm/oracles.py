"""DuckDB SQL of the training-data queries that SQL can express."""

#: base32 digits come from runs of ten hexadecimal digits, which are eight of base 32
OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(x, (1 + 10 * (k // 8))::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM d"""

#: crc32 from its table of 256 entries, made bit by bit
OP12 = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)),
           lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
fields AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, text,
         list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')) AS head,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 2 = 0 AS tampered
  FROM documents CROSS JOIN crc),
leaves AS (
  SELECT doc_id, g, sha256(array_to_string(head, '') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS changed, head
  FROM fields),
placed AS (
  SELECT doc_id, g, leaf, sha256(array_to_string(head, '') || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS changed_leaf,
         row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM leaves),
tree AS (
  SELECT g, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT g, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, level, i // 3),
subroots AS (SELECT g, level AS height, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 3),
steps AS (
  SELECT p.doc_id, t.level AS step, string_agg(CASE WHEN t.i < p.i // (3 ** t.level)::BIGINT THEN t.h END, '' ORDER BY t.i) AS l,
         string_agg(CASE WHEN t.i > p.i // (3 ** t.level)::BIGINT THEN t.h END, '' ORDER BY t.i) AS r
  FROM placed p JOIN tree t ON t.g = p.g AND t.n > 1 AND t.i // 3 = p.i // (3 ** (t.level + 1))::BIGINT
  GROUP BY p.doc_id, t.level
  UNION ALL
  SELECT p.doc_id, s.height + u.level, string_agg(CASE WHEN u.i < s.i // (3 ** u.level)::BIGINT THEN u.h END, '' ORDER BY u.i),
         string_agg(CASE WHEN u.i > s.i // (3 ** u.level)::BIGINT THEN u.h END, '' ORDER BY u.i)
  FROM placed p JOIN subroots s ON s.g = p.g JOIN upper u ON u.n > 1 AND u.i // 3 = s.i // (3 ** (u.level + 1))::BIGINT
  GROUP BY p.doc_id, s.height, u.level),
folded AS (
  SELECT doc_id, 0 AS step, changed_leaf AS h FROM placed
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')) FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step),
proofs AS (SELECT doc_id, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM folded GROUP BY doc_id),
root AS (SELECT h FROM upper WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root, coalesce(x.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.h AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN ends e ON e.doc_id = p.doc_id LEFT JOIN proofs x ON x.doc_id = p.doc_id CROSS JOIN root"""
