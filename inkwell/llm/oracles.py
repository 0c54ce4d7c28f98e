"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LINES = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM docs),
lines AS (
  SELECT doc_id, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS h
  FROM raw WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0),
starts AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines),
runs AS (
  SELECT doc_id, pos, start, max(start + n) OVER w - start >= 50 AS complete, list(h) OVER w AS run, list(pos) OVER w AS ats
  FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
nexts AS (SELECT *, lead(run) OVER (PARTITION BY doc_id ORDER BY pos) AS next_run, lead(ats) OVER (PARTITION BY doc_id ORDER BY pos) AS next_at FROM runs),
passages AS (
  SELECT doc_id, pos, len(run) AS n, run || coalesce(next_run[len(run):], []) AS run, ats || coalesce(next_at[len(run):], []) AS ats
  FROM nexts WHERE complete),
longer AS (SELECT doc_id, pos, run[1:k] AS run, ats[k] AS last FROM (SELECT *, unnest(range(n, len(run) + 1)) AS k FROM passages)),
firsts AS (SELECT run, min((doc_id, pos)) AS place FROM longer GROUP BY run HAVING count(*) > 1),
spans AS (SELECT l.doc_id, l.pos AS a, max(l.last) AS b FROM longer l JOIN firsts f ON l.run = f.run WHERE (l.doc_id, l.pos) > f.place GROUP BY l.doc_id, l.pos),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM spans),
left_over AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text FROM raw r
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = r.doc_id AND g.pos = r.pos) GROUP BY r.doc_id),
counts AS (SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id)
"""

ORACLES = {
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT x.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.component_id, x.vec_id) AS component_id, x.vec_id = coalesce(c.component_id, x.vec_id) AS kept
FROM embeddings x LEFT JOIN classes c ON c.a = x.vec_id LEFT JOIN degrees d ON d.a = x.vec_id
""",
    "op9_line_dedup": _LINES
    + """
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(c.k, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN left_over l ON l.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id
""",
    "op6_jump_sharding": """
WITH RECURSIVE walk(doc_id, k, b, grown, j) AS (
  SELECT DISTINCT doc_id, coalesce(doc_id, 0)::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END, -1::BIGINT, -1::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, k2, CASE WHEN j < 16 THEN j ELSE b END, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, ((k % 4294967296) * 2862933555777941757 + ((k // 4294967296) * 2862933555777941757 % 4294967296) * 4294967296 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < 17)),
ends AS (SELECT doc_id, max(b)::INT AS shard, max(grown)::INT AS grown_shard FROM walk GROUP BY doc_id),
tab AS (
  SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
  FROM (SELECT range AS i FROM range(256))),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, n + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda y: ('0x' || y)::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM raw, tab)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(s.doc_id::VARCHAR, 'null:' || text_crc32 || ':' || size)), text_crc32, size) - 1 AS slot, grown_shard
FROM sums s JOIN ends e ON s.doc_id IS NOT DISTINCT FROM e.doc_id
""",
    "op10_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))) AS m FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s0),
s2 AS (
  SELECT *, source_size * 2 AS cap, (SELECT sum(source_size) FROM s0)::DOUBLE * 1.5::DOUBLE AS total, (SELECT sum(w) FROM s1) AS ws,
         coalesce(sum(source_size * 2) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM s1 WINDOW o AS (ORDER BY (source_size * 2)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap::DOUBLE / w < (total - cap_before::DOUBLE) / (ws - w_before)::DOUBLE AS capped FROM s2),
s4 AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
    ELSE (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)::DOUBLE) / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE * w END AS target FROM s3),
house AS (SELECT round(sum(source_size)::DOUBLE * 1.5::DOUBLE / 8)::BIGINT AS n FROM s4),
seats AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * i - 1) DESC, coalesce('s' || source, 'n'), i) AS rank
  FROM (SELECT source, target, unnest(range(1, ceil(target / 8)::BIGINT + 3)) AS i FROM s4 WHERE target > 0)),
won AS (SELECT source, count(*) AS blocks FROM seats WHERE rank <= (SELECT n FROM house) GROUP BY source),
st AS (
  SELECT source, ('0x' || substr(m, 17, 8))::BIGINT % 4 AS shard, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
st_seats AS (
  SELECT x.source, shard, blocks, row_number() OVER (PARTITION BY x.source ORDER BY words::DOUBLE / (2 * i - 1) DESC, shard, i) AS rank
  FROM (SELECT st.source, shard, words, blocks, unnest(range(1, (blocks + 1)::BIGINT)) AS i FROM st JOIN won ON st.source IS NOT DISTINCT FROM won.source WHERE words > 0) x),
st_won AS (SELECT source, shard, count(*) AS q FROM st_seats WHERE rank <= blocks GROUP BY source, shard),
quota AS (
  SELECT st.source, st.shard, words, least(coalesce(q, 0), words * 2 // 8) * 8 AS quota
  FROM st LEFT JOIN st_won ON st.source IS NOT DISTINCT FROM st_won.source AND st.shard = st_won.shard),
placed AS (
  SELECT d.doc_id, d.source, d.size, ('0x' || substr(m, 17, 8))::BIGINT % 4 AS shard,
         coalesce(sum(size) OVER (PARTITION BY source, ('0x' || substr(m, 17, 8))::BIGINT % 4 ORDER BY substr(m, 1, 16), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
  FROM d)
SELECT p.doc_id, p.size, s4.source_size, s4.target,
       (CASE WHEN words = 0 THEN 0 ELSE quota // words * p.size + greatest(0, least(pre + p.size, quota % words) - pre) END)::BIGINT AS taken
FROM placed p JOIN quota q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source
""",
}
