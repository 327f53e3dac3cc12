"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
hashed AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM win),
least AS (SELECT s, min(doc_id) AS m FROM hashed GROUP BY s),
dup AS (SELECT rid, i FROM hashed JOIN least USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS j FROM dup),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP9 = """
WITH raw AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM raw),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6 = """
WITH t AS (SELECT floor(conv_id / 2)::BIGINT AS pair_id, conv_id % 2 <> 0 AS side, coalesce(turn, -1) AS turn,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT pair_id, turn, list({'r': role, 't': text} ORDER BY role, text) FILTER (WHERE side) AS a,
             list({'r': role, 't': text} ORDER BY role, text) FILTER (WHERE NOT side) AS b FROM t GROUP BY ALL),
s AS (SELECT pair_id, min(turn) AS split FROM g WHERE a IS DISTINCT FROM b GROUP BY pair_id),
m AS (SELECT t.*, split IS NULL OR turn < split AS common FROM t LEFT JOIN s USING (pair_id))
SELECT pair_id, CASE WHEN common THEN 'prompt' WHEN side THEN 'rejected' ELSE 'chosen' END AS part, turn, role,
       '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
       NOT common AND role = 'assistant' AS train
FROM m WHERE NOT (common AND side)
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT x, y, c, nx.n AS nx, ny.n AS ny FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y),
linked AS (SELECT x, y FROM pairs WHERE 5 * c >= 4 * (nx + ny - c)),
sides AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(a, b) AS (SELECT x, y FROM sides UNION SELECT r.a, s.y FROM reach r JOIN sides s ON r.b = s.x),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
copies AS (SELECT y, min(x) AS m FROM pairs WHERE c = nx AND c = ny GROUP BY y),
links AS (SELECT x, count(*) AS k FROM sides GROUP BY x)
SELECT d.doc_id, coalesce(comp.c, d.doc_id) AS class_id, coalesce(copies.m, d.doc_id) AS copy_id, coalesce(links.k, 0) AS n_links
FROM d LEFT JOIN comp ON comp.a = d.doc_id LEFT JOIN copies ON copies.y = d.doc_id LEFT JOIN links ON links.x = d.doc_id
"""

# crc32 by its table; a turn's edits are paths through the grammar's states (0 nothing read, 1 s, 2 u, 3 a), row by row: up to
# two insertions, then the edit of the turn; of each state the cheapest path with the least audit goes on
OP11 = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
            lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS k
        FROM conversations, tab),
hurt AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM src WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
         coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c, 'su') AS two FROM placed),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM seen),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
      count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
      count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
        (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
        (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])) v(p, q, cost, audit, lines)),
edit AS (SELECT f.conv_id, f.i, e.* FROM f, LATERAL (
         SELECT s.s AS p, s.s AS q, 3 AS cost, 'D' AS audit, []::VARCHAR[] AS line FROM range(4) s(s)
         UNION ALL SELECT m.p, m.q, (f.fault = 't')::INT, 'K', [f.role || ':' || f.text] FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'),
             (3, 2, 'u'), (2, 3, 'a')) m(p, q, x) WHERE f.fault NOT IN ('b', 'd') AND f.c = m.x
         UNION ALL SELECT m.p, m.q, 2 + (f.fault = 't')::INT, 'R', [m.x || ':' || f.text] FROM (VALUES (0, 2, 'user'), (1, 2, 'user'),
             (3, 2, 'user'), (2, 3, 'assistant')) m(p, q, x) WHERE f.fault NOT IN ('b', 'd')) e),
path AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM c
         UNION ALL
         SELECT path.conv_id, path.i + 1, edit.q, min({'cost': path.best.cost + ins.cost + edit.cost,
                'audit': path.best.audit || ins.audit || edit.audit, 'lines': path.best.lines || ins.lines || edit.line})
         FROM path JOIN ins ON ins.p = path.state JOIN edit ON edit.conv_id IS NOT DISTINCT FROM path.conv_id AND edit.i = path.i + 1 AND edit.p = ins.q
         GROUP BY path.conv_id, path.i, edit.q),
done AS (SELECT path.conv_id, min({'cost': path.best.cost + ins.cost, 'audit': path.best.audit || ins.audit,
                'lines': path.best.lines || ins.lines}) AS best
         FROM path JOIN c ON c.conv_id IS NOT DISTINCT FROM path.conv_id AND path.i = c.n JOIN ins ON ins.p = path.state
         WHERE ins.q = 3 OR (ins.p = 0 AND ins.q = 0) GROUP BY path.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""
