"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

WORD = r"[^ \t\n\v\f\r]+"

ORACLE = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS words FROM documents),
e AS (SELECT doc_id, words, len(words) AS n FROM w),
p AS (SELECT doc_id, words, unnest(range(1, n - 48)) AS i FROM e WHERE n >= 50),
v AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
d AS (SELECT doc_id, i FROM v JOIN f USING (h) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM d, (SELECT unnest(range(0, 50)) AS o)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n + 1)) AS pos FROM e),
kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.pos) AS t, count(*) AS k
         FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.pos = each.pos WHERE gone.pos IS NULL GROUP BY 1)
SELECT e.doc_id, n AS n_words, n - COALESCE(k, 0) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
FROM e LEFT JOIN kept ON kept.doc_id = e.doc_id
""",
    "op8_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS words FROM documents),
e AS (SELECT doc_id, words, len(words) AS n FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, n - 3)) AS i FROM e WHERE n >= 5)
      UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM e WHERE n BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.k + y.k - both_)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.label FROM r JOIN g ON g.a = r.node WHERE r.label < g.b),
m AS (SELECT node, min(label) AS component_id FROM r GROUP BY node)
SELECT e.doc_id, COALESCE(c.k, 0) AS n_shingles, component_id, e.doc_id = component_id AS kept
FROM e JOIN m ON m.node = e.doc_id LEFT JOIN c ON c.doc_id = e.doc_id
""",
    "op12_periodic_runs": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS words FROM documents),
c AS (SELECT doc_id, words, len(words)::BIGINT AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)::BIGINT AS h FROM w),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM c),
f AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM g),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(0, n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS x FROM f),
lags AS (SELECT doc_id, n, x, unnest(range(1, n // 4 + 1)) AS q FROM d),
likely AS MATERIALIZED (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, x, q, unnest(range(0, n - 3 * q, q)) AS i FROM lags) WHERE x[i + 1] = x[i + q + 1] AND x[i + 1] = x[i + 2 * q + 1] AND x[i + 1] = x[i + 3 * q + 1]),
same AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island
         FROM (SELECT doc_id, q, x, unnest(range(0, n - q)) AS i FROM likely JOIN d USING (doc_id)) WHERE x[i + 1] = x[i + q + 1]),
long AS (SELECT doc_id, q AS period, min(i) AS start, count(*) + q AS length FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM long s WHERE s.doc_id = l.doc_id AND s.start = l.start AND s.length = l.length AND s.period < l.period)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS r FROM runs),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_ AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t FROM (SELECT doc_id, unnest(x) AS word, unnest(range(0, n)) AS i FROM d) e
          LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, COALESCE(told.n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(COALESCE(told.t, '')) AS runs_sha256, sha256(COALESCE(left_.t, '')) AS collapsed_sha256
FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id AND r = 1 LEFT JOIN left_ ON left_.doc_id = d.doc_id
""",
    "op13_line_dedup": rf"""
WITH l AS (SELECT doc_id, COALESCE(text, '') AS t, unnest(string_split(COALESCE(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(COALESCE(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
j AS (SELECT k.doc_id, i, line, least IS NOT NULL AND least < k.doc_id AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
}


def _rounds() -> str:
    """Ten rounds, each a step of common tables: components joined with centroids, the nearest, floors of means."""
    steps = [f"""WITH own AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, list_transform(v, lambda x: x::BIGINT) AS v FROM own),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS w FROM e ORDER BY sha256('3:' || vec_id) LIMIT 8)"""]
    for r in range(11):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT k, arg_min(c, [d, c]) AS c, min(d) AS d FROM (
 SELECT k, c, list_sum(list_transform(list_zip(v, w), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::BIGINT))::BIGINT AS d FROM e, c{r}) GROUP BY k)""")
        if r < 10:
            steps.append(f"""m{r} AS (SELECT c, list(CASE WHEN s % n < 0 THEN (s - (s % n) - n) // n ELSE (s - s % n) // n END::BIGINT ORDER BY i) AS w
 FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range(0, 64)) AS i FROM a{r} JOIN e USING (k)) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, COALESCE(m.w, o.w) AS w FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return ",\n".join(steps) + """
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (c) JOIN e USING (k)"""


ORACLE["op11_centroids"] = _rounds()
