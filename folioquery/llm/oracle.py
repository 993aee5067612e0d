"""SQL counterparts of the operators' queries, where SQL can express them."""

ORACLE: dict[str, str] = {}

ORACLE["op4_lines"] = """
WITH lines AS (
  SELECT doc_id, g.pos, string_split(text, chr(10))[g.pos + 1] AS line
  FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS pos) g),
grams AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
    FROM grams WHERE c IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)),
marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS dead,
         l2.pos IS NOT NULL AND l1.pos IS NULL AND l3.pos IS NULL AND l4.pos IS NULL AS opens
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
  LEFT JOIN later l2 ON l.doc_id = l2.doc_id AND l.pos = l2.pos
  LEFT JOIN later l1 ON l.doc_id = l1.doc_id AND l.pos = l1.pos + 1
  LEFT JOIN later l3 ON l.doc_id = l3.doc_id AND l.pos = l3.pos + 2
  LEFT JOIN later l4 ON l.doc_id = l4.doc_id AND l.pos = l4.pos + 3)
SELECT d.doc_id, count(m.pos) AS n_lines, count(*) FILTER (WHERE m.dead) AS n_removed,
       count(*) FILTER (WHERE m.opens) AS n_runs,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.dead), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""

ORACLE["op4_passages"] = """
WITH lines AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^ \\t\\n\\r]+')) AS n FROM (
    SELECT doc_id, g.pos, string_split(text, chr(10))[g.pos + 1] AS line
    FROM documents, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS pos) g)),
grams AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, n, n + lead(n, 1) OVER w AS n2
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos, 3 AS size FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
    FROM grams WHERE c IS NOT NULL) WHERE nth > 1
  UNION ALL
  SELECT doc_id, pos, 2 FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, pos) AS nth
    FROM grams WHERE b IS NOT NULL AND n2 >= 50) WHERE nth > 1
  UNION ALL
  SELECT doc_id, pos, 1 FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a ORDER BY doc_id, pos) AS nth
    FROM grams WHERE n >= 50) WHERE nth > 1),
starts AS (
  SELECT doc_id, pos, max(pos + max(size)) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM later GROUP BY doc_id, pos),
runs AS (SELECT doc_id, count(*) AS n_runs FROM starts WHERE reach IS NULL OR pos > reach GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k) WHERE k < size),
marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS dead
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT d.doc_id, count(m.pos) AS n_lines, count(*) FILTER (WHERE m.dead) AS n_removed,
       coalesce(max(r.n_runs), 0) AS n_runs,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.dead), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id LEFT JOIN runs r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""

ORACLE["op6_hamming"] = """
WITH codes AS (
  SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END
                           for i in generate_series(1, 64)])::HUGEINT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
  FROM codes q, codes c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""

ORACLE["op10_token_counts"] = """
WITH kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
counts AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '[^ \\t\\n\\r|]+')) AS tokens FROM kept
  UNION ALL
  SELECT source, lang, 'words-2', len(regexp_extract_all(text, '[\\p{L}]+|[^\\p{L} \\t\\n\\r]')) FROM kept)
SELECT source, lang, version, count(*) AS documents, sum(coalesce(tokens, 0))::BIGINT AS tokens
FROM counts GROUP BY source, lang, version
"""

ORACLE["op12_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
spelled AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, d, array_to_string(ws[g.i:g.i + d - 1], ' ') AS phrase
  FROM spelled, (SELECT unnest([1, 2, 3, 4]) AS d), LATERAL (SELECT unnest(range(1, len(ws) - d + 2)) AS i) g),
f AS MATERIALIZED (SELECT lang, d, phrase, count(*) AS n FROM grams GROUP BY lang, d, phrase),
sizes AS (SELECT lang, sum(n) AS n FROM f WHERE d = 1 GROUP BY lang),
candidates AS (SELECT lang, d, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE d > 1 AND n >= 30),
cuts AS (
  SELECT c.lang, c.d, c.phrase, c.a, g.k, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.a) // (x.n + y.n))::BIGINT AS score
  FROM candidates c, LATERAL (SELECT unnest(range(1, c.d)) AS k) g
  JOIN f x ON x.lang = c.lang AND x.d = g.k AND x.phrase = array_to_string(c.ws[1:g.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.d = c.d - g.k AND y.phrase = array_to_string(c.ws[g.k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, d, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT c.lang, array_to_string(c.ws[g.i:g.i + s - 1], ' ') AS phrase, c.a
  FROM candidates c, (SELECT unnest([2, 3]) AS s), LATERAL (SELECT unnest(range(1, c.d - s + 2)) AS i) g WHERE s < c.d),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase),
kept AS (
  SELECT w.* FROM lowest w LEFT JOIN longest USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       sizes.n::BIGINT AS n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""


def _centroid_rounds(rounds: int = 5, clusters: int = 40) -> str:
    """Rounds written out one after the other: distances of all vectors to all centroids, then floors of the means."""
    distances = """
  SELECT rid, k, sum((l.v - c.v) * (l.v - c.v)) AS d FROM entries l JOIN c{n} c ON l.i = c.i GROUP BY rid, k"""
    nearest = """
a{n} AS MATERIALIZED (SELECT rid, k, d FROM ({distances})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""
    moved = """
c{next} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS v
    FROM (SELECT a.k, l.i, sum(l.v)::HUGEINT AS s, count(*) AS n FROM a{n} a JOIN entries l USING (rid) GROUP BY a.k, l.i)) m
  ON c.k = m.k AND c.i = m.i)"""
    steps = []
    for n in range(rounds + 1):
        steps.append(nearest.format(n=n, distances=distances.format(n=n)))
        if n < rounds:
            steps.append(moved.format(n=n, next=n + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
entries AS MATERIALIZED (SELECT rid, g.i, e[g.i] AS v FROM kept, (SELECT unnest(range(1, 65)) AS i) g),
c0 AS MATERIALIZED (
  SELECT k, l.i, l.v FROM (
    SELECT rid, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS k FROM kept
    QUALIFY k < {clusters}) f JOIN entries l USING (rid)),{",".join(steps)},
ends AS (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN ends USING (k)
"""


ORACLE["op13_centroids"] = _centroid_rounds()
