"""SQL counterparts of the registered queries, written for DuckDB over the same tables."""

from folioquery import constants as K
from folioquery.operators.answers import DEFAULT_FALLBACK, DEFAULT_SYSTEM_PROMPT
from folioquery.operators.hashing import PROBES, projections
from folioquery.plans.queries import CONFIGURED, DENSE_THRESHOLD, OVERRIDE, RELEVANCE_THRESHOLD, VECTOR_LENGTH

_BLANKS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
STEP = K.CHUNK_SIZE - K.CHUNK_OVERLAP


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


def _clean(x: str) -> str:
    blanks = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return _strip(rf"regexp_replace({blanks}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def _case(column: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {default} END"


_CATEGORY = (f"coalesce(nullif({_case('source', OVERRIDE, 'NULL')}, ''), "
             f"{_case('source', CONFIGURED, 'NULL')}, {_text(K.DEFAULT_CATEGORY)})")

CORPUS = f"""corpus AS (
  SELECT source AS file_name, {_CATEGORY} AS category, doc_id AS doc_seq, text,
    CASE WHEN lang = 'en' THEN doc_id + 1 END AS page, CASE WHEN lang = 'de' THEN doc_id END AS slide,
    CASE WHEN lang = 'fr' THEN 's' || doc_id END AS section,
    CASE WHEN lang IN ('fr', 'es') THEN doc_id + 2 END AS row_no
  FROM documents)"""

CHUNKS = f"""{CORPUS}, cut AS (
  SELECT *, unnest(range(0, CAST(greatest(1, ceil((length(text) - {K.CHUNK_OVERLAP}) / {STEP}.0)) AS BIGINT))) AS chunk_seq
  FROM corpus WHERE text <> ''),
chunks AS (
  SELECT * EXCLUDE (text), printf('%s#%010d#%06d', file_name, doc_seq, chunk_seq) AS chunk_key,
    substring(text, chunk_seq * {STEP} + 1, {K.CHUNK_SIZE}) AS text FROM cut)"""

QUESTIONS = """asked AS (
  SELECT item_id AS question_id, text AS question, CASE WHEN item_id % 3 = 0 THEN 'Comercial' END AS category
  FROM benchmark)"""


def _lexical(questions: str, threshold: float) -> str:
    words = r"unnest(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))".format
    return f"""{CHUNKS}, {questions},
ctf AS (SELECT chunk_key, category, term, count(*) AS tf FROM
        (SELECT chunk_key, category, {words('text')} AS term FROM chunks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM ctf GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM chunks)) / (1 + df)::DOUBLE) + 1 AS idf FROM dfs),
cw AS (SELECT chunk_key, category, term, tf * idf AS w FROM ctf JOIN idf USING (term)),
cn AS (SELECT chunk_key, sqrt(sum(w * w)) AS norm FROM cw GROUP BY chunk_key),
qtf AS (SELECT question_id, category, term, count(*) AS tf FROM
        (SELECT question_id, category, {words('question')} AS term FROM asked) GROUP BY ALL),
qw AS (SELECT question_id, category, term,
         tf * coalesce(idf, ln((1 + (SELECT count(*) FROM chunks))::DOUBLE) + 1) AS w FROM qtf LEFT JOIN idf USING (term)),
qn AS (SELECT question_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY question_id),
dots AS (SELECT question_id, chunk_key, sum(qw.w * cw.w) AS s FROM qw JOIN cw USING (term)
         WHERE qw.category IS NULL OR qw.category = cw.category GROUP BY ALL),
scored AS (SELECT question_id, chunk_key, round(s / (qn.norm * cn.norm), {K.SCORE_DIGITS}) AS score
           FROM dots JOIN qn USING (question_id) JOIN cn USING (chunk_key)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_key) AS rank FROM scored),
hits AS (SELECT question_id, rank, score, chunk_key, file_name, category, page, slide, section, row_no, text
         FROM ranked JOIN chunks USING (chunk_key) WHERE rank <= {K.TOP_K} AND score >= {threshold}::DOUBLE)"""


HITS = _lexical(QUESTIONS, K.THRESHOLDS["lexical"])

_LABEL = f"""coalesce('{K.LABEL_PAGE}' || page, '{K.LABEL_SLIDE}' || slide,
  '{K.LABEL_SECTION}''' || section || '''' || coalesce(', {K.LABEL_ROW}' || row_no, ''), '{K.LABEL_ROW}' || row_no, '')"""
_FRAGMENT = f"""'[{K.LABEL_FRAGMENT}' || rank || ' — {K.LABEL_SOURCE}' || file_name ||
  CASE WHEN {_LABEL} <> '' THEN ', ' || {_LABEL} ELSE '' END || ' — {K.LABEL_CATEGORY}' || category || ']' || chr(10) || text"""
_SEPARATOR = " || ".join(["chr(10)", "chr(10)", "'---'", "chr(10)", "chr(10)"])
CONTEXT = f"""context AS (SELECT question_id, string_agg({_FRAGMENT}, {_SEPARATOR} ORDER BY rank) AS context,
  count(*) AS sources FROM hits GROUP BY question_id)"""
_SYSTEM = f"replace({_text(DEFAULT_SYSTEM_PROMPT.replace('{fallback}', DEFAULT_FALLBACK))}, '{{context}}', context)"

HISTORY = f"""past AS (
  SELECT conv_id, turn, role, text, array_to_string(coalesce(list(role || ': ' || text) OVER w, []), chr(10)) AS history,
    coalesce(list(CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || ': ' || text) OVER w, []) AS said,
    lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS previous
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {K.HISTORY_MESSAGES} PRECEDING AND 1 PRECEDING))"""

_VECTORS = "vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"


def _dense(where: str = "true", threshold: float = -1.0, score: str = "{}") -> str:
    cosine = "list_dot_product(q.v, c.v) / (q.norm * c.norm)"
    return f"""WITH {_VECTORS},
scored AS (SELECT q.vec_id AS question_id, c.vec_id, round({score.format(cosine)}, {K.SCORE_DIGITS}) AS score
           FROM vectors q, vectors c WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored
           WHERE score >= {threshold}::DOUBLE)
SELECT question_id, rank, score, vec_id FROM ranked WHERE rank <= {K.TOP_K}"""


def _recursive_chunks() -> str:
    """Segments are split at one separator after the other; a recursive query then follows, in each run of small pieces,
    the pointer from the first piece of a chunk to that of the next."""
    size, overlap, key = K.CHUNK_SIZE, K.CHUNK_OVERLAP, "file_name, doc_seq, category"
    steps = ["seg0 AS (SELECT *, 0::BIGINT AS a, length(text)::BIGINT AS z FROM corpus WHERE text <> '')"]
    for level, mark in enumerate(K.SEPARATORS):
        sign = " || ".join(f"chr({ord(c)})" for c in mark)
        steps.append(f"""
parts{level} AS (SELECT *, generate_subscripts(parts, 1) AS i, len(parts) AS n, unnest(parts) AS part FROM (
  SELECT *, string_split(substring(text, a + 1, z - a), {sign}) AS parts FROM seg{level})),
ends{level} AS (
  SELECT * EXCLUDE (parts, part), (a + sum(length(part)) OVER (PARTITION BY {key}, a ORDER BY i) + (i - 1) * {len(mark)})::BIGINT AS hi
  FROM parts{level}),
pieces{level} AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY {key}, a ORDER BY i), a) AS lo FROM ends{level}),
seg{level + 1} AS (SELECT {key}, text, lo AS a, hi AS z FROM pieces{level} WHERE n = 1 OR hi - lo >= {size}),
runs{level} AS (
  SELECT {key}, text, list_concat([min(lo)], list(hi ORDER BY hi)) AS b FROM (
    SELECT *, count_if(hi - lo >= {size}) OVER (PARTITION BY {key}, a ORDER BY i) AS run FROM pieces{level} WHERE n > 1 AND lo < hi)
  WHERE hi - lo < {size} GROUP BY {key}, text, a, run)""")
    last = len(K.SEPARATORS)
    runs = " UNION ALL ".join(f"SELECT {key}, text, b::BIGINT[] AS b FROM runs{level}" for level in range(last))
    return f"""WITH RECURSIVE {CORPUS}, {",".join(steps)},
runs AS MATERIALIZED ({runs} UNION ALL SELECT {key}, text, range(a, z + 1) AS b FROM seg{last}),
chain AS (
  SELECT *, 1::BIGINT AS f, len(list_filter(b, lambda x: x <= b[1] + {size})) AS e FROM runs
  UNION ALL
  SELECT * EXCLUDE (g), g AS f, len(list_filter(b, lambda x: x <= b[g] + {size})) AS e FROM (
    SELECT {key}, text, b, len(list_filter(b, lambda x: x < greatest(b[e] - {overlap}, b[e + 1] - {size}))) + 1 AS g
    FROM chain WHERE e < len(b))),
pieces AS (SELECT {key}, b[f] AS a, {_strip("substring(text, b[f] + 1, b[e] - b[f])")} AS text FROM chain)
SELECT printf('%s#%010d#%06d', file_name, doc_seq, row_number() OVER (PARTITION BY file_name, doc_seq ORDER BY a) - 1) AS chunk_key,
       category, text FROM pieces WHERE text <> ''"""


def _reissued(query: str = CORPUS) -> str:
    """The corpus after files with a toxic Spanish text came in again, holding only their labelled texts."""
    changed = f"""{CORPUS.replace("corpus AS", "before AS", 1)},
files AS (SELECT DISTINCT source AS file_name FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang = 'es'),
corpus AS (
  SELECT * FROM before WHERE file_name NOT IN (SELECT file_name FROM files)
  UNION ALL SELECT * REPLACE ('v2 ' || text AS text) FROM before
  WHERE file_name IN (SELECT file_name FROM files) AND doc_seq IN (SELECT doc_id FROM labels))"""
    return query.replace(CORPUS, changed, 1)


def _hashed() -> str:
    """The same projections as literals; a question looks into its cheapest buckets."""
    planes = projections(VECTOR_LENGTH)
    tables, bits, _ = planes.shape
    values = ", ".join(f"({t}, {j}, [{', '.join(map(repr, planes[t, j].tolist()))}]::DOUBLE[])" for t in range(tables) for j in range(bits))
    cost = " + ".join(f"costs[{j + 1}] * ((change >> {j}) & 1)" for j in range(bits))
    return f"""WITH {_VECTORS}, planes(t, j, p) AS (VALUES {values}),
codes AS MATERIALIZED (
  SELECT vec_id, t, sum(CASE WHEN s > 0 THEN 1 << j ELSE 0 END)::INTEGER AS code, list(s * s ORDER BY j) AS costs
  FROM (SELECT vec_id, t, j, list_dot_product(v, p) AS s FROM vectors, planes WHERE norm > 0) GROUP BY vec_id, t),
probes AS (
  SELECT vec_id, t, xor(code, change) AS code FROM (
    SELECT vec_id, t, code, change, row_number() OVER (PARTITION BY vec_id, t ORDER BY {cost}, change) AS nth
    FROM codes, (SELECT unnest(range({1 << bits}))::INTEGER AS change)) WHERE nth <= {PROBES}),
pairs AS (SELECT DISTINCT q.vec_id AS question_id, c.vec_id FROM probes q JOIN codes c USING (t, code)),
scored AS (SELECT question_id, p.vec_id, round(list_dot_product(q.v, c.v) / (q.norm * c.norm), {K.SCORE_DIGITS}) AS score
           FROM pairs p JOIN vectors q ON q.vec_id = question_id JOIN vectors c ON c.vec_id = p.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored
           WHERE score >= {DENSE_THRESHOLD}::DOUBLE)
SELECT question_id, rank, score, vec_id FROM ranked WHERE rank <= {K.TOP_K}"""


_PART_UNITS = """parts AS (
  SELECT 'part.csv' AS file_name, p_partkey + 2 AS row_no,
    concat_ws('. ', 'p_name: ' || p_name, 'p_brand: ' || p_brand, 'p_type: ' || p_type, 'p_size: ' || p_size,
              'p_retailprice: ' || p_retailprice) AS text FROM part)"""

_PAGE_UNITS = f"""lines AS (
  SELECT source || '-' || doc_id AS file_name, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
pageunits AS (SELECT file_name, page, {_clean('line')} AS text FROM lines WHERE {_clean('line')} <> '')"""

_TAGS = "h1|h2|h3|p|li|td|th"


def _html() -> str:
    page = "html"
    for tag in K.HTML_DROPPED_TAGS:
        page = rf"regexp_replace({page}, '(?is)<{tag}\b.*?</{tag}\s*>', '', 'g')"

    def decoded(x: str) -> str:
        for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
            x = f"replace({x}, '&{name};', '{char}')"
        return x

    cut = rf"regexp_replace(piece, '(?is)^(.*</(?:{_TAGS})\s*>).*$', '\1')"
    shown = rf"regexp_replace({cut}, '(?s)(?:\s*(?:<!--.*?-->|<[^>]+>)\s*)+', ' ', 'g')"
    return rf"""cleaned AS (SELECT page_id, {page} AS page FROM pages),
titled AS (SELECT page_id, {_strip(decoded("regexp_extract(page, '(?is)<title[^>]*>([^<]*)</title>', 1)"))} AS title,
  string_split(regexp_replace(regexp_replace(page, '(?is)^.*?<body[^>]*>', ''),
               '(?i)(<(?:{_TAGS})\b)', chr(1) || '\1', 'g'), chr(1)) AS pieces FROM cleaned),
pieces AS (SELECT page_id, title, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM titled),
shown AS (SELECT page_id, title, pos, regexp_matches(piece, '(?i)^<h[1-3]\b') AS heading,
  {_strip(decoded(_strip(shown)))} AS text FROM pieces WHERE regexp_matches(piece, '(?i)^<(?:{_TAGS})\b')),
placed AS (SELECT *, sum(heading::INT) OVER (PARTITION BY page_id ORDER BY pos) AS part FROM shown WHERE text <> ''),
grouped AS (SELECT page_id, part, coalesce(max(text) FILTER (heading), max(title)) AS section,
  string_agg(text, ' ' ORDER BY pos) FILTER (NOT heading) AS body FROM placed GROUP BY page_id, part),
htmlunits AS (SELECT page_id::VARCHAR AS file_name, section, section || chr(10) || {_clean('body')} AS text
  FROM grouped WHERE body IS NOT NULL AND {_clean('body')} <> '')"""


_PRICE_TEXT = "CASE WHEN p_size % 2 = 0 THEN ' Desde ' || p_retailprice ELSE p_retailprice::VARCHAR END"
_QUOTES = f"""catalogue AS (
  SELECT p_partkey AS ord, CASE WHEN p_type = 'ECONOMY' THEN '{K.MAINTENANCE}' || p_brand
    ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS service,
    p_retailprice AS price, p_size % 2 = 0 AS is_from, p_type AS delivery FROM part),
names AS (SELECT {_fold('service')} AS name, min(ord) AS ord FROM catalogue GROUP BY 1),
lines AS (SELECT l_orderkey AS quote_id, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN p_name || ' con extras'
    WHEN 'R' THEN p_type || ' ' || p_brand ELSE p_name END AS requested
  FROM lineitem JOIN part ON l_partkey = p_partkey),
wanted AS (SELECT DISTINCT {_fold('requested')} AS request FROM lines),
firsts AS (SELECT request, min(ord) AS ord FROM wanted JOIN names
           ON contains(request, name) OR contains(name, request) GROUP BY request),
priced AS (SELECT quote_id, line, requested, service, price, is_from, delivery
  FROM lines LEFT JOIN firsts ON {_fold('requested')} = request LEFT JOIN catalogue USING (ord)),
requests AS (SELECT o_orderkey AS quote_id, substring(o_orderpriority, 1, 1)::INT - 2 AS months,
  CASE o_orderstatus WHEN 'F' THEN 'Brand#1' WHEN 'O' THEN 'brand#2' ELSE 'Oro' END AS plan FROM orders),
plans AS (SELECT plan, min(ord) AS ord FROM (SELECT DISTINCT plan FROM requests) JOIN names
          ON contains(name, {_fold(f"'{K.MAINTENANCE}' || plan")}) GROUP BY plan),
maintenance AS (SELECT quote_id, '{K.MAINTENANCE}' || plan AS requested, service AS plan_service, months,
    price * months AS cost FROM requests LEFT JOIN plans USING (plan) LEFT JOIN catalogue USING (ord) WHERE months > 0),
sums AS (SELECT quote_id, sum(price) AS subtotal, bool_or(is_from) AS has_from FROM priced GROUP BY quote_id),
totals AS (SELECT quote_id, coalesce(subtotal, 0) AS subtotal, coalesce(subtotal, 0) + coalesce(cost, 0) AS total,
    coalesce(has_from, false) AS has_from FROM requests LEFT JOIN sums USING (quote_id) LEFT JOIN maintenance USING (quote_id)),
missing AS (SELECT quote_id, line, requested FROM priced WHERE service IS NULL UNION ALL
            SELECT quote_id, 2147483647, requested FROM maintenance WHERE plan_service IS NULL)"""

_LOG = """log AS (SELECT event_type || ' ' || user_id AS pregunta, 'k' || (props->>'$.k') AS source,
  event_type <> 'error' AS uso_rag, round(value, 2) AS duracion_s, ts FROM events)"""

ORACLE: dict[str, str] = {
    "lexical_topk": f"WITH {HITS} SELECT question_id, rank, score, chunk_key, category, text FROM hits",
    "clean_documents": f"SELECT doc_id, {_clean('text')} AS text FROM documents WHERE {_clean('text')} <> ''",
    "row_sentences": f"WITH {_PART_UNITS} SELECT * FROM parts",
    "page_text_units": f"WITH {_PAGE_UNITS} SELECT * FROM pageunits",
    "markdown_sections": f"""WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
units AS (SELECT doc_id, {_clean("CASE WHEN pos = 1 THEN line ELSE '## ' || line END")} AS text FROM cut)
SELECT doc_id::VARCHAR AS file_name, {_strip("ltrim(split_part(text, chr(10), 1), '# ')")} AS section, text
FROM units WHERE text <> ''""",
    "html_units": f"WITH {_html()} SELECT * FROM htmlunits",
    "category_lookup": f"WITH {CORPUS} SELECT file_name, doc_seq, category FROM corpus",
    "format_union": f"""WITH {_PART_UNITS}, {_html()}, {_PAGE_UNITS}
SELECT 'csv' AS format, count(*) AS units, 0 AS with_page, 0 AS with_section, count(*) AS with_row,
  sum(length(text)) AS characters FROM parts
UNION ALL SELECT 'html', count(*), 0, count(section), 0, sum(length(text)) FROM htmlunits
UNION ALL SELECT 'pdf', count(*), count(*), 0, 0, sum(length(text)) FROM pageunits""",
    "units_per_source": "SELECT source AS file_name, count(*) AS units FROM documents GROUP BY source",
    "missing_sources": "SELECT doc_id::VARCHAR AS file_name FROM documents EXCEPT SELECT doc_id::VARCHAR FROM labels",
    "file_names": r"""SELECT page_id, string_split(url, '/')[-1] AS base_name,
  lower(regexp_extract(string_split(url, '/')[-1], '^.+(\.[^.]+)$', 1)) AS suffix FROM pages""",
    "fixed_chunks": f"WITH {CHUNKS} SELECT chunk_key, category, text FROM chunks",
    "chunk_ids": f"""WITH {CHUNKS} SELECT chunk_key,
  row_number() OVER (ORDER BY file_name, doc_seq, chunk_seq) - 1 AS chunk_id FROM chunks""",
    "role_prefixes": f"""SELECT '{K.QUERY_PREFIX}' || text AS text FROM benchmark
UNION ALL SELECT '{K.PASSAGE_PREFIX}' || text FROM documents""",
    "normalise_vectors": f"""WITH {_VECTORS}
SELECT vec_id, generate_subscripts(v, 1) - 1 AS at, round(unnest(v) / norm, {K.SCORE_DIGITS}) AS x FROM vectors""",
    "pair_scores": f"""WITH {_VECTORS}
SELECT a.vec_id, round(list_dot_product(a.v, b.v), {K.SCORE_DIGITS}) AS cosine,
  round(1 - (list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v)) / sqrt(2.0::DOUBLE),
        {K.SCORE_DIGITS}) AS relevance
FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1""",
    "dense_topk": _dense(),
    "dense_topk_filtered": _dense("q.label = c.label"),
    "dense_threshold": _dense(threshold=RELEVANCE_THRESHOLD, score="1 - (2 - 2 * ({})) / sqrt(2.0::DOUBLE)"),
    "cell_topk": _dense(threshold=DENSE_THRESHOLD),
    "ann_topk": _hashed(),
    "cited_context": f"WITH {HITS}, {CONTEXT} SELECT question_id, context FROM context",
    "source_records": f"""WITH {HITS} SELECT question_id, rank, file_name, category,
  coalesce(nullif(page, 0)::VARCHAR, nullif(slide, 0)::VARCHAR, nullif(section, ''), nullif(row_no, 0)::VARCHAR, '') AS location,
  round(score, 3) AS score, substring(text, 1, {K.EXTRACT_CHARS}) AS extract FROM hits""",
    "cited_files": f"""WITH {HITS} SELECT question_id, string_agg(DISTINCT file_name, ', ' ORDER BY file_name) AS files
FROM hits GROUP BY question_id""",
    "answer_or_fallback": f"""WITH {HITS}, {CONTEXT}
SELECT question_id, context IS NOT NULL AS used_retrieval,
  CASE WHEN context IS NULL THEN {_text(DEFAULT_FALLBACK)} END AS answer,
  'system: ' || {_SYSTEM} || chr(10) || 'user: ' || question AS prompt, coalesce(sources, 0) AS sources
FROM asked LEFT JOIN context USING (question_id)""",
    "history_window": f"WITH {HISTORY} SELECT conv_id, turn, history FROM past",
    "prompt_table": f"""WITH {HISTORY}, {_lexical('''asked AS (
  SELECT conv_id || '-' || turn AS question_id, text AS question, NULL::VARCHAR AS category, said FROM past
  WHERE role = 'user')''', 0.1)}, {CONTEXT}
SELECT question_id, context IS NOT NULL AS used_retrieval,
  array_to_string(['system: ' || {_SYSTEM}] || said || ['user: ' || question], chr(10))
    || CASE WHEN context IS NULL THEN NULL ELSE '' END AS prompt
FROM asked LEFT JOIN context USING (question_id)""",
    "feedback_pairs": f"""WITH {HISTORY}
SELECT previous AS pregunta, substring(text, 1, {K.LOGGED_ANSWER_CHARS}) AS respuesta,
  CASE WHEN turn % 4 = 1 THEN '{K.FEEDBACK_POSITIVE}' ELSE '{K.FEEDBACK_NEGATIVE}' END AS feedback
FROM past WHERE role = 'assistant'""",
    "accent_fold": f"SELECT doc_id, {_fold('text')} AS folded FROM documents",
    "price_parse": f"""SELECT p_partkey, try_cast(trim(replace(lower(trim({_PRICE_TEXT})), '{K.PRICE_FROM}', '')) AS DOUBLE) AS price,
  starts_with(lower(trim({_PRICE_TEXT})), '{K.PRICE_FROM}') AS is_from FROM part""",
    "quote_lines": f"WITH {_QUOTES} SELECT * FROM priced",
    "quote_totals": f"""WITH {_QUOTES}
SELECT quote_id, round(subtotal, 2) AS subtotal, round(total, 2) AS total, has_from FROM totals""",
    "quote_unmatched": f"WITH {_QUOTES} SELECT quote_id, line, requested FROM missing",
    "nested_quotes": f"""WITH {_QUOTES},
listed AS (SELECT quote_id, string_agg(concat_ws('|', service, round(price, 2)::VARCHAR, is_from::VARCHAR, delivery), '; ' ORDER BY line, requested)
             FILTER (service IS NOT NULL) AS lines FROM priced GROUP BY quote_id),
unmatched AS (SELECT quote_id, string_agg(requested, '; ' ORDER BY line, requested) AS unmatched FROM missing GROUP BY quote_id)
SELECT quote_id, coalesce(lines, '') AS lines, round(subtotal, 2) AS subtotal, plan_service AS plan,
  round(CASE WHEN plan_service IS NOT NULL THEN cost END, 2) AS maintenance, round(total, 2) AS total,
  '{K.PAYMENT_TERMS}' AS payment_terms, CASE WHEN has_from THEN {_text(K.FROM_PRICE_NOTE)} END AS note, unmatched
FROM totals LEFT JOIN listed USING (quote_id) LEFT JOIN maintenance USING (quote_id) LEFT JOIN unmatched USING (quote_id)""",
    "index_replace": """WITH files AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang = 'es')
SELECT source AS file_name, doc_id AS doc_seq, text FROM documents WHERE source NOT IN (SELECT source FROM files)
UNION ALL SELECT source, doc_id, 'v2 ' || text FROM documents
WHERE source IN (SELECT source FROM files) AND doc_id IN (SELECT doc_id FROM labels)""",
    "recursive_chunks": _recursive_chunks(),
    "written_index": f"WITH {_reissued()} SELECT file_name, doc_seq, category, text FROM corpus",
    "written_file": f"WITH {CORPUS} SELECT file_name, doc_seq, text FROM corpus WHERE file_name = 'src7' AND category = 'Interno'",
    "block_topk": f"WITH {HITS} SELECT question_id, rank, score, chunk_key FROM hits",
    "refreshed_topk": f"WITH {_reissued(HITS)} SELECT question_id, rank, score, chunk_key FROM hits",
    "refreshed_terms": f"""WITH {_reissued(HITS)}
SELECT term, df FROM dfs UNION ALL SELECT '', count(*) FROM chunks""",
    "index_categories": f"WITH {CORPUS} SELECT DISTINCT category FROM corpus WHERE category <> ''",
    "index_file": "SELECT source AS file_name, doc_id AS doc_seq, text FROM documents WHERE source = 'src3'",
    "coverage_report": f"""WITH {_LOG}
SELECT ts::DATE AS day, count(*) AS questions, count_if(uso_rag) AS answered, count_if(NOT uso_rag) AS uncovered,
  round(count_if(uso_rag) / count(*)::DOUBLE, 6) AS answered_rate, quantile_disc(duracion_s, 0.5) AS median_s,
  quantile_disc(duracion_s, 0.95) AS p95_s FROM log GROUP BY 1""",
    "uncovered_questions": f"WITH {_LOG} SELECT pregunta, count(*) AS times FROM log WHERE NOT uso_rag GROUP BY pregunta",
    "source_usage": f"WITH {_LOG} SELECT source AS file_name, count(*) AS citations FROM log GROUP BY source",
    "feedback_report": """SELECT ts::DATE AS day, count(*) AS votes, count_if(event_type = 'purchase') AS positive,
  round(count_if(event_type = 'purchase') / count(*)::DOUBLE, 6) AS positive_rate
FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""",
    "windowed_coverage": f"""WITH {_LOG}
SELECT date_trunc('hour', ts) AS window_start, count_if(uso_rag) AS covered, count_if(NOT uso_rag) AS uncovered
FROM log GROUP BY 1""",
    "windowed_audit": """WITH asked AS (SELECT DISTINCT user_id, event_type = 'view' AS uso_rag, ts FROM events WHERE event_type IN ('view', 'error')),
voted AS (
  SELECT a.user_id, a.uso_rag, a.ts, count_if(v.event_type = 'purchase') AS positive, count_if(v.event_type = 'click') AS negative
  FROM asked a LEFT JOIN events v ON v.user_id = a.user_id AND v.event_type IN ('purchase', 'click')
    AND v.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS GROUP BY ALL)
SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, count_if(uso_rag) AS covered,
  count_if(NOT uso_rag) AS uncovered, count_if(negative > 0) AS disliked, sum(positive)::BIGINT AS positive, sum(negative)::BIGINT AS negative
FROM voted GROUP BY 1""",
    "merged_durations": f"""WITH {_LOG}
SELECT date_trunc('week', ts)::DATE AS week, count(*) AS questions, quantile_disc(duracion_s, 0.5) AS median_s,
  quantile_disc(duracion_s, 0.95) AS p95_s FROM log GROUP BY 1""",
    "reconciled_files": """WITH parts AS (
  SELECT doc_id, lang, source || '/' || lang AS file_name, ('0x' || substring(sha256(coalesce(text, '')), 1, 8))::BIGINT AS part FROM documents),
listing AS (SELECT file_name, count(*) || '-' || sum(part) AS digest FROM parts
            WHERE lang <> 'es' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1),
known AS (SELECT file_name, count(*) || '-' || sum(part) AS digest FROM parts WHERE lang <> 'de' GROUP BY 1)
SELECT coalesce(l.file_name, k.file_name) AS file_name, CASE WHEN k.file_name IS NULL THEN 'new' WHEN l.file_name IS NULL THEN 'gone'
  WHEN l.digest = k.digest THEN 'same' ELSE 'changed' END AS state
FROM listing l FULL JOIN known k ON l.file_name = k.file_name""",
    "json_lines": """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' || (props->>'$.k')
  || ',"fuentes":["' || event_type || '"]}' AS line FROM events""",
    "elapsed": """SELECT l_orderkey, l_linenumber, epoch(l_shipdate) - epoch(o_orderdate) AS duration_s
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}
