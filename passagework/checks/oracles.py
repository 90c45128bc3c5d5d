"""The SQL twin of each query, for DuckDB over the same tables."""

from __future__ import annotations

SOURCE = """('docs/' || source || '/' || doc_id ||
    (['.md', '.mdx', '.txt', '.ts', '.js', '.json', '.py'])[CAST(doc_id % 7 + 1 AS INT)])"""

DOCS = f"""docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, {SOURCE} AS source, text AS content FROM documents)"""

CHUNKS = f"""{DOCS}, chunks AS (
  SELECT doc_id || '#' || i AS chunk_id, doc_id, CAST(i AS INT) AS chunk_no, source,
         substring(content, i * 800 + 1, 1000) AS content
  FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(content) - 200) / 800.0) AS BIGINT)))) AS i
        FROM docs WHERE length(content) > 0))"""


def tokens(col: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({col}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda t: t <> '')"


def bucket(token: str, dim: int = 256) -> str:
    return f"CAST(CAST('0x' || substr(md5({token}), 1, 8) AS BIGINT) % {dim} AS INT)"


def counted(table: str, key: str, col: str) -> str:
    """(key, bucket, cnt) of the hashed words of ``col``."""
    return f"""SELECT {key}, {bucket('t')} AS bucket, CAST(count(*) AS INT) AS cnt
  FROM (SELECT {key}, unnest({tokens(col)}) AS t FROM {table}) GROUP BY ALL"""


METADATA = f"""results AS (
  SELECT doc_id AS query_id, 1 AS rank, doc_id || '#0' AS chunk_id, text AS content,
         CAST(n_chars % 101 / 100.0 AS DOUBLE) AS score, {SOURCE} AS source, lang,
         CASE doc_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(n_chars % 50 AS VARCHAR) END AS startLine,
         CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars % 70 AS VARCHAR) END AS endLine
  FROM documents)"""

TYPE = """CASE WHEN lower(source) LIKE '%.md' OR lower(source) LIKE '%.mdx' THEN 'markdown'
  WHEN lower(source) LIKE '%.txt' THEN 'text'
  WHEN lower(source) LIKE '%.js' OR lower(source) LIKE '%.ts' THEN 'code'
  WHEN lower(source) LIKE '%.json' THEN 'json' END"""

LINE = "split_part(content, chr(10), 1)"
SUMMARY = f"CASE WHEN length({LINE}) > 100 THEN left({LINE}, 100) || '...' ELSE {LINE} END"
SPACES = r"\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
LONG_WORDS = (
    rf"list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^A-Za-z0-9_{SPACES}]', '', 'g'), '[{SPACES}]+'),"
    " lambda w: length(w) > 3)"
)


def first_distinct(words: str) -> str:
    """The first five distinct elements of a list column, in list order."""
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)[1:5]"


CENTS = "CAST(floor(abs(score) * 100 + 0.5) AS BIGINT)"
TWO_DECIMALS = f"CAST({CENTS} // 100 AS VARCHAR) || '.' || lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0')"


def relevance(query: str) -> str:
    return f"""'このドキュメントは検索クエリ "' || {query} ||
      '" に関連する情報を含んでいます。類似度スコア: ' || {TWO_DECIMALS}"""


SPAN = f"""CASE WHEN startLine IS NULL AND length(content) > 0 THEN 1 ELSE TRY_CAST(startLine AS INT) END AS start_line,
  CASE WHEN startLine IS NULL AND length(content) > 0
    THEN CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INT)
    ELSE TRY_CAST(endLine AS INT) END AS end_line,
  CASE WHEN startLine IS NULL AND length(content) > 0 THEN 1 END AS start_column,
  CASE WHEN startLine IS NULL AND length(content) > 0 THEN CAST(length({LINE}) AS INT) END AS end_column"""

PER_SOURCE = """SELECT source, {n} * count(*) AS n_chunks, count(DISTINCT chunk_id) AS n_ids,
  CAST({n} * sum(length(content)) AS BIGINT) AS n_chars, CAST({n} * count(*) AS DOUBLE) AS energy FROM chunks GROUP BY source"""


def ranked(scores: str, k: int, order: str = "score DESC, chunk_id") -> str:
    return f"""SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({scores})) WHERE rank <= {k}"""


def neighbours(k: int, metric: str = "cosine") -> str:
    q, v = "CAST(q.embedding AS DOUBLE[])", "CAST(v.embedding AS DOUBLE[])"
    score = {
        "cosine": f"list_cosine_similarity({q}, {v})",
        "l2": f"1 / (1 + list_distance({q}, {v}))",
        "ip": f"list_inner_product({q}, {v})",
    }[metric]
    return ranked(
        f"""SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round({score}, 6) AS score
  FROM embeddings q, embeddings v""",
        k,
    )


def bm25(queries: str, words: str, k: int) -> str:
    """BM25 over ``words(chunk_id, ws)`` for ``queries(query_id, query)``."""
    return f"""words AS ({words}),
  lens AS (SELECT chunk_id, len(ws) AS dl FROM words),
  tfs AS (SELECT chunk_id, t, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS t FROM words) GROUP BY ALL),
  dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
  n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
  terms AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS t FROM ({queries})),
  keyword_scores AS (
    SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) *
      tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM terms JOIN dfs USING (t) JOIN tfs USING (t) JOIN lens USING (chunk_id), n GROUP BY ALL),
  keyword_hits AS ({ranked('SELECT * FROM keyword_scores', k)})"""


def hashed(queries: str, k: int) -> str:
    """Cosine of the hashed words of ``queries(query_id, query)`` and of the chunks."""
    return f"""asked AS ({queries}),
  qv AS ({counted('asked', 'query_id', 'query')}),
  cv AS ({counted('chunks', 'chunk_id', 'content')}),
  qn AS (SELECT query_id, sqrt(sum(cnt * cnt)) AS qn FROM qv GROUP BY query_id),
  cn AS (SELECT chunk_id, sqrt(sum(cnt * cnt)) AS cn FROM cv GROUP BY chunk_id),
  dots AS (SELECT query_id, chunk_id, sum(qv.cnt * cv.cnt) AS dot FROM qv JOIN cv USING (bucket) GROUP BY ALL),
  vector_scores AS (SELECT query_id, chunk_id, round(dot / (qn * cn), 6) AS score
    FROM dots JOIN qn USING (query_id) JOIN cn USING (chunk_id)),
  vector_hits AS ({ranked('SELECT * FROM vector_scores', k)})"""


# Every chunk has a score by meaning, 0 if it shares no bucket with the query.
VECTOR_ALL = """vector_all AS (SELECT query_id, chunk_id, coalesce(s.score, 0) AS score
  FROM (SELECT query_id FROM asked) CROSS JOIN (SELECT chunk_id FROM chunks)
  LEFT JOIN vector_scores s USING (query_id, chunk_id)),
  worded AS (SELECT * FROM keyword_scores WHERE score > 0)"""


def scaled(hits: str) -> str:
    return f"""SELECT query_id, chunk_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS s
  FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi
        FROM {hits})"""


BENCHMARK = "SELECT item_id AS query_id, text AS query FROM benchmark"

# The rule by which the raw requests are made, and what must be read from them.
REQUESTS = """requests AS (
  SELECT conv_id || '/' || turn AS query_id, (conv_id + turn) % 11 AS kind, conv_id + turn AS n, turn, text
  FROM conversations),
validated AS (
  SELECT query_id,
    CASE WHEN kind = 1 THEN text WHEN kind IN (2, 3, 4, 5) THEN NULL WHEN n % 7 = 0 THEN '' ELSE text END AS query,
    CAST(NULL AS VARCHAR) AS context,
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 101 = 9 THEN 2147483647 WHEN n % 13 = 8 THEN 0
         WHEN n % 3 <> 0 THEN CAST(turn + 1 AS INT) END AS "limit",
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 4 = 0 THEN true END AS use_hybrid,
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 5 = 0 THEN CAST(0.25 AS DOUBLE) END AS alpha,
    CASE WHEN kind IN (2, 4) THEN 'Invalid arguments'
         WHEN kind IN (3, 5) OR (kind NOT IN (1, 2, 3, 4, 5) AND n % 7 = 0)
         THEN 'Query parameter is required and must be a string'
         WHEN kind NOT IN (1, 2, 3, 4, 5) AND n % 17 = 10 THEN 'Invalid arguments' END AS error,
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 17 = 10 THEN 'src(' WHEN n % 8 = 0 THEN 'src1*.md'
         WHEN n % 8 = 1 THEN '' END AS source_pattern,
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 6 = 0 THEN 'markdown,code' WHEN n % 6 = 1 THEN '' END AS document_types,
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 9 = 0 THEN '2024-01-05 12:00:00' END AS date_from,
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 10 = 0 THEN '2024-03-01 00:00:00' END AS date_to,
    CAST(NULL AS BOOLEAN) AS include_metadata,
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 2 = 0 THEN true END AS include_summary,
    CASE WHEN kind IN (1, 2, 3, 4, 5) THEN NULL WHEN n % 5 = 1 THEN true WHEN n % 5 = 2 THEN false END AS include_keywords,
    CAST(NULL AS BOOLEAN) AS include_relevance
  FROM requests)"""

SQL = {
    "scan_documents": f"""WITH {DOCS} SELECT doc_id, source, content, strftime(ts, '%Y-%m-%d %H:%M:%S') AS modified_at
  FROM docs LEFT JOIN events ON doc_id = CAST(event_id AS VARCHAR)""",
    "index_write": f"WITH {CHUNKS} {PER_SOURCE.format(n=1)}",
    "index_load": f"WITH {CHUNKS} {PER_SOURCE.format(n=1)}",
    "index_bucketed": f"WITH {CHUNKS} {PER_SOURCE.format(n=1)}",
    "index_edit": f"WITH {CHUNKS} {PER_SOURCE.format(n=1)}",
    "index_append": f"WITH {CHUNKS} {PER_SOURCE.format(n=2)}",
    "index_load_or_build": """SELECT CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, 500 AS longest,
  CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM documents""",
    "schema_ensure": """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id,
  CAST(n_chars AS INT) AS chunk_no, CAST(NULL AS VARCHAR) AS source, CAST(length(text) AS INT) AS n_chars, true AS no_vector
  FROM documents""",
    "index_stats": f"""WITH {CHUNKS} SELECT split_part(source, '/', 2) AS source, count(DISTINCT doc_id) AS n_documents,
  count(*) AS n_chunks, round(avg(length(content)), 6) AS avg_length, CAST(max(length(content)) AS INT) AS max_length
  FROM chunks GROUP BY ALL""",
    "results_json": f"""WITH hits AS ({neighbours(5)}),
  split AS MATERIALIZED (SELECT doc_id, {LONG_WORDS.replace('content', 'text')} AS ws FROM documents)
  SELECT query_id, '{{"results":[' || string_agg('{{"content":' || CAST(to_json(text) AS VARCHAR) ||
    ',"score":' || score || ',"source":' || CAST(to_json(source) AS VARCHAR) ||
    CASE WHEN doc_id % 2 = 0 THEN ',"startLine":' || n_chars ELSE '' END ||
    ',"keywords":' || CAST(to_json({first_distinct('ws')}) AS VARCHAR) || '}}', ',' ORDER BY rank) || ']}}' AS response
  FROM hits JOIN documents ON chunk_id = doc_id JOIN split USING (doc_id) GROUP BY query_id""",
    "chunk_fixed": f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_no, source, content FROM chunks",
    # c: where the words begin, and the end of the text; f: words before the chunk, e: words up to its end
    "chunk_recursive_words": r"""WITH RECURSIVE o AS (SELECT unnest([0, 200]) AS overlap),
  word AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word
    FROM (SELECT doc_id, regexp_extract_all(text, '^[^ ]+| [^ ]*') AS w FROM documents)),
  ends AS (SELECT doc_id, i, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM word),
  d AS (SELECT doc_id, text, [0] || list(CAST(c AS BIGINT) ORDER BY i) AS c FROM ends JOIN documents USING (doc_id) GROUP BY ALL),
  chunk AS (
    SELECT doc_id, overlap, 0 AS f, greatest(1, len(list_filter(c, lambda x: x <= 1000)) - 1) AS e FROM d, o
    UNION ALL
    SELECT doc_id, overlap, g, greatest(e + 1, len(list_filter(c, lambda x: x <= c[g + 1] + 1000)) - 1)
    FROM (SELECT k.doc_id, overlap, e, c,
            least(e, len(list_filter(c, lambda x: x < greatest(c[e + 1] - overlap, c[e + 2] - 1000)))) AS g
          FROM chunk k JOIN d USING (doc_id) WHERE e + 1 < len(c))),
  cut AS (SELECT overlap, doc_id, f, trim(substring(text, c[f + 1] + 1, c[e + 1] - c[f + 1]), ' ' || chr(10) || chr(9) || chr(13)) AS content
    FROM chunk JOIN d USING (doc_id))
  SELECT overlap, doc_id || '#' || (row_number() OVER (PARTITION BY overlap, doc_id ORDER BY f) - 1) AS chunk_id, content
  FROM cut WHERE content <> ''""",
    "chunk_recursive_cover": r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  md5(regexp_replace(text, '\s', '', 'g')) AS digest, true AS fits, true AS dense FROM documents""",
    "query_context": """SELECT conv_id, turn, text AS query,
  CASE WHEN turn % 3 = 0 THEN text || ' ' || role ELSE text END AS search_text FROM conversations""",
    "result_projection": f"WITH {METADATA} SELECT query_id, rank, chunk_id, content, score, source FROM results",
    "score_boost": f"""WITH {METADATA} SELECT query_id, rank, source,
  CASE WHEN contains(source, 'src7/') THEN 0.99 ELSE score END AS score FROM results WHERE score >= 0.5""",
    "metadata_positions": f"""WITH {METADATA} SELECT query_id, TRY_CAST(startLine AS INT) AS start_line,
  TRY_CAST(endLine AS INT) AS end_line, CAST(NULL AS INT) AS start_column, CAST(NULL AS INT) AS end_column FROM results""",
    "line_span": f"WITH {METADATA} SELECT query_id, {SPAN} FROM results",
    "document_type": f"WITH {METADATA} SELECT query_id, source, {TYPE} AS document_type FROM results",
    "include_metadata": f"""WITH {METADATA} SELECT query_id,
    CASE WHEN endLine IS NOT NULL THEN 'endLine,' ELSE '' END || 'lang,source' ||
    CASE WHEN startLine IS NOT NULL THEN ',startLine' ELSE '' END AS keys, source, lang, true AS asked FROM results
  UNION ALL SELECT query_id, NULL, NULL, NULL, false FROM results""",
    "metadata_keys": f"""WITH {METADATA} SELECT query_id,
    CASE WHEN endLine IS NOT NULL THEN 'endLine,' ELSE '' END || 'source' ||
    CASE WHEN startLine IS NOT NULL THEN ',startLine' ELSE '' END AS keys, source, CAST(NULL AS VARCHAR) AS lang
  FROM results""",
    "summary": f"WITH {METADATA} SELECT query_id, {SUMMARY} AS summary FROM results",
    "keywords": f"""WITH {METADATA}, split AS MATERIALIZED (SELECT query_id, {LONG_WORDS} AS ws FROM results)
  SELECT query_id, array_to_string({first_distinct('ws')}, ' ') AS keywords FROM split""",
    "relevance": f"""WITH {METADATA}, boosted AS (
    SELECT query_id, content, CASE WHEN contains(source, 'src7/') THEN 0.99 ELSE score END AS score FROM results)
  SELECT query_id, {relevance(LINE)} AS relevance FROM boosted""",
    "embed_hash": f"WITH {DOCS} {counted('docs', 'doc_id', 'content')}",
    "embed_hash_dense": f"""WITH {CHUNKS}, cv AS ({counted('chunks', 'chunk_id', 'content')})
  SELECT chunk_id, bucket, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY chunk_id)), 6) AS value FROM cv""",
    "embed_with": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(text) AS DOUBLE) AS n_chars,
  CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces,
  CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS n_e FROM documents""",
    "knn_exact": neighbours(10),
    "knn_exact_grid": neighbours(10),
    "ann_ivf_all_lists": neighbours(10),
    "knn_metrics": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, * FROM ({neighbours(5, m)})" for m in ("cosine", "l2", "ip")
    ),
    "keyword_bm25": f"""WITH {CHUNKS}, {bm25(BENCHMARK, f"SELECT chunk_id, {tokens('content')} AS ws FROM chunks", 10)}
  SELECT * FROM keyword_hits""",
    "keyword_fields": f"""WITH {CHUNKS}, {bm25(
        f"SELECT DISTINCT concat_ws(' ', split_part(source, '/', 2), {TYPE}) AS query_id, query_id AS query FROM docs",
        f'''SELECT chunk_id, list_concat(list_concat({tokens('content')}, {tokens('source')}),
          coalesce({tokens('(' + TYPE + ')')}, [])) AS ws FROM chunks''',
        10,
    )} SELECT * FROM keyword_hits""",
    "keyword_field_token": f"""WITH {CHUNKS}, pairs AS (
    SELECT d.doc_id AS query_id, c.chunk_id, CAST(1 AS DOUBLE) AS score
    FROM docs d JOIN chunks c ON trim(d.content, ' ') = trim(c.content, ' ') WHERE trim(d.content, ' ') <> '')
  {ranked('SELECT * FROM pairs', 3)}""",
    "hybrid_search": f"""WITH {CHUNKS}, {hashed(BENCHMARK, 100)},
  {bm25(BENCHMARK, f"SELECT chunk_id, {tokens('content')} AS ws FROM chunks", 100)}, {VECTOR_ALL},
  fused AS (SELECT query_id, chunk_id, round(0.5 * coalesce(v.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score
    FROM ({scaled('vector_all')}) v FULL JOIN ({scaled('worded')}) b USING (query_id, chunk_id))
  {ranked('SELECT * FROM fused', 10)}""",
    "batch_search": f"""WITH {CHUNKS}, {hashed(BENCHMARK, 10)},
  found AS (
    SELECT h.query_id, h.rank, h.chunk_id, c.source, c.content, a.query, CAST(NULL AS VARCHAR) AS startLine,
           CAST(NULL AS VARCHAR) AS endLine, CASE WHEN contains(source, 'src7/') THEN 0.99 ELSE score END AS score,
           {TYPE} AS document_type
    FROM vector_hits h JOIN chunks c USING (chunk_id) JOIN asked a USING (query_id)
    LEFT JOIN events e ON c.doc_id = CAST(e.event_id AS VARCHAR)
    WHERE rank <= CASE WHEN query_id % 3 <> 0 THEN query_id % 3 * 4 ELSE 10 END AND score >= 0.3
      AND ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-12-31')
  , split AS MATERIALIZED (SELECT *, {LONG_WORDS} AS ws FROM found)
  SELECT query_id, rank, chunk_id, score, source, content, {SPAN}, document_type, {SUMMARY} AS summary,
         array_to_string({first_distinct('ws')}, ' ') AS keywords, {relevance('query')} AS relevance
  FROM split WHERE document_type IN ('markdown', 'text', 'code') AND regexp_matches(source, 'docs/.*.(md|txt|ts)')""",
    "answer_requests": f"""WITH {REQUESTS}, {CHUNKS},
  accepted AS (SELECT query_id, query, coalesce("limit", 3) AS k, coalesce(use_hybrid, false) AS use_hybrid,
    coalesce(alpha, 0.5) AS alpha, document_types, source_pattern, date_from, date_to, include_summary, include_keywords
    FROM validated WHERE error IS NULL),
  {hashed('SELECT query_id, query FROM accepted', 1_000_000)},
  {bm25('SELECT query_id, query FROM accepted WHERE use_hybrid',
        f"SELECT chunk_id, {tokens('content')} AS ws FROM chunks", 1_000_000)}, {VECTOR_ALL},
  meant AS (SELECT * FROM vector_all SEMI JOIN (SELECT * FROM accepted WHERE use_hybrid) USING (query_id)),
  fused AS (SELECT query_id, chunk_id, round(alpha * coalesce(v.s, 0) + (1 - alpha) * coalesce(b.s, 0), 6) AS score
    FROM ({scaled('meant')}) v FULL JOIN ({scaled('worded')}) b USING (query_id, chunk_id)
    JOIN accepted USING (query_id)),
  hits AS (
    SELECT * FROM ({ranked('SELECT * FROM fused', 1_000_000)}) UNION ALL
    SELECT * FROM vector_hits ANTI JOIN (SELECT * FROM accepted WHERE use_hybrid) USING (query_id)),
  found AS (SELECT query_id, rank, chunk_id, CASE WHEN contains(source, 'clean-architecture') THEN 0.99 ELSE score END
      AS score, source, CAST(NULL AS VARCHAR) AS error, content, include_summary, include_keywords
    FROM hits JOIN accepted USING (query_id) JOIN chunks USING (chunk_id)
    LEFT JOIN events e ON chunks.doc_id = CAST(e.event_id AS VARCHAR)
    WHERE rank <= k AND score >= 0.45
      AND (coalesce(document_types, '') = '' OR list_contains(string_split(document_types, ','), {TYPE}))
      AND (coalesce(source_pattern, '') = '' OR regexp_matches(source, replace(source_pattern, '*', '.*')))
      AND (date_from IS NULL OR ts >= CAST(date_from AS TIMESTAMP)) AND (date_to IS NULL OR ts <= CAST(date_to AS TIMESTAMP))),
  split AS MATERIALIZED (SELECT *, {LONG_WORDS} AS ws FROM found)
  SELECT query_id, rank, chunk_id, score, source, error, CASE WHEN include_summary THEN {SUMMARY} END AS summary,
    CASE WHEN include_keywords THEN array_to_string({first_distinct('ws')}, ' ') END AS keywords FROM split
  UNION ALL SELECT query_id, 1, NULL, 0, 'dummy.md', NULL, NULL, NULL FROM accepted ANTI JOIN found USING (query_id)
  UNION ALL SELECT query_id, 1, NULL, 0, 'error.md', error, NULL, NULL FROM validated WHERE error IS NOT NULL""",
    "threshold_filter": f"WITH {METADATA} SELECT query_id, score FROM results WHERE score >= 0.7",
    "filter_document_types": f"""WITH {METADATA}, typed AS (SELECT query_id, {TYPE} AS document_type FROM results)
  SELECT * FROM typed WHERE document_type IN ('markdown', 'json')""",
    "filter_source_pattern": f"""WITH {METADATA} SELECT query_id, source FROM results
  WHERE regexp_matches(source, 'src1.*.md')""",
    "filter_date_range": f"""WITH {DOCS} SELECT doc_id, source FROM docs JOIN events
  ON doc_id = CAST(event_id AS VARCHAR)
  WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-20'""",
    "validate_requests": f"WITH {REQUESTS} SELECT * FROM validated",
    "topk_per_query": f"""WITH hits AS ({ranked(
        'SELECT user_id AS query_id, event_id AS chunk_id, value AS score FROM events', 7)})
  SELECT * FROM hits WHERE rank <= CASE WHEN query_id % 9 = 8 THEN 5 ELSE query_id % 9 END""",
    "no_result_fallback": f"""WITH {METADATA}, good AS (
    SELECT e.user_id AS query_id, r.rank, r.content, r.score, r.source
    FROM results r JOIN events e ON r.query_id = e.event_id WHERE r.score >= 0.7)
  SELECT * FROM good UNION ALL
  SELECT DISTINCT user_id, 1, '検索結果が見つかりませんでした。', 0.0, 'dummy.md' FROM events
  WHERE user_id NOT IN (SELECT query_id FROM good)""",
    "error_rows": f"""WITH {REQUESTS} SELECT query_id, 1 AS rank, '検索中にエラーが発生しました。' AS content,
  CAST(0 AS DOUBLE) AS score, 'error.md' AS source, error FROM validated WHERE error IS NOT NULL""",
}
# What each benchmark text asks for, and which chunks pass.
FILTERED = f"""wishes AS (
  SELECT item_id AS query_id, text AS query, item_id % 3 = 1 AS use_hybrid, item_id % 3 = 0 AS typed,
    CASE WHEN item_id % 5 <> 0 THEN 'docs/src' || (item_id % 5) || '.*.(md|txt|js)' END AS pattern,
    CASE WHEN item_id % 4 = 1 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(item_id AS INT)) END AS since,
    CASE WHEN item_id % 4 = 2 THEN TIMESTAMP '2024-01-20' END AS until FROM benchmark),
  allowed AS (SELECT query_id, chunk_id FROM wishes CROSS JOIN
      (SELECT chunks.*, ts, {TYPE} AS document_type FROM chunks LEFT JOIN events ON doc_id = CAST(event_id AS VARCHAR))
    WHERE (NOT typed OR document_type IN ('markdown', 'text')) AND (pattern IS NULL OR regexp_matches(source, pattern))
      AND (since IS NULL OR ts >= since) AND (until IS NULL OR ts <= until))"""
SQL["batch_search_pre"] = f"""WITH {CHUNKS}, {FILTERED}, {hashed(BENCHMARK, 10)},
  {bm25(BENCHMARK, f"SELECT chunk_id, {tokens('content')} AS ws FROM chunks", 10)}, {VECTOR_ALL},
  meant AS (SELECT * FROM vector_all SEMI JOIN allowed USING (query_id, chunk_id)),
  known AS (SELECT * FROM worded SEMI JOIN allowed USING (query_id, chunk_id)),
  fused AS (SELECT query_id, chunk_id, round(0.5 * coalesce(v.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score
    FROM ({scaled('meant')}) v FULL JOIN ({scaled('known')}) b USING (query_id, chunk_id)),
  hits AS (SELECT query_id, chunk_id, CASE WHEN use_hybrid THEN f.score ELSE m.score END AS score
    FROM meant m JOIN wishes USING (query_id) JOIN fused f USING (query_id, chunk_id))
SELECT query_id, rank, chunk_id, score, source, {TYPE} AS document_type
FROM ({ranked('SELECT * FROM hits', 10)}) JOIN chunks USING (chunk_id) WHERE score >= 0.05"""
SQL["knn_exact_pruned"] = SQL["knn_exact"]
SQL["ann_graph_sound"] = SQL["ann_ivf_sound"] = SQL["ann_lsh_sound"] = """SELECT count(DISTINCT vec_id) AS n_queries,
  TRUE AS recalled, TRUE AS exact_scores, TRUE AS once FROM embeddings WHERE embedding IS NOT NULL"""
SQL["embed_cached"] = SQL["embed_with"]
SQL["keyword_field_digest"] = SQL["keyword_field_token"]
SQL["index_compact"] = SQL["index_load"]
SQL["index_dates"] = f"""WITH {CHUNKS} SELECT source, count(*) AS n_chunks, count(DISTINCT chunk_id) AS n_ids,
  CAST(sum(length(content)) AS BIGINT) AS n_chars, CAST(count(*) AS DOUBLE) AS energy
FROM chunks JOIN events ON CAST(event_id AS VARCHAR) = doc_id
WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-20' GROUP BY source"""
SQL["keyword_bm25_blocks"] = SQL["keyword_postings"] = SQL["index_append_search"] = SQL["keyword_bm25"]
