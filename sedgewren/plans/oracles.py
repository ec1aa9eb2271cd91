"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from sedgewren.config import DEFAULT, QUERY_PREFIX, SYSTEM_PROMPT
from sedgewren.functions.text import CJK, ENTITIES, SPACE
from sedgewren.plans.catalog import EMBED_WIDTH, KEYWORD, SEARCH_K
from sedgewren.plans.literals import CJK_LITERALS


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _terms(x: str) -> str:
    return rf"list_transform(regexp_extract_all(regexp_replace({x}, '([{CJK}])', ' \1 ', 'g'), '[{CJK}]|[\p{{L}}\p{{N}}]+'), lambda t: lower(t))"


def _normalize(x: str) -> str:
    return _trim(f"regexp_replace(regexp_replace({x}, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _strip(x: str) -> str:
    out = f"regexp_replace(replace(replace({x}, '</w:p>', chr(10)), '<w:br/>', chr(10)), '<[^>]*>', '', 'g')"
    for entity, character in ENTITIES:
        quoted = character.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return _normalize(out)


_CHUNKS = f"""
    pieces AS (SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;\\r\\n]+'), lambda p: {_trim("p")}), lambda p: p <> '') AS p FROM documents),
    folded AS (SELECT doc_id, source, list_reduce(list_transform(p, lambda x: {{'now': x, 'done': []::VARCHAR[]}}), lambda s, x:
      CASE WHEN s.now <> '' AND length(s.now) + length(x.now) > {DEFAULT.chunk_size}
           THEN {{'now': right(s.now, {DEFAULT.chunk_overlap}) || x.now, 'done': list_append(s.done, {_trim("s.now")})}}
           ELSE {{'now': s.now || x.now, 'done': s.done}} END, {{'now': '', 'done': []::VARCHAR[]}}) AS f FROM pieces),
    listed AS (SELECT doc_id, source, list_filter(list_append(f.done, {_trim("f.now")}), lambda c: c <> '') AS c FROM folded),
    chunks AS (SELECT doc_id * 1048576 + i - 1 AS chunk_id, doc_id, i - 1 AS pos, source, c[i] AS text FROM (SELECT doc_id, source, c, unnest(range(1, len(c) + 1)) AS i FROM listed))"""


def _index(chunks: str) -> str:
    return f"""
    toks AS (SELECT chunk_id, {_terms("text")} AS t FROM {chunks}),
    doc_len AS (SELECT chunk_id, len(t) AS dl FROM toks),
    postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM toks) GROUP BY ALL),
    term_df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    stats AS (SELECT count(*) AS n_docs, coalesce(avg(dl), 0) AS avgdl FROM doc_len)"""


def _bm25(queries: str) -> str:
    return f"""
    asked AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({_terms("query")}) AS term FROM {queries}) GROUP BY ALL),
    lexical AS (SELECT query_id, chunk_id, round(sum(m * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * {DEFAULT.k1 + 1} / (tf + {DEFAULT.k1} * (1 - {DEFAULT.b} + {DEFAULT.b} * dl / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END)))), 6) AS score
      FROM asked JOIN postings USING (term) JOIN term_df USING (term) JOIN doc_len USING (chunk_id), stats GROUP BY ALL)"""


_BENCH = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_TOP = f"topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lexical) WHERE rank <= {DEFAULT.top_k} AND score > 0)"
_SEARCH = f"WITH {_CHUNKS}, {_index('chunks')}, {_BENCH}, {_bm25('queries')}, {_TOP}"

_FOLLOWED = f"""WITH
    firsts AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS no FROM documents WHERE doc_id % 5 <> 0),
    fresh AS (SELECT doc_id AS id, (SELECT count(*) FROM firsts) + row_number() OVER (ORDER BY doc_id) - 1 AS no FROM documents WHERE doc_id % 5 IN (0, 1)),
    live AS (SELECT no AS doc_id, source, CASE WHEN documents.doc_id % 5 = 1 THEN text || ' revised' ELSE text END AS text FROM documents
      JOIN (SELECT * FROM fresh UNION ALL SELECT * FROM firsts WHERE id % 5 IN (3, 4)) AS f ON documents.doc_id = f.id),
    {_CHUNKS.replace("FROM documents", "FROM live")}, {_index('chunks')}, {_BENCH}, {_bm25('queries')}, {_TOP}"""

_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
_VEC = f"""
    v AS (SELECT vec_id AS chunk_id, {_UNIT} AS vec, label FROM embeddings),
    sims AS (SELECT q.chunk_id AS query_id, v.chunk_id, round(list_dot_product(q.vec, v.vec), 6) AS score, q.label AS asked, v.label FROM v AS q, v WHERE q.chunk_id % 20 = 0),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims)"""

_HYBRID = f"""WITH
    al AS (SELECT doc_id AS chunk_id, source, text, {_UNIT} AS vec FROM documents JOIN embeddings ON doc_id = vec_id),
    queries AS (SELECT chunk_id AS query_id, text AS query, vec FROM al WHERE chunk_id % 20 = 0),
    {_index("al")}, {_bm25("queries")},
    sims AS (SELECT query_id, chunk_id, round(list_dot_product(q.vec, al.vec), 6) AS v FROM queries AS q, al),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id) AS r FROM sims) WHERE r <= {DEFAULT.pool}),
    passed AS (SELECT query_id, max(v) AS best_vector_score, max(v) >= {DEFAULT.threshold} AS used FROM pool GROUP BY query_id),
    cand AS (SELECT p.query_id, p.chunk_id, p.v, coalesce(l.score, 0) AS b FROM pool AS p JOIN passed USING (query_id) LEFT JOIN lexical AS l ON p.query_id = l.query_id AND p.chunk_id = l.chunk_id WHERE used),
    span AS (SELECT query_id, min(v) AS v0, max(v) AS v1, min(b) AS b0, max(b) AS b1 FROM cand GROUP BY query_id),
    fused AS (SELECT query_id, chunk_id, v, b, round({DEFAULT.alpha} * CASE WHEN v1 > v0 THEN (v - v0) / (v1 - v0) ELSE 0 END + (1 - {DEFAULT.alpha}) * CASE WHEN b1 > b0 THEN (b - b0) / (b1 - b0) ELSE 0 END, 6) AS score FROM cand JOIN span USING (query_id)),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= {DEFAULT.top_k}),
    ctx AS (SELECT query_id, string_agg(source, ',' ORDER BY rank) AS sources, count(*) AS n, '【参考资料】' || chr(10) || string_agg(rank || '. (来源：' || source || ')' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) AS context FROM hits JOIN al USING (chunk_id) GROUP BY query_id)"""

_JUDGED = f"""{_SEARCH},
    golden AS (SELECT query_id, query, source, ({_terms("query")})[1] AS kw, query_id % 2 = 0 AS must FROM queries LEFT JOIN documents ON doc_id = query_id),
    found AS (SELECT query_id, string_agg(source, ',' ORDER BY rank) AS hit_sources, list(source) AS srcs, string_agg(text, ' ' ORDER BY rank) AS hit_text FROM topk JOIN chunks USING (chunk_id) GROUP BY query_id),
    j AS (SELECT g.query_id, coalesce(hit_sources, '') AS hit_sources, coalesce(list_contains(srcs, source), false) AS src_ok, kw IS NULL OR contains(coalesce(hit_text, ''), kw) AS kw_ok, must FROM golden AS g LEFT JOIN found USING (query_id)),
    judged AS (SELECT *, must AND NOT (src_ok AND kw_ok) AS must_failed FROM j)"""

_TURN = "CASE WHEN role = 'system' AND coalesce(text, '') = '' THEN '' ELSE '<|im_start|>' || CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' ELSE 'assistant' END || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) END"
_EVICT = f"""WITH t AS (SELECT conv_id, turn, role, {_TURN} AS turn_text FROM conversations),
    n AS (SELECT *, CASE WHEN role = 'system' THEN 0 ELSE len({_terms("turn_text")}) END::BIGINT AS n_tokens FROM t),
    u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS upto_end, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM n),
    kept AS (SELECT *, role = 'system' OR upto_end + 64 <= 400 OR back = 1 AS kept FROM u)"""

#: The batches of the token counts n, in order.
_PACKED = """list_reduce(list_transform(n, lambda x: {'batch': 0, 'used': x, 'items': 0, 'out': []::INT[]}), lambda s, x:
        CASE WHEN x.used = 0 THEN {'batch': s.batch, 'used': 0::BIGINT, 'items': 0, 'out': list_append(s.out, 0)}
             WHEN s.items = 0 OR s.used + x.used > 256 OR s.items >= 8 THEN {'batch': s.batch + 1, 'used': x.used, 'items': 1, 'out': list_append(s.out, s.batch + 1)}
             ELSE {'batch': s.batch, 'used': s.used + x.used, 'items': s.items + 1, 'out': list_append(s.out, s.batch)} END, {'batch': 0, 'used': 0::BIGINT, 'items': 0, 'out': []::INT[]}).out"""

_LITERALS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(CJK_LITERALS))

#: CRC-32 by a table made by its rule.
_CRC = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS table_)"


def _hash_embed(rows: str, key: str) -> str:
    return f"""{_CRC},
    toks AS (SELECT {key}, unnest({_terms("text")}) AS term FROM {rows}),
    bytes AS (SELECT term, list_transform(regexp_extract_all(hex(encode(term)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM (SELECT DISTINCT term FROM toks)),
    hashed AS (SELECT term, xor(list_reduce(b, lambda c, x: xor(c >> 8, table_[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS h FROM bytes, crc),
    counts AS (SELECT {key}, h % {EMBED_WIDTH} AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS c FROM toks JOIN hashed USING (term) GROUP BY ALL),
    scaled AS (SELECT {key}, i, round((c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE, 5) AS x FROM counts)
    SELECT {key}, i, x FROM scaled WHERE x <> 0"""


_PIECES = """WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x{4000}-\\x{9FFF}]|[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]|[0-9A-Za-z\\x{80}-\\x{3FFF}\\x{A000}-\\x{10FFFF}]+') AS w FROM documents),
      p AS (SELECT doc_id, flatten(list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[^\\x21-\\x7E]') THEN [1] ELSE
        list_prepend(CASE WHEN starts_with(t, 'the') THEN 9 WHEN starts_with(t, 'and') THEN 10 WHEN starts_with(t, 'th') THEN 4 WHEN starts_with(t, 'er') THEN 6 ELSE 11 + 2 * (ascii(t) - 33) END,
          list_transform(regexp_extract_all(substr(t, CASE WHEN regexp_matches(t, '^(the|and)') THEN 4 WHEN regexp_matches(t, '^(th|er)') THEN 3 ELSE 2 END), 'tion|th|er|.'),
            lambda x: CASE x WHEN 'tion' THEN 8 WHEN 'th' THEN 5 WHEN 'er' THEN 7 ELSE 12 + 2 * (ascii(x) - 33) END)) END)) AS p FROM w)
      SELECT doc_id, array_to_string([2] || p[:510] || [3], ' ') AS ids FROM p"""

ORACLES = {
    "wordpiece_encode": _PIECES,
    "hash_embed": f"WITH {_CHUNKS}, {_hash_embed('chunks', 'chunk_id')}",
    "cache_file": f"""WITH {_CHUNKS}, v AS (SELECT chunk_id, count(*) AS n_parts, round(sum(x * x), 3) AS square FROM ({_hash_embed('chunks', 'chunk_id').replace(_CRC, 'WITH ' + _CRC, 1)}) GROUP BY chunk_id)
      SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS chunk_id, source, text, n_parts, square FROM chunks JOIN v USING (chunk_id)""",
    "hash_embed_queries": f"WITH {_hash_embed('benchmark', 'item_id')}",
    "valid_vectors": f"WITH {_CHUNKS}, v AS (SELECT chunk_id, x FROM ({_hash_embed('chunks', 'chunk_id').replace(_CRC, 'WITH ' + _CRC, 1)})) SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(DISTINCT chunk_id) FROM v) AS n_valid",
    "index_sources": f"WITH {_CHUNKS} SELECT source, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY source",
    "index_totals": f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT source) AS sources, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM chunks",
    "first_chunks_preview": f"WITH {_CHUNKS} SELECT chunk_id, source, length(text)::INT AS chars, left(text, 300) AS preview FROM chunks ORDER BY chunk_id LIMIT 3",
    "published_search": f"{_SEARCH} SELECT query_id, chunk_id, score, rank FROM topk",
    "incremental_search": f"{_FOLLOWED} SELECT query_id, chunk_id, score, rank FROM topk",
    "prefill_slices": f"""WITH t AS (SELECT doc_id, {_terms('text')} AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS i FROM t)
      SELECT doc_id, (i // 64)::BIGINT AS slice, count(*) AS n, sum(length(term))::BIGINT AS total FROM e GROUP BY ALL""",
    "agreement_verdict": f"WITH s AS (SELECT round(list_dot_product(a, list_reverse(a)) / (list_dot_product(a, a) + 1e-12), 6) > {DEFAULT.agreement} AS agrees FROM (SELECT embedding::DOUBLE[] AS a FROM embeddings)) SELECT count(*) AS n, count(*) FILTER (agrees) AS n_agree, count(*) = count(*) FILTER (agrees) AS passed FROM s",
    "chunk_documents": f"WITH {_CHUNKS} SELECT chunk_id, doc_id, pos, source, text FROM chunks",
    "chunk_stats_by_source": f"WITH {_CHUNKS} SELECT source, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY source",
    "tokenize_terms": f"WITH t AS (SELECT doc_id, {_terms('text')} AS t FROM documents) SELECT doc_id, i - 1 AS pos, t[i] AS term FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t)",
    "tokenize_cjk_literals": f"SELECT id::BIGINT AS id, coalesce(array_to_string({_terms('text')}, '|'), '') AS terms FROM (VALUES {_LITERALS}) AS l(id, text)",
    "term_frequency": f"WITH {_CHUNKS}, {_index('chunks')} SELECT chunk_id, term, tf FROM postings",
    "document_frequency": f"WITH {_CHUNKS}, {_index('chunks')} SELECT term, df FROM term_df",
    "corpus_stats": f"WITH {_CHUNKS}, {_index('chunks')} SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_scores": f"{_SEARCH} SELECT query_id, chunk_id, score FROM lexical",
    "bm25_topk": f"{_SEARCH} SELECT query_id, chunk_id, score, rank FROM topk",
    "cosine_topk": f"WITH {_VEC} SELECT query_id, chunk_id, score, rank FROM ranks WHERE rank <= {SEARCH_K}",
    "pivoted_topk": f"WITH {_VEC} SELECT query_id, chunk_id, score, rank FROM ranks WHERE rank <= {SEARCH_K}",
    "relevance_gate": f"WITH {_VEC} SELECT query_id, max(score) AS best_vector_score, max(score) >= 0.999 AS used FROM sims GROUP BY query_id",
    "candidate_pool": f"WITH {_VEC} SELECT query_id, count(*) AS n, min(score) AS least, max(score) AS best FROM ranks WHERE rank <= {DEFAULT.pool} GROUP BY query_id",
    "l2_normalize": f"WITH {_VEC} SELECT chunk_id AS vec_id, i - 1 AS i, round(vec[i], 6) AS x FROM (SELECT chunk_id, vec, unnest(range(1, len(vec) + 1)) AS i FROM v)",
    "pairwise_agreement": f"WITH s AS (SELECT vec_id AS id, round(list_dot_product(a, list_reverse(a)) / (list_dot_product(a, a) + 1e-12), 6) AS similarity FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)) SELECT id, similarity, similarity > {DEFAULT.agreement} AS agrees FROM s",
    "recall_at_k_by_label": f"WITH {_VEC} SELECT asked AS label, count(*) AS hits, round(avg((label = asked)::INT), 6) AS share FROM ranks WHERE rank <= {SEARCH_K} AND chunk_id <> query_id GROUP BY asked",
    "hybrid_retrieve": f"{_HYBRID} SELECT query_id, chunk_id, v, b, score, rank FROM hits",
    "hybrid_context": f"{_HYBRID} SELECT query_id, used, best_vector_score, coalesce(sources, '') AS sources, coalesce(context, '') AS context FROM passed LEFT JOIN ctx USING (query_id)",
    "grounded_prompts": f"{_HYBRID} SELECT query_id, '<|im_start|>system' || chr(10) || '{SYSTEM_PROMPT}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || CASE WHEN used THEN context ELSE '' END || query || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM passed JOIN queries USING (query_id) LEFT JOIN ctx USING (query_id)",
    "retrieval_metrics": f"{_HYBRID} SELECT query_id, query, used, best_vector_score, coalesce(n, 0) AS chunks, coalesce(sources, '') AS sources FROM passed JOIN queries USING (query_id) LEFT JOIN ctx USING (query_id)",
    "prefixed_queries": f"SELECT item_id AS query_id, '{QUERY_PREFIX}' || text AS query FROM benchmark",
    "strip_xml_pages": f"SELECT page_id, {_strip('html')} AS text FROM pages",
    "normalize_ws": f"SELECT page_id, {_normalize('html')} AS text FROM pages",
    # A prefix of a valid text ends in a whole character where the next byte starts one.
    "utf8_complete": """WITH b AS (SELECT doc_id, hex(encode(text)) AS h, doc_id * 7919 % (strlen(text) + 1) AS n FROM documents)
      SELECT doc_id, n AS n_bytes, list_max(list_filter(range(greatest(n - 3, 0), n + 1), lambda m: substr(h, 2 * m + 1, 1) NOT IN ('8', '9', 'A', 'B')))::BIGINT AS n FROM b""",
    "ascii_lower": "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents",
    "utf16_runs": r"SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(text, '[\x20-\x7E\x{00A0}-\x{00FF}\x{2000}-\x{206F}\x{3000}-\x{303F}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]{3,}'), lambda r: r || chr(10)), ''), '') AS runs FROM documents",
    "latin1_runs": r"SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x{00FF}]', '?', 'g'), '[\x20-\x7E\x{00A0}-\x{00FF}]{4,}'), lambda r: r || chr(10)), ''), '') AS runs FROM documents",
    "kb_signature": "SELECT sha1(string_agg(lpad(doc_id::VARCHAR, 12, '0') || '|' || n_chars || '|' || doc_id, '' ORDER BY lpad(doc_id::VARCHAR, 12, '0'))) AS signature FROM documents",
    "golden_eval": f"{_JUDGED} SELECT query_id, hit_sources, src_ok, kw_ok, must_failed FROM judged",
    "golden_verdict": f"{_JUDGED} SELECT count(*) AS n, round(avg(src_ok::INT), 6) AS recall, round(avg(kw_ok::INT), 6) AS keyword_rate, count(*) FILTER (must_failed) AS must_failures, count(*) FILTER (must_failed) = 0 AND avg(src_ok::INT) >= {DEFAULT.min_recall} AS passed FROM judged",
    "keyword_coverage": f"WITH {_CHUNKS} SELECT source, count(*) FILTER (contains(text, '{KEYWORD}')) AS n FROM chunks GROUP BY source",
    "keyword_chunks_preview": f"WITH {_CHUNKS} SELECT chunk_id, left(text, 300) AS preview FROM chunks WHERE contains(text, '{KEYWORD}') ORDER BY chunk_id LIMIT 15",
    "distinct_sources": f"{_HYBRID}, firsts AS (SELECT query_id, source, min(rank) AS r FROM hits JOIN al USING (chunk_id) GROUP BY ALL) SELECT query_id, coalesce(string_agg(source, ',' ORDER BY r), '') AS sources FROM passed LEFT JOIN firsts USING (query_id) GROUP BY query_id",
    "history_eviction": f"{_EVICT} SELECT conv_id, turn, n_tokens, upto_end, kept FROM kept",
    "chatml_prompt": f"{_EVICT} SELECT conv_id, count(*) AS n_kept, string_agg(turn_text, '' ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM kept WHERE kept GROUP BY conv_id",
    "debounced_rebuilds": """WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
      SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_events FROM s GROUP BY user_id, no""",
    "greedy_batches": f"""WITH {_CHUNKS}, n AS (SELECT doc_id, pos, len({_terms("text")})::BIGINT AS n FROM chunks),
      l AS (SELECT doc_id, list(n ORDER BY pos) AS n FROM n GROUP BY doc_id), f AS (SELECT doc_id, n, {_PACKED} AS b FROM l)
      SELECT doc_id, i - 1 AS pos, n[i] AS n_tokens, b[i]::BIGINT AS batch FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM f)""",
    "library_batches": f"""WITH {_CHUNKS}, n AS (SELECT chunk_id, len({_terms("text")})::BIGINT AS n FROM chunks),
      l AS (SELECT list(chunk_id ORDER BY chunk_id) AS ids, list(n ORDER BY chunk_id) AS n FROM n), f AS (SELECT ids, n, {_PACKED} AS b FROM l)
      SELECT ids[i] AS chunk_id, n[i] AS n_tokens, b[i]::BIGINT AS batch FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM f)""",
    "latency_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5 ORDER BY value DESC) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
    "docx_extract": f"SELECT doc_id, {_strip(chr(39) + '<w:p>' + chr(39) + ' || replace(replace(text, ' + chr(39) + '&' + chr(39) + ', ' + chr(39) + '&amp;' + chr(39) + '), ' + chr(39) + '<' + chr(39) + ', ' + chr(39) + '&lt;' + chr(39) + ') || ' + chr(39) + '</w:p>' + chr(39))} AS text FROM documents",
    "cache_roundtrip": "SELECT vec_id, i - 1 AS i, round(embedding[i]::DOUBLE, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
}
