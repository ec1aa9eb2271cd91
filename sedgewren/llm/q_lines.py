from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.common import documents
from sedgewren.llm.lines import dedup_chunks, dedup_runs


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(documents(spark, sf_dir))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_runs(documents(spark, sf_dir))


QUERIES = {"op6_line_dedup": op6_line_dedup, "op6_line_runs": op6_line_runs}
ORACLES = {
    "op6_line_dedup": r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, md5(coalesce(text, '')) AS text_md5, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT r, doc_id, text_md5, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM d),
    h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
    e AS (SELECT *, i = n OR ((coalesce(lag(h) OVER w, 0) % 2147483647) * 1000003 + h) % 2147483647 % 4 = 0 AS ends FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
    c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM e),
    k AS (SELECT r, doc_id, text_md5, no, min(i) AS start, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY ALL),
    o AS (
      SELECT *, size > 1 AND regexp_matches(chunk, '[^\x20\x09-\x0D]') AS whole,
             row_number() OVER (PARTITION BY size > 1 AND regexp_matches(chunk, '[^\x20\x09-\x0D]'), chunk ORDER BY doc_id, text_md5, start) > 1 AS again
      FROM k)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(o.chunk, chr(10) ORDER BY o.start) FILTER (NOT (whole AND again)), '') END AS text,
           CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) END AS n_lines,
           coalesce(sum(o.size) FILTER (whole AND again), 0)::BIGINT AS n_removed, count(*) FILTER (whole AND again) AS n_chunks_removed
    FROM d JOIN o USING (r) GROUP BY d.r, d.doc_id, d.text, d.lines""",
    "op6_line_runs": r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, md5(coalesce(text, '')) AS text_md5, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT r, doc_id, text_md5, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
    p AS (SELECT *, lead(line) OVER (PARTITION BY r ORDER BY i) AS next FROM l),
    o AS (
      SELECT *, first_value({'id': doc_id, 'text_md5': text_md5, 'i': i}) OVER (PARTITION BY line, next ORDER BY doc_id NULLS LAST, text_md5, i) AS f
      FROM p WHERE next IS NOT NULL AND regexp_matches(line || next, '[^\x20\x09-\x0D]')),
    g AS (SELECT r, i FROM o WHERE NOT (doc_id IS NOT DISTINCT FROM f.id AND text_md5 = f.text_md5 AND i - f.i IN (0, 1))),
    m AS (SELECT DISTINCT r, i + k AS i FROM g, (VALUES (0), (1)) AS t(k)),
    x AS (SELECT l.*, m.i IS NOT NULL AS gone FROM l LEFT JOIN m USING (r, i)),
    y AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM x)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(y.line, chr(10) ORDER BY y.i) FILTER (NOT gone), '') END AS text,
           CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) END AS n_lines,
           count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs_removed
    FROM d JOIN y USING (r) GROUP BY d.r, d.doc_id, d.text, d.lines""",
}
