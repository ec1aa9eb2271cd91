from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.common import documents
from sedgewren.llm.variants import count_words, variant_forms


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_forms(count_words(documents(spark, sf_dir)))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
#: Words are near if one without a character is the other, or if both are the same with a character at one place left open.
ORACLES = {
    "op13_spelling_variants": r"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS table_),
    t AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
    r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM t WHERE length(run) >= 6 GROUP BY ALL),
    b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM r),
    h AS (SELECT *, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, table_[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS h FROM b, crc),
    x AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM x WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    p AS (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w),
    o AS (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS open, left(word, i - 1) || substr(word, i + 1) AS less FROM p),
    d AS (SELECT DISTINCT o.word AS a, o.n AS n_a, w.word AS b, w.n AS n_b FROM o JOIN w ON o.less = w.word),
    s AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM o AS a JOIN o AS b ON a.open = b.open AND a.word <> b.word UNION ALL SELECT a, n_a, b, n_b FROM d UNION ALL SELECT b, n_b, a, n_a FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM s),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN k ON w.word = k.word AND place = 1),
    c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.next = f.word)
    SELECT f.word, form, root, f.n, n_near, form_n FROM f JOIN c ON f.word = c.word AND c.next IS NULL"""
}
