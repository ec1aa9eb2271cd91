from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.common import documents
from sedgewren.llm.near import jaccard_links


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(documents(spark, sf_dir))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
#: Counts the shared shingles of all pairs that share one, and follows links from every document.
ORACLES = {
    "op3_jaccard_join": r"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    s AS (SELECT DISTINCT r, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    c AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN n AS na ON a = na.r JOIN n AS nb ON b = nb.r WHERE common >= 0.8 * (na.n + nb.n - common)),
    f AS (SELECT r, r AS o FROM d UNION SELECT f.r, l.b FROM f JOIN l ON f.o = l.a),
    k AS (SELECT f.r, min(doc_id) AS class_id FROM f JOIN d ON f.o = d.r GROUP BY f.r)
    SELECT doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = d.r) AS n_links FROM d JOIN k USING (r)"""
}
