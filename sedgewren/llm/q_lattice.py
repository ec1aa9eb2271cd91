from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.common import table
from sedgewren.llm.lattice import near_vectors


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
#: Compares all pairs, and follows links from every vector.
ORACLES = {
    "op12_embedding_dedup": r"""
    WITH RECURSIVE r AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    v AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM r WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.r AS a, b.r AS b FROM v AS a JOIN v AS b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.95),
    f AS (SELECT r, r AS o FROM r UNION SELECT f.r, l.b FROM f JOIN l ON f.o = l.a),
    k AS (SELECT f.r, min(vec_id) AS component_id FROM f JOIN r ON f.o = r.r GROUP BY f.r)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM r JOIN k USING (r)"""
}
