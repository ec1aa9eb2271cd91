from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import documents
from sedgewren.llm.mixing import mix, mix_keys, source_targets

WEIGHTS, SHARE, MOST_PASSES = (5, 2, 1), 1.5, 2


def mixed(docs: DataFrame) -> DataFrame:
    keys = mix_keys(docs)
    return mix(keys, source_targets(keys, WEIGHTS, SHARE, MOST_PASSES)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def mixing_sql(docs: str = "documents") -> str:
    """Sorts what the operator finds by histograms, over the table or common table expression docs."""
    return rf"""
    WITH k AS (
      SELECT doc_id, source, text, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS a
      FROM {docs}),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
    w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
    c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at FROM w),
    r AS (
      SELECT *, coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
             sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
      FROM c),
    v AS (SELECT *, (budget - caps_before) / weight_left AS level FROM r),
    f AS (SELECT first(level ORDER BY full_at) AS final FROM v WHERE full_at >= level),
    t AS (SELECT source, source_size, least(cap, final * weight) AS target FROM v, f),
    g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
    o AS (
      SELECT k.*, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size AS goal,
             sum(size) OVER (PARTITION BY k.source ORDER BY a ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target,
           (size * (passes + CASE WHEN upto < goal OR (upto - size < goal AND upto - goal < goal - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM o"""


QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": mixing_sql()}
