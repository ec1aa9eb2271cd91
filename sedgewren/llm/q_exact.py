from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.common import documents
from sedgewren.llm.exact import exact_groups


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {
    "op9_exact_dedup": r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY ALL)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
}
