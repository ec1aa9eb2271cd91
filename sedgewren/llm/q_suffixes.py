from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import documents
from sedgewren.llm.suffixes import repeated_passages


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage of a document; documents without one have none."""
    found = repeated_passages(documents(spark, sf_dir)).withColumn("span", F.explode("spans"))
    return found.select("doc_id", "n_words", "n_repeated", F.col("span.start").cast("long").alias("first_word"), F.col("span.end").cast("long").alias("end_word"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
#: Compares every run of 50 words of every document.
ORACLES = {
    "op10_suffix_dedup": r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    x AS (SELECT r, s, md5(array_to_string(w[s : s + 49], ' ')) AS run FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 48, 1))) AS s FROM d)),
    e AS (SELECT r, s FROM x JOIN (SELECT run FROM x GROUP BY run HAVING min(r) <> max(r)) USING (run)),
    g AS (SELECT *, coalesce(s > lag(s) OVER w + 50, true)::INT AS new FROM e WINDOW w AS (PARTITION BY r ORDER BY s)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM g),
    p AS (SELECT r, min(s) - 1 AS first_word, max(s) + 49 AS end_word FROM n GROUP BY r, span)
    SELECT doc_id, len(w)::BIGINT AS n_words, (sum(end_word - first_word) OVER (PARTITION BY r))::BIGINT AS n_repeated, first_word, end_word FROM p JOIN d USING (r)"""
}
