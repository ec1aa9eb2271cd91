from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import documents
from sedgewren.llm.sharding import histogram_shards, shard_keys

N_SHARDS, LAW = 40, "bytes"


def shards(docs: DataFrame) -> DataFrame:
    placed = histogram_shards(shard_keys(docs), N_SHARDS, LAW)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))


#: Sorts what the operator finds by histograms, and computes each CRC-32 byte by byte with a table made by its rule.
SHARDING_SQL = rf"""
    WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS table_),
    k AS (
      SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 16 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS a,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS b FROM documents),
    s AS (SELECT *, row_number() OVER (ORDER BY a, b) AS place, sum(size) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM k),
    p AS (
      SELECT *, list_sum(list_transform(range(1, {N_SHARDS}), lambda t: CASE WHEN upto < total::DOUBLE * t / {N_SHARDS} OR (upto - size < total::DOUBLE * t / {N_SHARDS}
        AND upto - total::DOUBLE * t / {N_SHARDS} < total::DOUBLE * t / {N_SHARDS} - (upto - size)) THEN 0 ELSE 1 END))::INT AS shard FROM s),
    b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM p)
    SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, table_[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32,
           '{LAW}' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
    FROM b, crc"""

QUERIES = {"op2_sharding": op2_sharding}
ORACLES = {"op2_sharding": SHARDING_SQL}
