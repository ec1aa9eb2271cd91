"""A corpus pipeline of five operators over the documents table, each stage on all that the one before it kept.

Rows of every stage are told apart by a number of their own, so ids may repeat or be null, texts may be null, empty or
of any length, and columns may have any names: each row is kept or goes by itself, and equal rows are kept or go alike
unless a stage says otherwise. A stage of no rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import documents, forget, materialise, scope
from sedgewren.llm.mixing import mix, mix_keys, source_targets
from sedgewren.llm.near import jaccard_links
from sedgewren.llm.postings import decontaminate
from sedgewren.llm.q_mixing import MOST_PASSES, SHARE, WEIGHTS
from sedgewren.llm.q_sharding import shards
from sedgewren.llm.toxicity import score_toxicity, toxicity_model

TOXIC = 0.3


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written so that the number stays, and its name: ids may repeat or be null."""
    row = _unused(docs, "row_number")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under TOXIC stay; nothing is learnt from labels outside the training folds. Null and empty
    texts score like a text without a toxic word."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _unused(docs, "score")
    return score_toxicity(docs, model, score=score).where(F.col(score) < TOXIC).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of five-word shingles tie together, the one with the smallest id stays (null last), and
    of equal rows one. Null, empty and wordless texts are tied to nothing and stay."""
    rows, row = _numbered(docs)
    links = materialise(jaccard_links(rows, id_column=row).withColumnsRenamed({"doc_id": row, "class_id": "class"}), "links")
    ids = rows.select(row, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("order"))
    # Rows alone in their class stay in any case.
    grouped = links.where(F.col("n_links") > 0).join(ids, row)
    # Written before the join, so that adaptive execution can split a large class.
    first = materialise(grouped.groupBy("class").agg(F.min("order").alias("first")), "first")
    gone = grouped.join(first, "class").where(F.col("order") != F.col("first")).select(row)
    return rows.join(gone, row, "left_anti").drop(row)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; an empty benchmark takes none."""
    rows, row = _numbered(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column=row)
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").drop(row)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is a source like others; texts
    without words weigh nothing, and the mix may take or leave them."""
    rows, row = _numbered(docs)
    keys, passes = mix_keys(rows, id_column=row), _unused(docs, "passes")
    taken = mix(keys, source_targets(keys, WEIGHTS, SHARE, MOST_PASSES)).where("passes > 0").select(F.col("id").alias(row), F.col("passes").alias(passes))
    return rows.join(taken, row).withColumn(passes, F.explode(F.sequence(F.lit(1).cast("long"), passes))).select(*docs.columns)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard and slot, see the operator. Every row is placed, repeated ones included."""
    return shards(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed_to_weights),
    ("sharding", into_shards),
]

#: SQL cannot train or apply the classifier of the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next. What a stage has
    written in between, and what it has read, is deleted when its rows are there."""
    docs, read = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs, before = materialise(stage(spark, docs, sf_dir), name), read
            read = keep()
        if before:
            forget(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
