"""Bounded samples of labelled documents, and classifiers that are fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; of a null id, -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(folds)).cast("int"), F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], skip_fold: int, folds: int, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """text, label of at most per_class[label] labelled documents of each label, and the number of all of them by label.

    Rows of the skipped fold, null ids and null texts are left out. Documents are drawn by the smallest hashes of their
    ids, so they are the same on every run; of an id with several texts the one with the smallest hash is drawn. An id
    with several labels has the largest; one without, or with another label, has none. Texts of any length take part
    whole. No rows give no rows.
    """
    known = labels.where(fold(id_column, folds) != skip_fold).where(F.col(label).isin(*per_class)).groupBy(F.col(id_column).alias("id")).agg(F.max(label).cast("int").alias("label"))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("text").isNotNull()).withColumn("hash", F.xxhash64("text"))
    there = rows.groupBy("id").agg(F.min("hash").alias("hash")).join(known, "id")
    counts = {r["label"]: r["count"] for r in there.groupBy("label").count().collect()}
    order = F.xxhash64("id"), F.col("id")
    drawn = None
    for k, most in per_class.items():
        some = there.where(F.col("label") == k).orderBy(*order).limit(most)
        drawn = some if drawn is None else drawn.unionByName(some)
    # At most sum(per_class) rows of three numbers are sent.
    texts = rows.join(F.broadcast(drawn), ["id", "hash"]).dropDuplicates(["id"])
    return texts.select("id", "text", "label"), counts


def fitted_parts(sample: DataFrame, counts: dict[int, int], train: Callable[[pa.Table, dict[int, int], int], object], parts: int) -> list:
    """train(text and label of the sample in a fixed order, counts, part) for each part, each in a task of its own that has
    the whole sample: it never reaches the driver, which gets the models only. A task that is lost runs again and gives
    the same."""
    schema = pa.schema([("text", pa.string()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if part := [b.column("part")[0].as_py() for b in held if b.num_rows][:1]:
            table = pa.Table.from_batches([b.select(["text", "label"]).cast(schema) for b in held], schema)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([pickle.dumps(train(table, counts, part[0]))], pa.binary())], names=["part", "model"])

    # Few tasks on purpose: the sample is bounded.
    each = sample.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionById(parts, "part").sortWithinPartitions(F.xxhash64("id"), "id")
    found = {r["part"]: r["model"] for r in each.select("text", "label", "part").mapInArrow(run, "part int, model binary").collect()}
    return [pickle.loads(found[k]) if found else train(schema.empty_table(), counts, k) for k in range(parts)]


def fitted(sample: DataFrame, counts: dict[int, int], train: Callable[[pa.Table, dict[int, int]], object]):
    """train(text and label of the sample in a fixed order, counts), run in one task, see `fitted_parts`."""
    return fitted_parts(sample, counts, lambda table, counts, _: train(table, counts), 1)[0]
