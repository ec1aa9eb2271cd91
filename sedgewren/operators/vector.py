"""Vector search, exact: exhaustive, or over a stored table whose groups can be left out.

Exhaustive search: blocks of queries meet each batch of vectors as matrix products. A task keeps the k best
hits of each query and passes them on at its end, so that the shuffle holds k rows per query and task, ties or not.

A stored table is dealt out by the nearest of some pivots. What a query's angle to a pivot and the least and largest angle of
its group say, by the triangle inequality, bounds the cosines in the group: groups under a query's k-th best are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions.vectors import l2_normalize
from sedgewren.operators.lexical import ranked
from sedgewren.operators.topk import Held

#: Bytes of query vectors that are sent to the workers at once; queries and vectors of one product.
BLOCK_BYTES, QUERIES_AT_ONCE, VECTORS_AT_ONCE = 16 << 20, 512, 1024
#: Pivots of a stored table, vectors that they are chosen from, and groups that a query looks into first.
PIVOTS, PIVOT_SAMPLE, FIRST_GROUPS = 64, 4096, 2


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def nearest(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score: the k largest dot products of each query (query_id, vec) with chunks (chunk_id, vec).

    Scores are rounded to six decimals; equal ones go by chunk id. Vectors must be of one length, and unit vectors for
    cosines; empty and null ones are left out.
    """
    spark = chunks.sparkSession
    known = lambda df, c: df.where(F.col(c).isNotNull() & (F.size(c) > 0))
    queries, chunks = known(queries, "vec"), known(chunks, "vec")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    n_blocks = max(1, -(-n * width * 8 // BLOCK_BYTES))
    parts = []
    for i in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).select("query_id", F.col("vec").cast("array<double>").alias("vec")).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        vec = block.column("vec")
        sent = spark.sparkContext.broadcast((block.column("query_id").to_numpy(), _matrix(vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec)))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, q = sent.value
            slices = [slice(a, a + QUERIES_AT_ONCE) for a in range(0, len(query_ids), QUERIES_AT_ONCE)]
            held = [Held(query_ids[rows], k) for rows in slices]
            for batch in batches:
                if not batch.num_rows:
                    continue
                for a in range(0, batch.num_rows, VECTORS_AT_ONCE):
                    some = batch.slice(a, VECTORS_AT_ONCE)
                    vectors, chunk_ids = _matrix(some.column("vec")).T, some.column("chunk_id").to_numpy()
                    for rows, h in zip(slices, held, strict=True):
                        h.add(np.round(q[rows] @ vectors, 6), chunk_ids)
            for h in held:
                yield from h.rows()

        parts.append(chunks.select("chunk_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(best, "query_id bigint, chunk_id bigint, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, chunk_id bigint, score double, rank int")
    return ranked(reduce(DataFrame.unionByName, parts), k)


def cosine_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    unit = lambda df: df.withColumn("vec", l2_normalize(F.col("vec")))
    return nearest(unit(chunks), unit(queries), k)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries (query_id, vec), by blocks of bounded size."""
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    n_blocks = max(1, -(-n * width * 8 // BLOCK_BYTES))
    for i in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).select("query_id", F.col("vec").cast("array<double>").alias("vec")).toArrow().combine_chunks()
        if block.num_rows:
            vec = block.column("vec")
            yield block.column("query_id").to_numpy(), _matrix(vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec)


def _known(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", l2_normalize(F.col("vec"))).where(F.col("vec").isNotNull() & (F.size("vec") > 0))


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    chosen, nearest_to = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)) and nearest_to.min() < 1 - 1e-9:
        chosen.append(int(nearest_to.argmin()))
        nearest_to = np.maximum(nearest_to, sample @ sample[chosen[-1]])
    return sample[chosen]


def write_pivoted(chunks: DataFrame, folder: str, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> None:
    """Write the unit vectors of chunks (chunk_id, vec), of one length, dealt out by their nearest pivot. Pivots are chosen
    from a sample of that many vectors, and all vectors are written; null, empty and zero ones are left out."""
    spark, known = chunks.sparkSession, _known(chunks)
    few = known.select("vec").orderBy(F.xxhash64("vec")).limit(sample).toArrow().column("vec")
    centres = _spread(_matrix(few.combine_chunks().chunk(0) if isinstance(few.combine_chunks(), pa.ChunkedArray) else few.combine_chunks()), pivots) if len(few) else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(centres)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = _matrix(batch.column("vec")) @ sent.value.T
                pivot = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(pivot)), pivot], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("vec"), pa.array(angle), pa.array(pivot)], names=["chunk_id", "vec", "angle", "pivot"])

    known.select("chunk_id", "vec").mapInArrow(dealt, "chunk_id bigint, vec array<double>, angle double, pivot bigint").write.partitionBy("pivot").parquet(f"{folder}/vectors")
    groups = spark.read.schema("angle double, pivot bigint").parquet(f"{folder}/vectors").groupBy("pivot").agg(F.min("angle").alias("least"), F.max("angle").alias("most"))
    at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "pivot bigint, centre array<double>")
    groups.join(F.broadcast(at), "pivot").coalesce(1).write.parquet(f"{folder}/pivots")  # a row for each pivot


class Pivoted:
    """Exact search over what write_pivoted has written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.vectors = spark.read.schema("chunk_id bigint, vec array<double>, pivot bigint").parquet(f"{folder}/vectors")
        rows = spark.read.parquet(f"{folder}/pivots").orderBy("pivot").collect()  # PIVOTS rows at most
        self.pivots = np.array([r["pivot"] for r in rows])
        self.centres = np.array([r["centre"] for r in rows])
        self.least, self.most = (np.array([r[c] for r in rows]) for c in ("least", "most"))
        #: After a search: pairs of a query and a group, and how many of them were compared; groups, and how many were read.
        self.pairs = self.compared = self.groups = self.read = 0

    def _of(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """The k best of each query in the groups that are wanted for it; wanted: a row for each query, a column for each group."""
        used = np.flatnonzero(wanted.any(axis=0))
        column = {int(p): i for i, p in enumerate(self.pivots)}
        sent = self.spark.sparkContext.broadcast((ids, q, wanted, column))
        self.compared += int(wanted.sum())
        self.read += len(used)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, q, wanted, column = sent.value
            slices = [slice(a, a + QUERIES_AT_ONCE) for a in range(0, len(query_ids), QUERIES_AT_ONCE)]
            held = [Held(query_ids[rows], k) for rows in slices]
            for batch in batches:
                pivot, vectors, chunk_ids = batch.column("pivot").to_numpy(), _matrix(batch.column("vec")), batch.column("chunk_id").to_numpy()
                for p in np.unique(pivot):
                    rows = np.flatnonzero(pivot == p)
                    for some, h in zip(slices, held, strict=True):
                        ask = np.flatnonzero(wanted[some, column[int(p)]])
                        if len(ask):
                            score = np.full((len(h.query_ids), len(rows)), -np.inf)
                            score[ask] = np.round(q[some][ask] @ vectors[rows].T, 6)
                            h.add(score, chunk_ids[rows])
            for h in held:
                yield from h.rows()

        return self.vectors.where(F.col("pivot").isin([int(p) for p in self.pivots[used]])).mapInArrow(best, "query_id bigint, chunk_id bigint, score double")

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """What cosine_topk gives for queries (query_id, vec). Each block of queries first looks into the groups whose
        pivots are nearest to its queries, and then into those that may hold something better."""
        parts = []
        self.pairs = self.compared = self.groups = self.read = 0
        for ids, q in _blocks(_known(queries)):
            if not len(self.pivots):
                break
            angle = np.arccos(np.clip(q @ self.centres.T, -1, 1))
            self.pairs += angle.size
            self.groups += len(self.pivots)
            first = np.zeros(angle.shape, bool)
            np.put_along_axis(first, np.argsort(angle, axis=1)[:, :FIRST_GROUPS], True, axis=1)
            found = ranked(self._of(ids, q, first, k), k).select("query_id", "chunk_id", "score").toArrow()  # k rows a query of the block
            scores = {}
            for query, score in zip(found.column("query_id").to_pylist(), found.column("score").to_pylist(), strict=True):
                scores.setdefault(query, []).append(score)
            reached = np.array([min(s) if len(s := scores.get(int(i), [])) == k else -np.inf for i in ids])
            bound = np.cos(np.maximum(0, np.maximum(angle - self.most, self.least - angle)))
            parts += [self.spark.createDataFrame(found), self._of(ids, q, ~first & (bound + 2e-6 >= reached[:, None]), k)]
        if not parts:
            return self.spark.createDataFrame([], "query_id bigint, chunk_id bigint, score double, rank int")
        return ranked(reduce(DataFrame.unionByName, parts), k)


def gate(hits: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """query_id, best_vector_score, used: whether the best chunk of each query is near enough."""
    return hits.groupBy("query_id").agg(F.max("score").alias("best_vector_score")).withColumn("used", F.col("best_vector_score") >= config.threshold)
