"""Hybrid retrieval: nearest vectors, gate, BM25 on the candidates, min-max scaling, weighted sum, top k, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.config import CONTEXT_HEADER, DEFAULT, QUERY_PREFIX, RetrievalConfig
from sedgewren.operators.index import Index
from sedgewren.operators.lexical import bm25_scores, ranked
from sedgewren.operators.vector import cosine_topk, gate


def fuse(candidates: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """candidates: query_id, chunk_id, v, b. Adds score; a leg without spread counts 0."""
    w = Window.partitionBy("query_id")
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
    return candidates.withColumn("score", config.alpha * scaled("v") + (1 - config.alpha) * scaled("b"))


def retrieve(index: Index, queries: DataFrame, config: RetrievalConfig = DEFAULT, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """queries: query_id, query, vec. Returns the hits (query_id, chunk_id, v, b, score, rank) of the queries that pass
    the gate, and the gate of all queries. Candidates are cut before their texts are joined. With a folder that all
    machines share they are written there first, so that the vectors are searched once and not for each use.
    """
    pool = cosine_topk(index.chunks, queries, config.pool)
    if folder:
        pool.write.parquet(folder)
        pool = pool.sparkSession.read.schema(pool.schema).parquet(folder)
    passed = gate(pool, config)
    used = pool.join(passed.where("used").select("query_id"), "query_id", "left_semi").select("query_id", "chunk_id", F.col("score").alias("v"))
    lexical = bm25_scores(index, queries, config, within=used).withColumn("b", F.round("score", 6)).drop("score")
    candidates = used.join(lexical, ["query_id", "chunk_id"], "left").fillna(0.0, ["b"])
    return ranked(fuse(candidates, config), config.top_k), passed


def contexts(hits: DataFrame, passed: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, used, best_vector_score, sources, scores, context: one row per query, an empty context if unused.

    sources keeps one entry per hit, repeated ones included.
    """
    texts = hits.join(chunks.select("chunk_id", "source", "text"), "chunk_id")
    hit = F.sort_array(F.collect_list(F.struct("rank", "source", "score", "text")))
    blocks = F.transform("hits", lambda h: F.concat(h["rank"].cast("string"), F.lit(". (来源："), h["source"], F.lit(")\n"), h["text"], F.lit("\n\n")))
    per_query = texts.groupBy("query_id").agg(hit.alias("hits"))  # at most top_k hits each
    per_query = per_query.select("query_id", F.col("hits.source").alias("sources"), F.col("hits.score").alias("scores"), F.concat(F.lit(CONTEXT_HEADER), F.array_join(blocks, "")).alias("context"))
    empty = {"sources": "cast(array() as array<string>)", "scores": "cast(array() as array<double>)", "context": "''"}
    return passed.join(per_query, "query_id", "left").select("query_id", "used", "best_vector_score", *(F.coalesce(c, F.expr(e)).alias(c) for c, e in empty.items()))


def embedded(queries: DataFrame, embed: Callable[[Column], Column], prefix: str = QUERY_PREFIX) -> DataFrame:
    """queries (query_id, query) with vec, of the query after the prefix that the encoder was trained with; null where
    there is nothing to embed."""
    return queries.withColumn("vec", F.when(F.length(F.trim("query")) > 0, embed(F.concat(F.lit(prefix), F.col("query")))))


def answer(index: Index | None, queries: DataFrame, embed: Callable[[Column], Column], config: RetrievalConfig = DEFAULT) -> DataFrame:
    """Retrieval from text: query_id, used, best_vector_score, sources, scores, context of queries (query_id, query).

    Every query has a row. Without an index, or where a query cannot be embedded, nothing is used, there is no score,
    and `metrics` logs nothing.
    """
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    nothing = {"used": F.lit(False), "best_vector_score": F.lit(None).cast("double"), "sources": empty("string"), "scores": empty("double"), "context": F.lit("")}
    ids = queries.select("query_id")
    if index is None:
        return ids.select("query_id", *(c.alias(n) for n, c in nothing.items()))
    hits, passed = retrieve(index, embedded(queries, embed), config)
    found = contexts(hits, passed, index.chunks)
    return ids.join(found, "query_id", "left").select("query_id", *(F.coalesce(F.col(n), c).alias(n) for n, c in nothing.items()))


def metrics(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query, used, best_vector_score, chunks, sources: what is logged for each query that was searched; one that could
    not be embedded was not."""
    return results.where(F.col("best_vector_score").isNotNull()).join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "used", "best_vector_score", F.size("sources").cast("long").alias("chunks"), "sources")


def log_metrics(rows: DataFrame, path: str | None, latency_ms: float) -> None:
    """Append one JSON line per query, with the time (UTC) and the latency; without a path nothing is logged."""
    if path:
        stamped = rows.drop("query_id").withColumn("ts", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).withColumn("latency_ms", F.lit(latency_ms))
        stamped.select("ts", "query", "used", "best_vector_score", "latency_ms", "chunks", "sources").write.mode("append").json(path)
