"""Scoring of retrieval against a golden question set, and of backends against each other."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions.embedding import Embedder
from sedgewren.functions.vectors import cosine
from sedgewren.operators.index import Index
from sedgewren.operators.lexical import bm25_topk


def judge(golden: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """golden: query_id, query, expect_sources, expect_keywords, must; hits: query_id, chunk_id, rank.

    Adds hit_sources, src_ok (any expected source), kw_ok (all keywords in the joined text), missing and must_failed.
    Nothing expected is fulfilled.
    """
    found = hits.join(chunks.select("chunk_id", "source", "text"), "chunk_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "text"))).alias("h"))
    j = golden.join(found, "query_id", "left")
    empty = F.expr("cast(array() as array<string>)")
    sources = F.coalesce(F.col("h.source"), empty)
    text = F.coalesce(F.array_join(F.col("h.text"), " "), F.lit(""))
    j = j.select("query_id", "query", F.coalesce("expect_sources", empty).alias("expect_sources"), F.coalesce("expect_keywords", empty).alias("expect_keywords"), F.coalesce("must", F.lit(False)).alias("must"), sources.alias("hit_sources"), text.alias("hit_text"))
    j = j.withColumn("src_ok", (F.size("expect_sources") == 0) | F.arrays_overlap("expect_sources", "hit_sources"))
    j = j.withColumn("missing", F.filter("expect_keywords", lambda k: ~F.contains(F.col("hit_text"), k))).withColumn("kw_ok", F.size("missing") == 0)
    return j.withColumn("must_failed", F.col("must") & ~(F.col("src_ok") & F.col("kw_ok"))).drop("hit_text")


def verdict(judged: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """One row: n, recall, keyword_rate, must_failures, passed; nothing to judge passes."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(1.0))
    out = judged.agg(F.count("*").alias("n"), rate("src_ok").alias("recall"), rate("kw_ok").alias("keyword_rate"), F.count_if("must_failed").alias("must_failures"))
    return out.withColumn("passed", (F.col("must_failures") == 0) & (F.col("recall") >= config.min_recall))


def exit_code(chunks: DataFrame | None, golden: DataFrame | None, verdict_rows: DataFrame | None) -> int:
    """2 without an index or chunks, 0 without golden questions, else 0 if passed and 1 if not."""
    if chunks is None or chunks.isEmpty():
        return 2
    if golden is None or golden.isEmpty() or verdict_rows is None:
        return 0
    return 0 if verdict_rows.first()["passed"] else 1


def agreement(pairs: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """pairs: id, a, b (vectors of two backends). Adds similarity and agrees."""
    return pairs.select("id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity")).withColumn("agrees", F.col("similarity") > config.agreement)


def agreement_verdict(agreed: DataFrame) -> DataFrame:
    """One row: n, n_agree, passed; all must agree, and a pair that has no similarity does not."""
    out = agreed.agg(F.count("*").alias("n"), F.count_if(F.coalesce("agrees", F.lit(False))).alias("n_agree"))
    return out.withColumn("passed", F.col("n") == F.col("n_agree"))


def valid_vectors(rows: DataFrame, column: str = "vec") -> DataFrame:
    """One row: n, n_valid, the rows that have a vector."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size(column), F.lit(0)) > 0).alias("n_valid"))


def sources_report(chunks: DataFrame) -> DataFrame:
    """source, chunks, chars: chunks and text length of each source."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def inspect_index(chunks: DataFrame, keyword: str | None = None, first: int = 3, hits: int = 15) -> dict[str, DataFrame]:
    """What an index holds: `sources` (most chunks first), `totals`, `first` chunks and, with a keyword, the chunks that
    have it (`keyword_hits` by source, `keyword_preview` of some). Previews are cut to 300 characters by purpose."""

    def preview(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy("chunk_id").limit(n).select("chunk_id", "source", F.length("text").alias("chars"), F.left("text", F.lit(300)).alias("preview"))

    out = {
        "sources": sources_report(chunks).orderBy(F.col("chunks").desc(), "source"),
        "totals": chunks.agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")),
        "first": preview(chunks, first),
    }
    if keyword is not None:
        having = chunks.where(F.contains("text", F.lit(keyword)))
        out |= {"keyword_hits": having.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source"), "keyword_preview": preview(having, hits)}
    return out


@dataclass
class Evaluation:
    code: int
    sources: DataFrame | None = None
    judged: DataFrame | None = None
    verdict: DataFrame | None = None


def run(index: Index | None, golden: DataFrame | None, config: RetrievalConfig = DEFAULT) -> Evaluation:
    """Inspect an index and judge lexical retrieval on golden questions: the code is 2 without an index or chunks, 0
    without questions, else 0 if they pass and 1 if not. A question set's topk, where it has one, is the number of hits."""
    if index is None or index.chunks.isEmpty():
        return Evaluation(2)
    sources = sources_report(index.chunks).orderBy("source")
    if golden is None or golden.isEmpty():
        return Evaluation(0, sources)
    if "topk" in golden.columns:
        config = replace(config, top_k=golden.agg(F.max("topk")).first()[0] or config.top_k)
    judged = judge(golden, bm25_topk(index, golden.select("query_id", "query"), config), index.chunks)
    rows = verdict(judged, config)
    return Evaluation(exit_code(index.chunks, golden, rows), sources, judged, rows)


def encode_times(make: Callable[[], Embedder], texts: list[str], rounds: int = 10, warm_ups: int = 2) -> dict[str, float]:
    """Milliseconds to embed one text at a time (mean, median, least, most over all rounds) and all at once, and how
    many have a vector; on the driver, to compare backends and thread numbers."""
    embedder = make()
    for _ in range(warm_ups):
        embedder.embed(texts[:1])

    def took(some: list[str]) -> float:
        start = time.perf_counter()
        embedder.embed(some)
        return 1000 * (time.perf_counter() - start)

    single = sorted(took([t]) for _ in range(rounds) for t in texts)
    return {
        "mean_ms": sum(single) / len(single), "median_ms": single[len(single) // 2], "least_ms": single[0], "most_ms": single[-1],
        "batch_ms": took(texts), "n_valid": int(embedder.embed(texts).any(axis=1).sum()),
    }


def thread_sweep(make: Callable[[int], Embedder], texts: list[str], threads: Sequence[int] = (1, 2, 4, 8), rounds: int = 10) -> dict[int, dict[str, float]]:
    """encode_times of the encoder that make gives for each number of threads."""
    return {n: encode_times(lambda n=n: make(n), texts, rounds) for n in threads}


#: Of `latency_summary`: one in so many ranks is how far an estimated percentile may be off.
_ACCURACY = 10_000


def latency_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, median (the upper one), least, most.

    The median is exact: estimated percentiles on both sides of it, whose error is bounded, leave a few of 10,000 ranks
    of a group, and only the values between them are counted and put in order.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(value).alias("v"))
    around = F.percentile_approx("v", [0.5 - 3 / _ACCURACY, 0.5 + 3 / _ACCURACY], _ACCURACY)
    per_group = rows.groupBy("g").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), around.alias("around"))
    bounds = per_group.select(F.col("g").alias("h"), F.floor(F.col("n") / 2).alias("place"), F.col("around")[0].alias("low"), F.col("around")[1].alias("high"))
    near = rows.join(bounds, F.col("g").eqNullSafe(F.col("h"))).where("v <= high")
    # All that is under the bounds is one value: it only counts.
    counts = near.groupBy("h", "place", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("median")).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy("h").orderBy(F.col("median").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("times"))
    median = counts.withColumn("upto", upto).where(at).select("h", "median")
    joined = per_group.join(median, F.col("g").eqNullSafe(F.col("h")), "left")
    return joined.select(F.col("g").alias(group), "n", "mean", "median", "least", "most")
