"""Readers of small inputs: golden question sets and session metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.config import SESSION_SEPARATOR
from sedgewren.operators.dialogue import session_text

GOLDEN = "topk int, questions array<struct<q:string, expect_sources:array<string>, expect_keywords:array<string>, must:boolean>>"


def golden_set(spark: SparkSession, path: str, top_k: int = 3) -> DataFrame:
    """query_id, query, expect_sources, expect_keywords, must, topk; the file's topk wins over the parameter."""
    q = spark.read.schema(GOLDEN).option("multiLine", True).json(path).select(F.coalesce("topk", F.lit(top_k)).alias("topk"), F.posexplode("questions").alias("query_id", "q"))
    empty = F.expr("cast(array() as array<string>)")
    return q.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("q.q", F.lit("")).alias("query"), F.coalesce("q.expect_sources", empty).alias("expect_sources"), F.coalesce("q.expect_keywords", empty).alias("expect_keywords"), F.coalesce("q.must", F.lit(False)).alias("must"), "topk")


def session(spark: SparkSession, path: str) -> DataFrame:
    """model_path, need_close, turns of session files: three lines, turns separated by U+001F, empty ones left out.

    The line break that ends the file is no part of the last turn."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("l"))
    return lines.select(F.get("l", F.lit(0)).alias("model_path"), (F.get("l", F.lit(1)) == "1").alias("need_close"), F.filter(F.split(F.coalesce(F.array_join(F.slice("l", F.lit(3), F.size("l")), "\n"), F.lit("")), SESSION_SEPARATOR), lambda t: t != "").alias("turns"))


def write_session(spark: SparkSession, path: str, model_path: str, need_close: bool, turns: list[str]) -> None:
    text = "\n".join([model_path, str(int(need_close)), SESSION_SEPARATOR.join(turns)])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def restorable(sessions: DataFrame, model_path: str, system: str = "", count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sessions of the same model. With a column n_tokens, of what the saved state has taken in, and count, the number of
    tokens of a text, only those whose text has just as many: others were saved with other settings."""
    same = sessions.where(F.trim("model_path") == model_path.strip())
    if count is None or "n_tokens" not in sessions.columns:
        return same
    return same.where(count(session_text(F.col("turns"), F.col("need_close"), F.lit(system))) == F.col("n_tokens"))
