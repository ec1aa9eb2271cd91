"""Chat prompts: turn templates, history within a token budget, whole prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, SYSTEM_PROMPT, RetrievalConfig
from sedgewren.functions.text import terms


def system_turn(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit("<|im_start|>system\n"), text, F.lit("<|im_end|>\n")))


def user_turn(text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>user\n"), text, F.lit("<|im_end|>\n"))


def assistant_turn(text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>assistant\n"), text, F.lit("<|im_end|>\n"))


ASSISTANT_OPEN, CLOSE = "<|im_start|>assistant\n", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.when(role == "system", system_turn(text)).when(role == "user", user_turn(text)).otherwise(assistant_turn(text))


def tokens(text: Column) -> Column:
    """A count that adds up over turns, since every turn ends in a mark: the number of search terms."""
    return F.size(terms(text)).cast("long")


def evict(turns: DataFrame, config: RetrievalConfig = DEFAULT, include_system: bool = False) -> DataFrame:
    """turns: conv_id, turn, role, text. Adds turn_text, n_tokens, upto_end, kept.

    The last turn of a conversation is its new input. The oldest turns go, whole, until the rest, the input and the
    reply fit into the context; system turns are not history and are kept. If nothing fits, only the input is left.
    System turns take no part of the budget, unless include_system says that they do.
    """
    reserved = F.sum(F.when(F.col("role") == "system", tokens(F.col("turn_text"))).otherwise(0)).over(Window.partitionBy("conv_id")) if include_system else F.lit(0)
    t = turns.withColumn("turn_text", rendered(F.col("role"), F.coalesce("text", F.lit("")))).withColumn("n_tokens", F.when(F.col("role") == "system", 0).otherwise(tokens(F.col("turn_text"))))
    newest_first = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    t = t.withColumn("upto_end", F.sum("n_tokens").over(newest_first.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("upto_end") + reserved + config.max_tokens <= config.n_ctx
    return t.withColumn("kept", (F.col("role") == "system") | fits | (F.row_number().over(newest_first) == 1))


def prefill_slices(ids: Column, most: int = 512) -> Column:
    """array<array>: the token ids in order, in slices of at most `most`, as an encoder takes them in."""

    def slices(x: Column) -> Column:
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.lit(most))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.slice(x, i, F.lit(most)))

    # As an element of an array the ids have a name: an expression inside `slices` would be worked out for each slice.
    return F.get(F.transform(F.array(ids), slices), F.lit(0))


def session_text(turns: Column, need_close: Column, system: Column) -> Column:
    """The text that a saved session has taken in: its system turn and all turns, without the closing mark of the last
    turn where that is still to come."""
    text = F.concat(system_turn(system), F.array_join(turns, ""))
    return F.when(need_close & (F.size(turns) > 0), F.left(text, F.length(text) - len(CLOSE))).otherwise(text)


def prompts(turns: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """conv_id, n_kept, prompt: system turns, the kept history and input, and the opening of the reply."""
    kept = evict(turns, config).where("kept")
    # Bounded by the context for all but the system turns of one conversation.
    ordered = F.sort_array(F.collect_list(F.struct(F.when(F.col("role") == "system", 0).otherwise(1).alias("k"), "turn", "turn_text")))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_kept"), F.concat(F.array_join(F.transform(ordered, lambda x: x["turn_text"]), ""), F.lit(ASSISTANT_OPEN)).alias("prompt"))


def grounded_prompts(results: DataFrame, queries: DataFrame, system: str = SYSTEM_PROMPT) -> DataFrame:
    """query_id, prompt: the first turn of a chat about each query, its context put before the query where one was used."""
    both = results.select("query_id", "used", "context").join(queries.select("query_id", "query"), "query_id")
    asked = F.concat(F.when(F.col("used"), F.col("context")).otherwise(""), F.col("query"))
    return both.select("query_id", F.concat(system_turn(F.lit(system)), user_turn(asked), F.lit(ASSISTANT_OPEN)).alias("prompt"))
