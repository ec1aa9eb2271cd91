"""Live conversations: turns arrive as a stream, and each conversation's prompt follows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.operators.dialogue import ASSISTANT_OPEN, rendered, tokens
from sedgewren.streaming.timers import STORE


class Conversation(StatefulProcessor):
    """Keeps the turns of a conversation that its context has room for, as `operators.dialogue.evict` does for all turns.

    A turn that goes would go later too, as what comes after it only grows; so what is kept is bounded by the context, but
    for system turns. A late turn that is not newer than one that has gone, goes.
    """

    def __init__(self, room: int):
        self.room = room

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, system boolean, turn_text string, n_tokens long")
        self.seen = handle.getValueState("seen", "n long, gone long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        n, gone = tuple(self.seen.get()) if self.seen.exists() else (0, None)
        for frame in rows:
            n += len(frame)
            turns += list(zip(*(frame[c].tolist() for c in ("turn", "system", "turn_text", "n_tokens")), strict=True))
        system = sorted(t for t in turns if t[1])
        history = sorted((t for t in turns if not t[1] and (gone is None or t[0] > gone)), reverse=True)
        kept, used = [], 0
        for t in history:
            used += t[3]
            if kept and used > self.room:
                gone = t[0] if gone is None else max(gone, t[0])
                break
            kept.append(t)
        kept.reverse()
        if system or kept:
            self.turns.put(system + kept)
        self.seen.update((n, gone))
        prompt = "".join(t[2] for t in system + kept) + ASSISTANT_OPEN
        yield pd.DataFrame({"conv_id": [key[0]], "n_seen": [n], "n_kept": [len(system) + len(kept)], "prompt": [prompt]})

    def close(self) -> None:
        pass


def live_prompts(spark: SparkSession, turns: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """conv_id, n_seen, n_kept, prompt of a stream of turns (conv_id, turn, role, text; each turn once): after each batch
    the prompt of each conversation that it has turns of, the same as `operators.dialogue.prompts` gives for all turns so
    far, however they are split into batches. State is in the checkpoint, and kept by RocksDB, which this sets for the
    session."""
    spark.conf.set(*STORE)
    text = rendered(F.col("role"), F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", (F.col("role") == "system").alias("system"), text.alias("turn_text"))
    rows = rows.withColumn("n_tokens", F.when(F.col("system"), F.lit(0).cast("long")).otherwise(tokens(F.col("turn_text"))))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversation(config.n_ctx - config.max_tokens), f"conv_id {kind}, n_seen long, n_kept long, prompt string", "Update", "None")
