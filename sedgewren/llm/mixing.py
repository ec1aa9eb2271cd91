"""Mixing sources to target weights by nested hash thresholds.

Each row has a uniform key from its id and text. A source takes whole passes over its rows, then one more pass over
the rows whose key is under a threshold, which histograms of size by source and key range find without a sort. A
larger budget moves the threshold up, so a smaller mix is always part of a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import hex_key, materialise, text_or_empty
from sedgewren.llm.histogram import PARTS, below, thresholds

#: A run of these is a word.
WORD = r"[^\x20\x09-\x0D]+"


def mix_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One narrow row per document: id, source, size in words, and the key that thresholds compare."""
    text = text_or_empty(text_column)
    identity = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    return materialise(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            hex_key(identity).alias("a"),
            F.lit(0).cast("long").alias("b"),
            hex_key(F.monotonically_increasing_id().cast("string")).alias("c"),
        ),
        "mix-keys",
    )


def source_targets(keys: DataFrame, weights: Sequence[float], share: float, most_passes: float) -> DataFrame:
    """source, source_size, target: the sources, by code point with null last, weigh `weights` in turn and share
    `share` of all sizes; none exceeds most_passes times its own size, and what is over goes to the others by weight.

    The level L at which every source gets min(most_passes * size, L * weight) and all is handed out is found from
    running sums over the sources, which are few next to the rows.
    """
    sizes = keys.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1).alias("weight"))
    capped = weighed.withColumn("cap", F.col("source_size") * float(most_passes)).withColumn("at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("at", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    run = capped.select(
        "source", "source_size", "weight", "cap", "at",
        F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("caps_before"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
        (F.sum("source_size").over(everything) * float(share)).alias("budget"),
    )
    level = run.withColumn("level", (F.col("budget") - F.col("caps_before")) / F.col("weight_left"))
    # The first source whose cap is not reached sets the level of itself and all after it.
    level = level.withColumn("final", F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", "level"))).over(everything)["level"])
    return level.select("source", "source_size", F.least("cap", F.coalesce("final", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """keys: of `mix_keys`; targets: source, source_size, target (at most a whole number of passes times the size).

    Adds source_size, target, passes (how often the row is taken) and taken (words taken from it, repeats counted). A row's takes differ by one pass at
    most from any other of its source. Null sources are one source; null texts have size 0, and texts of any length are
    one row; identical rows are taken in equal numbers on every run; empty input gives no rows.
    """
    # A null source joins like any other.
    grp = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    numbered = materialise(targets.withColumn("grp", grp), "mix-targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = numbered.select("grp", F.lit(0).alias("t"), (F.col("target") - passes * F.col("source_size")).alias("target"), F.lit(0.0).alias("tolerance"))
    weighed = keys.select(grp.alias("grp"), *PARTS, F.col("size").alias("weight"))
    cut = thresholds(weighed, goals).select("grp", *(F.col(p).alias(f"t{p}") for p in PARTS), "inclusive")
    per_source = numbered.join(cut, "grp").withColumn("passes", passes).drop("source")
    one_more = below(tuple(F.col(p) for p in PARTS), tuple(F.col(f"t{p}") for p in PARTS), F.col("inclusive"))
    taken = keys.withColumn("grp", grp).join(per_source, "grp").withColumn("passes", F.col("passes") + one_more.cast("long"))
    return taken.select("id", "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"))
