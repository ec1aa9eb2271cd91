"""Exact thresholds from histograms that are refined only where a target falls.

Rows carry a group, three key parts of 60 bits and a weight. For each target of a group, the threshold is the key up
to which the group's rows, in key order, weigh as near the target as whole rows allow. Nothing is sorted: each round
sums the weights of 4096 key ranges inside the few ranges that still hold a target, and goes on within the range that
the target falls into, until that range is one row or a range boundary meets the tolerance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import materialise

BITS, KEY_BITS = 12, 60
_LEVELS_A_PART = KEY_BITS // BITS
PARTS = ("a", "b", "c")
TOP = 1 << KEY_BITS


def below(key: tuple[Column, Column, Column], threshold: tuple[Column, Column, Column], inclusive: Column) -> Column:
    """Whether a key comes before a threshold, or is the threshold of an inclusive one."""
    (a, b, c), (x, y, z) = key, threshold
    return (a < x) | ((a == x) & ((b < y) | ((b == y) & ((c < z) | ((c == z) & inclusive)))))


def _round(keys: DataFrame, active: DataFrame, level: int) -> DataFrame:
    part, digit = divmod(level, _LEVELS_A_PART)
    shift = KEY_BITS - BITS * (digit + 1)
    prefix = {p: F.col(p) if k < part else F.shiftright(p, shift + BITS) if k == part else F.lit(0).cast("long") for k, p in enumerate(PARTS)}
    where = ["grp", *(f"p{p}" for p in PARTS)]
    at = active.where(F.col("level") == level)
    rows = keys.select("grp", "weight", *PARTS, *(prefix[p].alias(f"p{p}") for p in PARTS), F.shiftright(PARTS[part], shift).bitwiseAND(F.lit((1 << BITS) - 1)).alias("digit"))
    found = rows.join(at.select(*where).distinct(), where).groupBy(*where, "digit").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *(f(p).alias(f"{name}_{p}") for name, f in (("least", F.min), ("most", F.max)) for p in PARTS))
    before = Window.partitionBy(*where).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    hit = at.join(found, where).withColumn("start", F.col("base") + F.col("before")).withColumn("end", F.col("start") + F.col("w"))
    hit = hit.where((F.col("start") < F.col("target")) & (F.col("target") <= F.col("end")))

    range_start = F.shiftleft(F.shiftleft(f"p{PARTS[part]}", BITS) + F.col("digit"), shift)
    range_end = F.shiftleft(F.shiftleft(f"p{PARTS[part]}", BITS) + F.col("digit") + 1, shift)
    one, last = F.col("n") == 1, F.lit(level == len(PARTS) * _LEVELS_A_PART - 1)
    to_start, to_end = F.col("target") - F.col("start"), F.col("end") - F.col("target")
    near_start, near_end = to_start <= F.col("tolerance"), to_end <= F.col("tolerance")
    # The later parts of a range boundary are 0, the earlier ones are those of the whole range.
    boundary = lambda p, value: F.col(f"p{p}") if PARTS.index(p) < part else value if PARTS.index(p) == part else F.lit(0).cast("long")
    done = one | near_start | near_end | last
    upper = near_end | (last & (to_end < to_start))
    one_value = F.col(f"least_{PARTS[part]}") == F.col(f"most_{PARTS[part]}")
    next_level = F.when(one_value, (part + 1) * _LEVELS_A_PART).otherwise(level + 1)
    going_on = {p: F.col(f"p{p}") if PARTS.index(p) != part else F.when(one_value, F.col(f"least_{p}")).otherwise(F.shiftleft(f"p{p}", BITS) + F.col("digit")) for p in PARTS}
    return hit.select(
        "grp", "t", "target", "tolerance", F.col("start").alias("base"),
        F.when(~done, next_level).cast("int").alias("level"),
        *(F.when(~done, going_on[p]).when(one, F.col(f"least_{p}")).when(upper, boundary(p, range_end)).otherwise(boundary(p, range_start)).cast("long").alias(f"p{p}") for p in PARTS),
        F.when(done, one & (to_end < to_start)).alias("inclusive"),
    )


def thresholds(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """keys: grp, a, b, c (longs from 0 to 2**60 - 1) and weight, of a written table. targets: grp, t, target, tolerance.

    Returns grp, t, a, b, c, inclusive: rows of the group `below` that key weigh about the target. A target of 0 or
    less takes no row, one of all weight or more takes every row that is before the end of the last weight.
    """
    totals = keys.groupBy("grp").agg(F.sum("weight").alias("total"))
    at_first = targets.join(totals, "grp").select("grp", "t", F.least("target", F.col("total").cast("double")).alias("target"), F.col("tolerance").cast("double").alias("tolerance"), F.lit(0).cast("long").alias("base"), F.when(F.least("target", F.col("total").cast("double")) > 0, 0).cast("int").alias("level"), *(F.lit(0).cast("long").alias(f"p{p}") for p in PARTS), F.lit(False).alias("inclusive"))
    state = materialise(at_first, "thresholds")
    done = [state.where(F.col("level").isNull())]
    active = state.where(F.col("level").isNotNull())
    while (level := active.agg(F.min("level")).first()[0]) is not None:
        state = materialise(_round(keys, active, level), "thresholds")
        done.append(state.where(F.col("level").isNull()))
        active = active.where(F.col("level") != level).unionByName(state.where(F.col("level").isNotNull()))
    return reduce(DataFrame.unionByName, done).select("grp", "t", *(F.col(f"p{p}").alias(p) for p in PARTS), "inclusive")
