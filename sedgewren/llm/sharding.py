"""Sharding by histogram sort: splitters from refined histograms, then one exchange.

Rows are ordered by a hash of the text, then one of the identifier, so equal texts lie together and end up in one
shard, or in neighbouring ones where a splitter must cut a group that outweighs a shard. The text itself is read once
and never moved: splitters, ranks and the exchange work on a narrow table of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import hex_key, materialise, text_or_empty
from sedgewren.llm.histogram import PARTS, below, thresholds

LAWS = ("bytes", "rows")
#: Ranges of the first key part, and for equal texts of the second (and for equal rows of the third), that are ranked apart.
_RANGES_BITS, _HOT_BITS = 12, 8


def shard_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", overhead: int = 16) -> DataFrame:
    """One narrow row per document: its id, size, CRC-32 and the key that orders it, written to the shared folder."""
    text = text_or_empty(text_column)
    return materialise(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text).alias("text_crc32"),
            hex_key(text).alias("a"),
            hex_key(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("b"),
            # Tells repeated rows apart; fixed once this table is written.
            hex_key(F.monotonically_increasing_id().cast("string")).alias("c"),
        ),
        "shard-keys",
    )


def _shard_of(splitters: list, first: int, last: int) -> Column:
    """Number of splitters at or before the row's key, as a balanced tree of comparisons."""
    if first == last:
        return F.lit(first)
    middle = (first + last) // 2
    s = splitters[middle]
    before = below(tuple(F.col(p) for p in PARTS), tuple(F.lit(s[p]) for p in PARTS), F.lit(s["inclusive"]))
    return F.when(before, _shard_of(splitters, first, middle)).otherwise(_shard_of(splitters, middle + 1, last))


def histogram_shards(keys: DataFrame, n_shards: int, law: str = "bytes", tolerance: float = 0.0) -> DataFrame:
    """keys: of `shard_keys`. Adds shard (0 to n_shards - 1) and slot (gapless from 0 in each shard, in key order).

    law `bytes` makes the shards' sizes near equal, `rows` their counts. tolerance: how far, as a fraction of a shard,
    a splitter may stay from its target; 0 refines to the nearest row. Null texts count as empty, null ids sort as an
    empty id, repeated rows are told apart and all placed, a very long text has a shard of its own if it outweighs one;
    no rows give no rows.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    weighed = keys.select(F.lit(0).alias("grp"), *PARTS, (F.col("size") if law == "bytes" else F.lit(1).cast("long")).alias("weight"))
    total, rows = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    spark = keys.sparkSession
    targets = spark.range(1, n_shards).select(F.lit(0).alias("grp"), F.col("id").alias("t"), (F.lit(float(total)) * F.col("id") / n_shards).alias("target"), F.lit(tolerance * total / n_shards).alias("tolerance"))
    # One row per boundary between shards: n_shards - 1 at most.
    splitters = sorted(thresholds(weighed, targets).collect(), key=lambda s: s["t"])
    if not rows:
        splitters = []
    placed = keys.withColumn("shard", _shard_of(splitters, 0, len(splitters)).cast("int"))

    # Rows are ranked within narrow key ranges, and a text that fills a range is ranked by ranges of its second part.
    placed = placed.withColumn("range", F.shiftright("a", 60 - _RANGES_BITS))
    most = max(2000, 4 * rows >> _RANGES_BITS)
    full = [r["range"] for r in placed.groupBy("range").count().where(F.col("count") > most).select("range").collect()]
    # Fewer than rows / most, so at most 1024.
    hot = sorted(r["a"] for r in placed.where(F.col("range").isin(full)).groupBy("a").count().where(F.col("count") > most).select("a").collect()) if full else []
    place = ["shard", "range", "segment", "part", "segment_b", "part_b"]
    if hot:
        is_hot = F.col("a").isin(hot)
        # Rows of one text and one id (or none) can be as many: they are ranked by ranges of the third part.
        repeated = [(r["a"], r["b"]) for r in placed.where(is_hot).groupBy("a", "b").count().where(F.col("count") > most).select("a", "b").collect()]
        pair = lambda a, b: F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
        own = F.struct(F.col("a"), F.col("b"))
        after = F.size(F.filter(F.array(*map(F.lit, hot)), lambda x: x <= F.col("a")))
        pairs = F.array(*(pair(a, b) for a, b in repeated))
        after_b = F.size(F.filter(pairs, lambda x: x <= own)) if repeated else F.lit(0)
        is_pair = F.array_contains(pairs, own) if repeated else F.lit(False)
        placed = placed.withColumns({
            "segment": F.when(F.col("range").isin(full), after).otherwise(0),
            "part": F.when(is_hot, F.shiftright("b", 60 - _HOT_BITS)).otherwise(1 << _HOT_BITS),
            "segment_b": F.when(is_hot, after_b).otherwise(0),
            "part_b": F.when(is_pair, F.shiftright("c", 60 - _HOT_BITS)).otherwise(1 << _HOT_BITS),
        })
    else:
        placed = placed.withColumns({c: F.lit(0).cast("long") for c in place[2:]})
    counts = placed.groupBy(*place).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(*PARTS))
    return placed.withColumn("rank", rank).join(offsets, place).withColumn("slot", F.col("offset") + F.col("rank") - 1).drop("rank", "offset", *place[1:])
