"""Places of rows in an order, for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a place within a range, as in Spark's own numbers.
_BITS = 33


def in_order(rows: DataFrame, by: list[str], folder: str, first: int = 0, name: str = "place") -> DataFrame:
    """rows with their place in the order of the columns `by`, from `first`; equal rows go in any order.

    They are written to the folder in ranges, so that places stay; the driver sees the number of rows of each range only.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()).write.parquet(folder)
    written = spark.read.parquet(folder).withColumn("_range", F.shiftright(name, _BITS))
    starts, upto = [], first
    for r in sorted(written.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        starts.append((r["_range"], upto))
        upto += r["count"]
    placed = written.join(F.broadcast(spark.createDataFrame(starts, "_range long, _start long")), "_range")
    return placed.withColumn(name, F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << _BITS) - 1))).select(*rows.columns, name)
