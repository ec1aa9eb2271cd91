"""Exact dedup over a log-structured merge index of digests.

Rows arrive in memtables of a bounded number of rows. A memtable is flushed as a run: for each of its digests the
smallest identifier and the number of rows, in buckets by the digest, each sorted, with a bitmap filter. A new run
probes the older ones through their filters, so that digests that occur again are known when they arrive. Two runs of
one level are merged into one of the next by a sort-merge join, bucket by bucket, without an exchange. Reading a
repeated digest asks every live run. Rows whose digest occurs more than once are hits, and their texts are compared by
their bytes: what a filter of the repeated digests passes is grouped by the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import bucketed, materialise, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
#: Most and least bits of a bitmap filter (the most is 32 MB, whatever the input), and bits for each key that it holds.
#: A filter of very many more keys passes every row, and results stay the same.
MOST_BITS, LEAST_BITS, BITS_A_KEY = 1 << 28, 1 << 20, 16
_BUCKET_BITS = 32768
#: Rows of a memtable, and the least number of memtables that an input of several rows is taken in by.
MEMTABLE_ROWS, LEAST_MEMTABLES = 1 << 30, 4


def normalised(text_column: str = "text") -> Column:
    """The text with every run of ASCII whitespace as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text_column), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@dataclass
class Bitmap:
    """_bucket, _bits: a bit for every key, `bits` in all, as rows of 4 KB."""

    rows: DataFrame
    bits: int


def _with_bit(df: DataFrame, key: str, bits: int) -> DataFrame:
    at = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))
    return df.withColumn("_bucket", F.shiftright(at, 15)).withColumn("_bit", at.bitwiseAND(F.lit(_BUCKET_BITS - 1)))


def bitmap_filter(df: DataFrame, key: str, name: str = "filter") -> Bitmap:
    """Written in the shared folder; df is counted, then read once more. Its size follows df up to MOST_BITS."""
    bits = LEAST_BITS
    n = df.count()
    while bits < min(MOST_BITS, n * BITS_A_KEY):
        bits *= 2
    return Bitmap(materialise(_with_bit(df, key, bits).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")), name), bits)


def with_may_contain(df: DataFrame, key: str, filter_: Bitmap, column: str) -> DataFrame:
    """All rows of df and whether their key may be in the filter, which is broadcast: MOST_BITS at most."""
    is_set = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(shiftright(_bit, 3) + 1 as int), 1)), 16, 10) as int), cast(_bit & 7 as int)) & 1") == 1
    return _with_bit(df, key, filter_.bits).join(F.broadcast(filter_.rows), "_bucket", "left").withColumn(column, F.coalesce(is_set, F.lit(False))).drop("_bucket", "_bit", "_bits")


def may_contain(df: DataFrame, key: str, filter_: Bitmap) -> DataFrame:
    """The rows of df whose key may be in the filter."""
    return with_may_contain(df, key, filter_, "_maybe").where("_maybe").drop("_maybe")


def by_id(id_column: str, *more: str) -> Column:
    """Orders rows by their id, null last, then by more columns."""
    return F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), *more)


@dataclass
class Run:
    """digest, keep, n: a row for each digest, bucketed and sorted by it."""

    rows: DataFrame
    level: int
    filter: Bitmap


@dataclass
class DigestIndex:
    """Live runs, oldest first. A run is never changed, only merged into another."""

    runs: list[Run] = field(default_factory=list)

    def flush(self, rows: DataFrame, id_column: str = "doc_id", row_column: str = "row") -> DataFrame:
        """Write a memtable (digest, id and a number that tells rows apart) as a run and merge runs that are due.

        Returns the digests that occur again by it: more than once in it, or in it and in an older run.
        """
        table = rows.groupBy("digest").agg(F.min(by_id(id_column, row_column)).alias("keep"), F.count("*").alias("n"))
        new = self._stored(table, 0)
        again = new.rows.where(F.col("n") > 1).select("digest").unionByName(self.probe(new.rows)) if self.runs else new.rows.where(F.col("n") > 1).select("digest")
        self.runs.append(new)
        while len(self.runs) > 1 and self.runs[-1].level == self.runs[-2].level:
            self._merge_last()
        return again

    def _stored(self, table: DataFrame, level: int) -> Run:
        rows = bucketed(table, f"digest-run-{level}", "digest")
        return Run(rows, level, bitmap_filter(rows, "digest", "digest-filter"))

    def _merge_last(self) -> None:
        """Merge the two newest runs: of a digest the smallest identifier stays, and counts add up."""
        old, new = self.runs[-2:]
        a, b = (r.rows.select("digest", F.col("keep").alias(f"keep_{x}"), F.col("n").alias(f"n_{x}")) for r, x in ((old, "a"), (new, "b")))
        n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
        merged = a.join(b, "digest", "full").select("digest", F.least("keep_a", "keep_b").alias("keep"), n.cast("long").alias("n"))
        self.runs[-2:] = [self._stored(merged, max(old.level, new.level) + 1)]

    def compact(self) -> DataFrame:
        """Merge all live runs into one."""
        while len(self.runs) > 1:
            self._merge_last()
        return self.runs[0].rows

    def probe(self, rows: DataFrame) -> DataFrame:
        """The digests of rows that the index holds, once for each run that has them; a run is joined only with what
        its filter passes."""
        hits = [may_contain(rows.select("digest"), "digest", r.filter).join(r.rows.select("digest"), "digest", "left_semi") for r in self.runs]
        return reduce(DataFrame.unionByName, hits)

    def read(self, digests: DataFrame) -> DataFrame:
        """digest, keep, n of distinct digests, over all live runs."""
        found = reduce(DataFrame.unionByName, [r.rows.join(digests, "digest", "left_semi") for r in self.runs])
        return found.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per row of docs, in groups of equal normalised texts.

    The row with the smallest id of a group stays; ids may repeat, then one of the rows with that id stays, and null
    ids come last. Null texts count as empty, and all empty ones are equal. Texts of any length are compared whole;
    texts that differ but share a digest are told apart by their bytes. No rows give no rows; other columns are not
    looked at.
    """
    text = normalised(text_column)
    memtables = max(LEAST_MEMTABLES, -(-docs.count() // memtable_rows))
    row = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_column).alias("doc_id"), digest(text).alias("digest"), row.alias("row"))
    # Rows are dealt to memtables evenly, whatever the order in which files hold them.
    rows = materialise(rows.withColumn("memtable", F.pmod(F.xxhash64("row"), F.lit(memtables)).cast("int")), "digests", partition_by="memtable")
    index = DigestIndex()
    again = [index.flush(rows.where(F.col("memtable") == k)) for k in range(memtables)]
    repeated = materialise(reduce(DataFrame.unionByName, again).distinct(), "digest-repeated")
    groups = materialise(index.read(repeated), "digest-groups")

    # Texts are read again only for the byte check, grouped with a partial aggregation on the bytes themselves.
    known = bitmap_filter(groups, "digest", "digest-filter")
    hits = may_contain(docs.select(digest(text).alias("digest"), text.alias("bytes")), "digest", known)
    checked = materialise(hits.groupBy("digest", "bytes").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where(F.col("texts") > 1), "digest-checked")

    looked = with_may_contain(rows.drop("memtable"), "digest", known, "maybe")
    alone = F.col("n").isNull()
    found = looked.where("maybe").join(groups, "digest", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"), "digest",
    )
    rest = looked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    if checked.isEmpty():
        return found.unionByName(rest)
    # One digest of different texts: those rows are grouped by their texts.
    apart = materialise(docs.select(F.col(id_column).alias("doc_id"), digest(text).alias("digest"), text.alias("bytes"), row.alias("row")).join(checked.select("digest"), "digest", "left_semi"), "digest-texts")
    groups = materialise(apart.groupBy("digest", "bytes").agg(F.min(by_id("doc_id", "row")).alias("keep"), F.count("*").alias("n")), "digest-text-groups")
    told = apart.join(groups, ["digest", "bytes"]).select("doc_id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), "digest")
    return found.join(checked.select("digest"), "digest", "left_anti").select(told.columns).unionByName(rest).unionByName(told)
