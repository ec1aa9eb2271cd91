"""Dedup of blocks of lines, by chunks and by runs.

Chunks: a rolling hash over the hashes of WINDOW lines ends a chunk wherever it is 0 modulo DIVISOR, so that inserting
or deleting a line moves boundaries only nearby. Chunks of two lines or more that occur again anywhere are compared by
their bytes, and all occurrences but the first are removed. A repeated block whose ends are no boundaries keeps the
lines at its ends, and one inside a single chunk stays: the README says how much is left.

Runs: a chunk of two lines starts at every line, so that no boundary hides anything. A run of lines is repeated exactly
where its pairs of neighbouring lines are, and all lines of pairs that occurred before are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import materialise, text_or_empty
from sedgewren.llm.exact import bitmap_filter, by_id, may_contain, with_may_contain

#: Lines whose hashes decide a boundary, and the mean number of lines of a chunk.
WINDOW, DIVISOR = 2, 4
_BASE = 1_000_003
#: A chunk is kept in one long: its first line times this, plus its number of lines.
_UNIT = 1 << 31
NOT_BLANK = r"[^\x20\x09-\x0D]"


def _line_hash(line: Column) -> Column:
    """28 bits, so that the rolling hash of a window never overflows a long."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def with_chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with lines, and codes: one long for each chunk in order."""
    hashed = docs.withColumn("lines", F.split(text_or_empty("text"), "\n")).withColumn("hashes", F.transform("lines", _line_hash))

    def ends(i: Column) -> Column:
        rolling = F.lit(0).cast("long")
        for k in reversed(range(WINDOW)):
            rolling = rolling * _BASE + F.when(i > k, F.element_at("hashes", i - k)).otherwise(F.lit(0))
            rolling = F.pmod(rolling, F.lit((1 << 31) - 1).cast("long"))
        return (F.pmod(rolling, F.lit(DIVISOR).cast("long")) == 0) | (i == F.size("hashes"))

    cut = hashed.withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("lines")), ends))
    starts = F.concat(F.array(F.lit(0)), F.col("ends"))
    codes = F.zip_with("ends", F.slice(starts, 1, F.size("ends")), lambda end, start: start.cast("long") * _UNIT + (end - start))
    return cut.withColumn("codes", codes).drop("hashes", "ends")


def _chunk_text(code: Column) -> Column:
    return F.array_join(F.slice("lines", F.shiftright(code, 31).cast("int") + 1, code.bitwiseAND(F.lit(_UNIT - 1)).cast("int")), "\n")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text, its digest, and a hash of both, by which a document is looked up."""
    text = text_or_empty(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.md5(text).alias("text_md5"))
    return rows.withColumn("doc_key", F.xxhash64("doc_id", "text_md5"))


def _chunk_rows(rows: DataFrame, with_text: bool) -> DataFrame:
    several = F.filter("codes", lambda c: c.bitwiseAND(F.lit(_UNIT - 1)) > 1)
    chunks = with_chunks(rows).select("doc_id", "text_md5", "lines", F.explode(several).alias("code"))
    chunks = chunks.select("doc_id", "text_md5", "code", _chunk_text(F.col("code")).alias("chunk")).where(F.col("chunk").rlike(NOT_BLANK))
    return chunks.select("doc_id", "text_md5", "code", F.xxhash64("chunk").alias("digest"), *(["chunk"] if with_text else []))


def _looked_up(rows: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that surely lose nothing, which no shuffle touches, and all others joined with what they lose.

    removed: written, with doc_id and text_md5 of each document that loses something.
    """
    # md5 is never null, the id may be. Both sides are dealt out for the join only, so that many equal rows can be split.
    gone = removed.withColumnsRenamed({"doc_id": "id", "text_md5": "md5"}).withColumn("doc_key", F.xxhash64("id", "md5"))
    looked = with_may_contain(rows, "doc_key", bitmap_filter(gone, "doc_key", "removed-filter"), "maybe")
    same = (looked["doc_key"] == gone["doc_key"]) & looked["doc_id"].eqNullSafe(F.col("id")) & (looked["text_md5"] == F.col("md5"))
    return looked.where("not maybe"), looked.where("maybe").join(gone, same, "left").drop(gone["doc_key"])


def _n_lines() -> Column:
    return F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split(text_or_empty("text"), "\n"))).cast("long")


def dedup_chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text (null stays null), n_lines, n_removed, n_chunks_removed: one row per row of docs.

    The first occurrence of a chunk, in the row with the smallest id (null last) and there on the smallest line, stays.
    Rows of one id and one text are one document to this operator and are treated alike. A text without a line break
    has no chunk of two lines and stays as it is, as do chunks of blank lines (of ASCII whitespace only). Texts of any
    length are taken whole; one of removed chunks only becomes empty. No rows give no rows, and other columns are not
    looked at.
    """
    first = by_id("doc_id", "text_md5", "code")
    rows = _rows(docs, id_column, text_column)
    index = materialise(_chunk_rows(rows, False).groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("digest"), "chunk-digests")
    # The bytes of chunks that may repeat: grouped by digest and bytes, so that equal digests alone remove nothing.
    hits = materialise(may_contain(_chunk_rows(rows, True), "digest", bitmap_filter(index, "digest", "chunk-filter")), "chunk-hits")
    # Written before the join, so that adaptive execution can split a hot chunk.
    keep = materialise(hits.groupBy("digest", "chunk").agg(F.count("*").alias("n"), F.min(first).alias("keep")).where(F.col("n") > 1).drop("n"), "chunk-keep")
    again = hits.join(keep, ["digest", "chunk"]).where(first != F.col("keep"))
    removed = materialise(again.groupBy("doc_id", "text_md5").agg(F.collect_set("code").alias("removed")), "chunk-removed")
    whole, touched = _looked_up(rows, removed)
    zero = F.lit(0).cast("long")
    whole = whole.select("doc_id", "text", _n_lines().alias("n_lines"), zero.alias("n_removed"), zero.alias("n_chunks_removed"))
    touched = with_chunks(touched)
    gone = F.coalesce(F.aggregate("removed", zero, lambda n, c: n + c.bitwiseAND(F.lit(_UNIT - 1))), zero)
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except("codes", "removed"), _chunk_text), "\n"))
    cut = touched.select("doc_id", text.alias("text"), _n_lines().alias("n_lines"), gone.alias("n_removed"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_chunks_removed"))
    return whole.unionByName(cut)


def _pair_rows(rows: DataFrame) -> DataFrame:
    """id, digest of the text, line (from 1) and the bytes of that line and the next, unless both are blank."""
    lines = rows.select("doc_id", "text_md5", F.split(text_or_empty("text"), "\n").alias("lines")).where(F.size("lines") > 1)
    before, after = F.slice("lines", F.lit(1), F.size("lines") - 1), F.slice("lines", F.lit(2), F.size("lines") - 1)
    pairs = F.zip_with(before, after, lambda a, b: F.concat(a, F.lit("\n"), b))
    found = lines.select("doc_id", "text_md5", F.posexplode(pairs).alias("line", "pair")).where(F.col("pair").rlike(NOT_BLANK))
    return found.select("doc_id", "text_md5", (F.col("line") + 1).alias("line"), "pair", F.xxhash64("pair").alias("digest"))


def dedup_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text (null stays null), n_lines, n_removed, n_runs_removed: one row per row of docs.

    A line goes if it and a neighbour are a pair that begins at an earlier place too: in a row with a smaller id (null
    last), or there on a smaller line and not overlapping, so that of "a a a" nothing goes. The first place of every
    line stays. Pairs of two blank lines are no pairs. Rows of one id and one text are one document to this operator
    and are treated alike. Texts of any length are taken whole; one of removed lines only becomes empty. No rows give
    no rows, and other columns are not looked at.
    """
    first = by_id("doc_id", "text_md5", "line")
    rows = _rows(docs, id_column, text_column)
    index = materialise(_pair_rows(rows).groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("digest"), "pair-digests")
    hits = materialise(may_contain(_pair_rows(rows), "digest", bitmap_filter(index, "digest", "pair-filter")).drop("digest"), "pair-hits")
    # Written before the join, so that adaptive execution can split a hot pair. Pairs are equal by their bytes.
    keep = materialise(hits.groupBy("pair").agg(F.count("*").alias("n"), F.min(first).alias("keep")).where(F.col("n") > 1).drop("n"), "pair-keep")
    same_text = F.col("doc_id").eqNullSafe(F.col("keep.id")) & (F.col("text_md5") == F.col("keep.text_md5"))
    again = hits.join(keep, "pair").where(~(same_text & (F.col("line") - F.col("keep.line")).isin(0, 1)))
    removed = materialise(again.groupBy("doc_id", "text_md5").agg(F.collect_set("line").alias("begin")), "pair-removed")
    whole, touched = _looked_up(rows, removed)
    zero = F.lit(0).cast("long")
    whole = whole.select("doc_id", "text", _n_lines().alias("n_lines"), zero.alias("n_removed"), zero.alias("n_runs_removed"))
    after = lambda places: F.transform(places, lambda i: i + 1)
    split = touched.select("doc_id", "text", F.split(text_or_empty("text"), "\n").alias("lines"), F.array_union("begin", after("begin")).alias("gone"))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone"), lambda i: F.element_at("lines", i))
    count = lambda places: F.when(F.col("gone").isNull(), 0).otherwise(F.size(places)).cast("long")
    cut = split.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), _n_lines().alias("n_lines"),
        count("gone").alias("n_removed"), count(F.array_except("gone", after("gone"))).alias("n_runs_removed"),
    )
    return whole.unionByName(cut)
