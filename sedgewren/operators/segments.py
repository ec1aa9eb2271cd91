"""An index that follows its files: each update adds a segment of new and changed files and a list of removed ones.

A segment has the tables of a snapshot (see `index`), for its files only; nothing that is written is ever changed. What has
been removed since stays in the segments and is left out on reading: a list of document numbers, and the terms that they
take out of the dictionary. Statistics are sums over segments and lists, so searching gives what an index that is built
anew of the same files gives, with the numbers that the files have. Compaction makes one segment of all that is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions.text import terms
from sedgewren.operators.chunking import chunk_documents, document_of
from sedgewren.operators.index import Index, _point_to, delete, manifest, of_tables, write_tables
from sedgewren.operators.ordering import in_order
from sedgewren.streaming.progress import FileProgress

_KEY = ["path", "length", "modificationTime"]


@dataclass
class Update:
    """How many files an update added or read again, removed or replaced, and left alone, and the chunks there are now."""

    read: int
    removed: int
    kept: int
    chunks: int


def _state(spark: SparkSession, root: str) -> dict | None:
    m = manifest(spark, root)
    return m if m and "segments" in m else None


def _read(spark: SparkSession, root: str, names: list[str], table: str) -> DataFrame:
    """A table of all segments or lists, one scan; files of one segment may have columns that others lack."""
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{n}/{table}" for n in names])


def _without(rows: DataFrame, removed: DataFrame | None) -> DataFrame:
    return rows if removed is None else rows.join(removed, "doc_id", "left_anti")


def live_files(spark: SparkSession, root: str) -> DataFrame | None:
    """doc_id, path, length, modificationTime of the files that the index is of; None without an index."""
    m = _state(spark, root)
    if not m or not m["segments"]:
        return None
    removed = _read(spark, root, m["removed"], "files") if m["removed"] else None
    return _without(_read(spark, root, m["segments"], "files"), removed)


def update(spark: SparkSession, root: str, listing: DataFrame, read: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column] | None = None, embedder: str = "", config: RetrievalConfig = DEFAULT, on_file: Callable[[int, int], None] | None = None) -> Update:
    """Bring the index to the files of listing (path, length, modificationTime; each path once).

    read gives path, source, text of the files it is given (path, doc_id), which are only those that are new or have
    another length or time than before; on_file(done, total) is told how many of them are done, those that cannot be read
    included (see `silent_files`). Chunks that embed gives no vector are left out. Files of an index made with another
    embedder or other settings are all read again. An empty listing disables retrieval and changes nothing else. Two
    updates at a time are the caller's to avoid; a crash leaves the index as it was.
    """
    old = _state(spark, root)
    made = {"embedder": embedder, "config": asdict(config)}
    base = old or {"version": 0, "segments": [], "removed": [], "next": 0, "chunks": 0, "length": 0}
    before = live_files(spark, root)
    if listing.isEmpty():
        kept = before.count() if before is not None else 0
        _point_to(spark, root, made | base | {"version": base["version"] + 1, "enabled": False})
        return Update(0, 0, kept, base["chunks"])
    name = uuid.uuid4().hex
    segment, gone = f"segment={name}", f"removed={name}"
    same = old is not None and {k: old[k] for k in made} == made
    if before is None:
        before = spark.createDataFrame([], "doc_id long, path string, length long, modificationTime timestamp")
    fresh = listing.select(*_KEY).join(before.select(*_KEY), _KEY, "left_anti") if same else listing.select(*_KEY)
    # Both are written before anything else is: files may change meanwhile.
    in_order(fresh, ["path"], f"{root}/{segment}/listing", base["next"], "doc_id").write.parquet(f"{root}/{segment}/files")
    files = spark.read.parquet(f"{root}/{segment}/files")
    left = before.join(listing.select(*_KEY), _KEY, "left_anti") if same else before
    left.select("doc_id").write.parquet(f"{root}/{gone}/files")
    removed = spark.read.parquet(f"{root}/{gone}/files")
    n_read, n_removed, n_before = files.count(), removed.count(), before.count()
    if same and not n_read and not n_removed and old["enabled"]:
        return Update(0, 0, n_before, old["chunks"])
    state = made | {k: base[k] for k in ("version", "segments", "removed", "next", "chunks", "length")}
    state |= {"version": state["version"] + 1, "enabled": True}

    if n_removed:
        # What the removed documents take out of the statistics.
        there = _read(spark, root, base["segments"], "chunks").withColumn("doc_id", document_of(F.col("chunk_id")))
        lost = there.join(removed, "doc_id", "left_semi").select("chunk_id", "dl", "text")
        each = lost.select("chunk_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        each.groupBy("term").agg((-F.count("*")).alias("df")).write.parquet(f"{root}/{gone}/dictionary")
        n, length = lost.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        state |= {"removed": [*base["removed"], gone], "chunks": state["chunks"] - n, "length": state["length"] - length}
    if n_read:
        with FileProgress(spark, n_read, on_file or (lambda done, total: None)) as progress:
            # Files without a text are counted too.
            texts = files.select("path", "doc_id").join(read(files.select("path", "doc_id")), "path", "left")
            texts = progress.counted(texts) if on_file else texts
            chunks = chunk_documents(texts, config=config, more=("path",)).select("chunk_id", "path", "source", "text")
            if embed is not None:
                chunks = chunks.withColumn("vec", embed(F.col("text"))).where(F.col("vec").isNotNull())
            _, n, length = write_tables(chunks, f"{root}/{segment}")
        if not n:
            # Files without a chunk are kept in mind, so that they are not read again.
            _no_blocks(spark, f"{root}/{segment}")
        state |= {"segments": [*base["segments"], segment], "next": base["next"] + n_read, "chunks": state["chunks"] + n, "length": state["length"] + length}
    if not state["chunks"]:
        state["enabled"] = False
    _point_to(spark, root, state)
    return Update(n_read, n_removed, n_before - n_removed, state["chunks"])


def _no_blocks(spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([], "term string, range long, n long, max_tf long, min_dl long, postings array<struct<chunk_id: long, tf: long, dl: long>>").write.parquet(f"{folder}/blocks")
    spark.createDataFrame([], "term string, df long").write.parquet(f"{folder}/dictionary")


def load(spark: SparkSession, root: str, disabled: bool = False) -> Index | None:
    """The index as the last update left it; None if there is none or it is disabled. disabled: what there is all the same."""
    m = _state(spark, root)
    if not m or not m["segments"] or not (m["enabled"] or disabled):
        return None
    removed = _read(spark, root, m["removed"], "files") if m["removed"] else None
    dictionary = _read(spark, root, [*m["segments"], *m["removed"]], "dictionary").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    # Ranges are numbered in each segment anew: the segment is part of a range's name.
    named = F.concat_ws("/", F.regexp_extract("_metadata.file_path", r"segment=(\w+)", 1), F.col("range").cast("string"))
    blocks, chunks = (_read(spark, root, m["segments"], table).withColumn("range", named) for table in ("blocks", "chunks"))
    return of_tables(chunks, blocks, dictionary, removed, (m["chunks"], m["length"] / max(1, m["chunks"])))


def silent_files(spark: SparkSession, root: str) -> DataFrame | None:
    """path of the files of the index that gave no chunk: empty ones, and those that could not be read."""
    files = live_files(spark, root)
    if files is None:
        return None
    there = _read(spark, root, _state(spark, root)["segments"], "chunks").select(document_of(F.col("chunk_id")).alias("doc_id"))
    return files.join(there, "doc_id", "left_anti").select("path")


def compact(spark: SparkSession, root: str) -> int:
    """Make one segment of all that is left, without reading a file. Numbers of files stay. Returns the number of chunks."""
    m = _state(spark, root)
    if not m or not m["segments"]:
        return 0
    segment = f"segment={uuid.uuid4().hex}"
    live_files(spark, root).write.parquet(f"{root}/{segment}/files")
    _, n, length = write_tables(load(spark, root, disabled=True).chunks, f"{root}/{segment}")
    if not n:
        _no_blocks(spark, f"{root}/{segment}")
    _point_to(spark, root, m | {"version": m["version"] + 1, "segments": [segment], "removed": [], "chunks": n, "length": length})
    return n


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete segments and lists that the index no longer names. Not while others read or update. Returns their number."""
    m = _state(spark, root)
    return delete(spark, root, ("segment=", "removed="), {*m["segments"], *m["removed"]}) if m else 0
