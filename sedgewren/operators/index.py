"""Search index: chunks and their term statistics as tables, kept as versioned, immutable snapshots.

A snapshot is a folder of its own name, and so is each manifest: the one of the highest number counts. Nothing that a
reader may have open is ever changed, and a crash at any point leaves the last good snapshot published.

A snapshot keeps postings in blocks: the chunks of a range that have a term, with the highest term frequency and the
smallest length among them, in order of the terms. Searching reads these two numbers of the blocks of asked terms, and the
postings only of blocks that may hold one of the best chunks (see `lexical.Pruned`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions.text import terms
from sedgewren.operators.chunking import document_of


#: A posting block of a term covers 2^RANGE_BITS chunks. Ranges whose blocks a task makes at once.
RANGE_BITS, RANGES_WRITTEN = 6, 32
_BLOCKS_DDL = "term string, range bigint, n bigint, max_tf bigint, min_dl bigint, postings array<struct<chunk_id:bigint,tf:bigint,dl:bigint>>"


@dataclass
class Index:
    """chunks (chunk_id, source, text, maybe vec), postings (chunk_id, term, tf), doc_len (chunk_id, dl).

    A stored index also has blocks (term, range, n, max_tf, min_dl, postings) and the dictionary (term, df). Where chunks
    have been removed since, `removed` has them by range (range, gone: array<bigint>), blocks still hold them, and the other
    tables do not; n_docs and avgdl are then known.
    """

    chunks: DataFrame
    postings: DataFrame
    doc_len: DataFrame
    blocks: DataFrame | None = None
    dictionary: DataFrame | None = None
    removed: DataFrame | None = None
    totals: tuple[int, float] | None = None

    @property
    def doc_terms(self) -> DataFrame:
        """chunk_id, terms: all terms of each chunk, taken from its text."""
        return self.chunks.select("chunk_id", terms(F.col("text")).alias("terms"))

    @property
    def term_df(self) -> DataFrame:
        """term, df: the number of chunks with the term."""
        if self.dictionary is not None:
            return self.dictionary
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def stats(self) -> DataFrame:
        """One row: n_docs and avgdl, which is 0 without chunks."""
        if self.totals is not None:
            return self.chunks.sparkSession.createDataFrame([self.totals], "n_docs long, avgdl double")
        return self.doc_len.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def build(chunks: DataFrame) -> Index:
    """Statistics of chunks (chunk_id, text, ...). Chunks without a term count, with length 0. A snapshot that is
    published and loaded has them ready."""
    with_terms = chunks.select("chunk_id", terms(F.col("text")).alias("terms"))
    # Dealt out by chunk while it still is a text, a fraction of its terms' size: counting keeps that.
    dealt = chunks.select("chunk_id", "text").repartition("chunk_id").select("chunk_id", terms(F.col("text")).alias("terms"))
    # The outer form: for the other one Spark would take the terms out once more, to leave out rows without any.
    each = dealt.select("chunk_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    postings = each.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    return Index(chunks, postings, with_terms.select("chunk_id", F.size("terms").cast("long").alias("dl")))


def whole_ranges(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """The rows, in order of their ranges, by n whole ranges at a time."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        code = held.column("range").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(1, np.int64)
        cut = [*starts[::n]]
        # The last range may go on in the next batch.
        if cut[-1] != starts[-1]:
            cut.append(starts[-1])
        for a, b in zip(cut, cut[1:], strict=False):
            yield held.slice(a, b - a)
        held = held.slice(cut[-1])
    if held is not None and held.num_rows:
        yield held


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting blocks of chunks (chunk_id, range, dl, terms), which come in order of their ranges."""
    for some in whole_ranges(batches, RANGES_WRITTEN):
        some = some.combine_chunks().to_batches()[0]
        lengths = pc.list_value_length(some.column("terms")).fill_null(0).to_numpy(zero_copy_only=False)
        coded = some.column("terms").flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        if not len(code):
            continue
        # Chunks by range; rows of one chunk and length are one.
        chunks, chunk = np.unique(np.stack([some.column(c).to_numpy() for c in ("range", "chunk_id", "dl")], 1), axis=0, return_inverse=True)
        key, tf = np.unique(code * len(chunks) + np.repeat(chunk.ravel(), lengths), return_counts=True)
        term, (range_, ids, dl) = key // len(chunks), chunks[key % len(chunks)].T.copy()
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (range_[1:] != range_[:-1])]))
        ends = np.append(starts[1:], len(key))
        postings = pa.StructArray.from_arrays([pa.array(ids), pa.array(tf), pa.array(dl)], names=["chunk_id", "tf", "dl"])
        columns = [coded.dictionary.take(pa.array(term[starts])), pa.array(range_[starts]), pa.array(ends - starts), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), postings)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "range", "n", "max_tf", "min_dl", "postings"])


def _write_blocks(stored: DataFrame, folder: str) -> None:
    """Write the posting blocks and the dictionary of written chunks (chunk_id, range, dl, text)."""
    # One exchange, of texts by range: a common term's blocks are spread.
    dealt = stored.select("chunk_id", "range", "dl", "text").repartition("range").sortWithinPartitions("range")
    blocks = dealt.select("chunk_id", "range", "dl", terms(F.col("text")).alias("terms")).mapInArrow(_blocks, _BLOCKS_DDL)
    # In order of the terms, so that a reader can leave out what no asked term is in.
    blocks.sortWithinPartitions("term", "range").write.parquet(f"{folder}/blocks")
    dictionary = stored.sparkSession.read.parquet(f"{folder}/blocks").groupBy("term").agg(F.sum("n").alias("df"))
    dictionary.sortWithinPartitions("term").write.parquet(f"{folder}/dictionary")


def write_tables(chunks: DataFrame, folder: str) -> tuple[DataFrame, int, int]:
    """Write the chunks, their posting blocks and their dictionary below a folder. Returns the chunks as they are read
    back, their number and the sum of their lengths.

    A range is the next 2^RANGE_BITS chunks of a task, whatever they are. Statistics come from the written chunks, so that
    extraction and chunking run once.
    """
    spark = chunks.sparkSession
    length = F.size(terms(F.col("text"))).cast("long")
    chunks.withColumn("dl", length).withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)).write.parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    n, total = stored.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if n:
        _write_blocks(stored, folder)
    return stored, n, total


def of_tables(chunks: DataFrame, blocks: DataFrame, dictionary: DataFrame, removed: DataFrame | None = None, totals: tuple[int, float] | None = None) -> Index:
    """The index of stored tables, without the chunks of removed documents."""
    postings = blocks.select("term", F.explode("postings").alias("p")).select(F.col("p.chunk_id").alias("chunk_id"), "term", F.col("p.tf").alias("tf"))
    gone = None
    if removed is not None:
        there = chunks.select("chunk_id", "range", document_of(F.col("chunk_id")).alias("doc_id"))
        # At most a range's chunks.
        gone = there.join(removed, "doc_id", "left_semi").groupBy("range").agg(F.collect_list("chunk_id").alias("gone"))
        chunks = chunks.withColumn("doc_id", document_of(F.col("chunk_id"))).join(removed, "doc_id", "left_anti").drop("doc_id")
        postings = postings.withColumn("doc_id", document_of(F.col("chunk_id"))).join(removed, "doc_id", "left_anti").drop("doc_id")
    return Index(chunks.drop("dl", "range"), postings, chunks.select("chunk_id", "dl"), blocks, dictionary, gone, totals)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """Names of the manifests, oldest first."""
    fs, folder = _fs(spark, f"{root}/manifests")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if fs.exists(folder) else []


def manifest(spark: SparkSession, root: str) -> dict | None:
    """Content of the published manifest of an index, or None."""
    names = _manifests(spark, root)
    if not names:
        return None
    fs, p = _fs(spark, f"{root}/manifests/{names[-1]}")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point_to(spark: SparkSession, root: str, state: dict) -> None:
    """Write a manifest under a name that nobody reads, then rename it to the next number."""
    names = _manifests(spark, root)
    number = int(names[-1].partition("-")[0]) + 1 if names else 1
    attempt = uuid.uuid4().hex
    fs, beside = _fs(spark, f"{root}/manifests/{attempt}.new")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if not fs.rename(beside, _fs(spark, f"{root}/manifests/{number:012d}-{attempt}.json")[1]):
        raise OSError(f"cannot publish in {root}")


def publish(index: Index, root: str, signature: str, embedder: str = "", config: RetrievalConfig = DEFAULT) -> int:
    """Write the index as the next snapshot and point a new manifest to it last. An empty index disables retrieval,
    leaves no folder behind and keeps the last good snapshot in place. Returns the number of chunks."""
    spark = index.chunks.sparkSession
    old = manifest(spark, root)
    version = (old["version"] if old else 0) + 1
    snapshot = f"snapshot={version}-{uuid.uuid4().hex[:12]}"
    folder = f"{root}/{snapshot}"
    _, n, total = write_tables(index.chunks, folder)
    if n:
        state = {"version": version, "snapshot": snapshot, "signature": signature, "embedder": embedder, "config": asdict(config), "chunks": n, "length": total, "enabled": True}
    else:
        fs, p = _fs(spark, folder)
        fs.delete(p, True)
        state = (old or {"version": 0, "snapshot": None, "signature": "", "embedder": embedder, "config": asdict(config), "chunks": 0}) | {"enabled": False}
    _point_to(spark, root, state)
    return n


def is_current(spark: SparkSession, root: str, signature: str, embedder: str = "", config: RetrievalConfig = DEFAULT) -> bool:
    """Whether the published snapshot was made from the same files by the same embedder and settings."""
    m = manifest(spark, root)
    return m is not None and m["enabled"] and (m["signature"], m["embedder"], m["config"]) == (signature, embedder, asdict(config))


def load(spark: SparkSession, root: str, disabled: bool = False) -> Index | None:
    """The published snapshot; None if there is none, or if the last rebuild was empty and so disabled retrieval.
    disabled: the last good snapshot all the same."""
    m = manifest(spark, root)
    if not m or not m["snapshot"] or not (m["enabled"] or disabled):
        return None
    tables = (spark.read.parquet(f"{root}/{m['snapshot']}/{t}") for t in ("chunks", "blocks", "dictionary"))
    return of_tables(*tables, totals=(m["chunks"], m["length"] / m["chunks"]))


def delete(spark: SparkSession, root: str, prefixes: tuple[str, ...], kept: set[str]) -> int:
    """Delete all manifests but the published one, and folders of the given beginnings that are not to be kept; returns
    how many of the latter."""
    for name in _manifests(spark, root)[:-1]:
        fs, p = _fs(spark, f"{root}/manifests/{name}")
        fs.delete(p, False)
    fs, p = _fs(spark, root)
    old = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith(prefixes) and f.getPath().getName() not in kept]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete snapshots and manifests that the published manifest does not name, left by older versions and by crashes.
    Not while others read or publish. Returns the number of deleted snapshots."""
    m = manifest(spark, root)
    return delete(spark, root, ("snapshot=",), {m["snapshot"]}) if m else 0
