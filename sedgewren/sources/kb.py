"""Knowledge-base directories: scan, per-format text extraction, signature."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions.binary import pieces, utf16_runs
from sedgewren.functions.text import decode_text, latin1_runs, normalize_ws, strip_xml, trim
from sedgewren.operators.chunking import chunk_documents

FORMATS = ("txt", "md", "docx", "doc")
#: Under this many characters of two-byte text, an old word-processor file is read as one-byte text if that is longer.
FEW = 20
DOCX_PART = "word/document.xml"


@F.arrow_udf(T.StringType())
def docx_xml(content: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The main part of a word-processing package; null if the file is broken or has none."""

    def part(data: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                return z.read(DOCX_PART).decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError, OSError, EOFError, ValueError, NotImplementedError, RuntimeError):
            return None

    for some in pieces(content):
        yield pa.array([part(data) for data in some.to_pylist()], pa.string())


_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: The formats' suffixes in any case, as patterns of file names.
_SUFFIXES = ["." + "".join(f"[{c}{c.upper()}]" for c in f) for f in FORMATS]


def scan(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """path, source (file name), ext, modificationTime, length, content of the files of known formats under root and in
    its folders, one level deep unless recursive; no other file is opened. Unreadable files are left out, and a folder
    that is not there, or has no such file, gives no rows."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if recursive:
        files = reader.option("pathGlobFilter", "*{" + ",".join(_SUFFIXES) + "}").load(root) if fs.exists(base) else None
    else:
        patterns = [f"{root.rstrip('/')}/{at}*{suffix}" for at in ("", "*/") for suffix in _SUFFIXES]
        there = [p for p in patterns if fs.globStatus(jvm.org.apache.hadoop.fs.Path(p))]
        files = reader.load(there) if there else None
    if files is None:
        files = spark.createDataFrame([], _SCHEMA)
    inside = F.substring_index(F.regexp_replace("path", "^[a-z0-9+.-]+:/*(?=/)", ""), base.toUri().getPath().rstrip("/") + "/", -1)
    files = _named(files.withColumn("inside", inside))
    # A folder may be named like a file.
    return (files if recursive else files.where(F.size(F.split("inside", "/")) <= 2)).drop("inside")


#: Files up to which they are named to the reader, so that no other file is opened.
FILES_NAMED = 10_000


def scan_of(spark: SparkSession, root: str, paths: DataFrame, recursive: bool = False) -> DataFrame:
    """What scan gives for some of its paths. Beyond FILES_NAMED of them other files may be opened too, and are left out."""
    named = [r["path"] for r in paths.select("path").limit(FILES_NAMED + 1).collect()]
    if len(named) > FILES_NAMED:
        return scan(spark, root, recursive).join(paths.select("path"), "path", "left_semi")
    reader = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    jvm = spark.sparkContext._jvm
    there = [p for p in named if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(p))]
    # Names may hold characters that a path pattern takes for something else.
    files = reader.load([re.sub(r"([\\\[\]{}*?,])", r"\\\1", p) for p in there]) if there else spark.createDataFrame([], _SCHEMA)
    return _named(files)


def _named(files: DataFrame) -> DataFrame:
    files = files.withColumn("source", F.regexp_extract("path", "[^/]*$", 0))
    return files.withColumn("ext", F.lower(F.regexp_extract("source", r"\.([^.]*)$", 1))).where(F.col("ext").isin(*FORMATS))


def read_texts(files: DataFrame) -> DataFrame:
    """path, source, text of scanned files; each format is a branch of its own, so that Python only sees its files."""
    columns = ["path", "source", "text"]
    plain = files.where(F.col("ext").isin("txt", "md")).withColumn("text", decode_text(F.col("content")))
    docx = files.where(F.col("ext") == "docx").withColumn("text", strip_xml(docx_xml("content")))
    old = files.where(F.col("ext") == "doc").select("path", "source", utf16_runs("content").alias("wide"), latin1_runs(F.col("content")).alias("narrow"))
    narrow = (F.length(trim(F.col("wide"))) < FEW) & (F.length("narrow") > F.length("wide"))
    old = old.withColumn("text", normalize_ws(F.when(narrow, F.col("narrow")).otherwise(F.col("wide"))))
    texts = plain.select(*columns).unionByName(docx.select(*columns)).unionByName(old.select(*columns))
    return texts.where(trim(F.coalesce("text", F.lit(""))) != "")


def numbered(files: DataFrame) -> DataFrame:
    """path, doc_id: the place of each path in their order, from 0. Only the paths are read, sorted in parallel."""
    spark = files.sparkSession
    ordered = files.select("path").distinct().orderBy("path").rdd.zipWithIndex()
    return spark.createDataFrame(ordered.map(lambda x: (x[0]["path"], x[1])), "path string, doc_id long")


def chunks_of(texts: DataFrame, numbers: DataFrame, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """chunk_id, path, source, text: chunks of texts; the id is made of the number of the path and the place."""
    chunks = chunk_documents(texts.join(numbers, "path"), config=config, more=("path",))
    return chunks.select("chunk_id", "path", "source", "text")


def signature(files: DataFrame, path: str = "path", size: str = "length", mtime_ms: str = "mtime_ms") -> DataFrame:
    """One row: SHA-1 of `path|size|mtime` of all files in order of their paths, without a separator between files.

    A chain of bytes has one order, so one task reads it, sorted on disk if need be and batch by batch: what it holds
    does not grow with the listing, which has a row for each file and none for their content.
    """
    entry = F.concat_ws("|", F.col(path).cast("string"), F.col(size).cast("string"), F.col(mtime_ms).cast("string"))
    listing = files.select(F.col(path).cast("string").alias("path"), entry.alias("entry")).repartition(1).sortWithinPartitions("path", "entry")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha1()
        for b in batches:
            sha.update("".join(b.column("entry").to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()])], names=["signature"])

    return listing.mapInArrow(digest, "signature string")


def directory_signature(spark: SparkSession, root: str, recursive: bool = False) -> str:
    files = scan(spark, root, recursive).withColumn("mtime_ms", F.unix_millis("modificationTime"))
    found = signature(files).first()
    return found["signature"] if found else hashlib.sha1().hexdigest()


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path, size or time the known listing lacks."""
    return files.join(known, ["path", "length", "modificationTime"], "left_anti")
