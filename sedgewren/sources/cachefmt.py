"""The binary index cache, for exchange with other programs: a header, then one record per chunk, little-endian.

Reading checks every field, as the file may come from anywhere. Inside the engine indexes are Parquet snapshots.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedgewren.config import CACHE_MAGIC, CACHE_VERSION
from sedgewren.functions.binary import pieces
from sedgewren.operators.ordering import in_order

# Fixed bounds of the format, for each file.
MOST_CHUNKS = 5_000_000
MOST_STRING = 64 << 20
#: Records that one task reads, or places at once; bytes of them that it holds, or one record.
RECORDS, HELD_BYTES = 4096, 1 << 20
SCHEMA = "chunk_id long, source string, text string, vec array<float>"


class CacheError(ValueError):
    """The file is not a cache that this reader accepts."""


def cache_path(directory: str) -> str:
    """Beside the directory, so that a watch on the directory does not see it."""
    name = hashlib.sha1(directory.encode()).hexdigest()
    return f"{os.path.dirname(os.path.abspath(directory))}/.rag_cache_{name}.bin"


def encode(rows: Iterator[tuple[str, str, list[float]]], count: int, dimension: int, signature: str) -> Iterator[bytes]:
    """Pieces of the file, in order."""
    yield _header(dimension, signature, count)
    for source, body, vec in rows:
        v = np.asarray(vec, "<f4")
        if len(v) != dimension:
            raise CacheError(f"a vector of {len(v)} components in a cache of {dimension}")
        yield _text(source) + _text(body) + v.tobytes()


def decode(data: bytes, dimension: int | None = None, signature: str | None = None, with_vectors: bool = True) -> Iterator[tuple[str, str, list[float] | None]]:
    """Source, text and vector of each chunk; CacheError if anything is not as it should be or as asked for."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(data):
            raise CacheError("the file ends early")
        at += n
        return data[at - n : at]

    def text() -> str:
        (n,) = struct.unpack("<i", take(4))
        if not 0 <= n <= MOST_STRING:
            raise CacheError("a string's length is out of bounds")
        return take(n).decode("utf-8", "replace")

    if take(4) != CACHE_MAGIC:
        raise CacheError("not a cache")
    version, width = struct.unpack("<Ii", take(8))
    if version != CACHE_VERSION:
        raise CacheError(f"version {version}")
    if width <= 0 or dimension not in (None, width):
        raise CacheError(f"dimension {width}")
    found = text()
    if signature not in (None, found):
        raise CacheError("made from other files")
    (count,) = struct.unpack("<i", take(4))
    if not 1 <= count <= MOST_CHUNKS:
        raise CacheError("the number of chunks is out of bounds")
    for _ in range(count):
        source, body, vector = text(), text(), take(4 * width)
        yield source, body, np.frombuffer(vector, "<f4").tolist() if with_vectors else None


def _text(s: str) -> bytes:
    return struct.pack("<i", len(b := s.encode())) + b


def _header(dimension: int, signature: str, count: int) -> bytes:
    return CACHE_MAGIC + struct.pack("<Ii", CACHE_VERSION, dimension) + _text(signature) + struct.pack("<i", count)


class _Scan:
    """Goes through a cache file record by record and reads only what it is asked for; CacheError as in decode."""

    def __init__(self, file, dimension: int | None, signature: str | None):
        self.file, self.size = file, file.seek(0, os.SEEK_END)
        file.seek(0)
        if self.take(4) != CACHE_MAGIC:
            raise CacheError("not a cache")
        version, self.width = struct.unpack("<Ii", self.take(8))
        if version != CACHE_VERSION:
            raise CacheError(f"version {version}")
        if self.width <= 0 or dimension not in (None, self.width):
            raise CacheError(f"dimension {self.width}")
        if signature not in (None, found := self.string()):
            raise CacheError(f"made from other files: {found}")
        (self.count,) = struct.unpack("<i", self.take(4))
        if not 1 <= self.count <= MOST_CHUNKS:
            raise CacheError("the number of chunks is out of bounds")

    def take(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) < n:
            raise CacheError("the file ends early")
        return data

    def _length(self) -> int:
        (n,) = struct.unpack("<i", self.take(4))
        if not 0 <= n <= MOST_STRING:
            raise CacheError("a string's length is out of bounds")
        return n

    def string(self) -> str:
        return self.take(self._length()).decode("utf-8", "replace")

    def skip(self) -> None:
        """Over one record."""
        for _ in range(2):
            self.file.seek(self._length(), os.SEEK_CUR)
        if self.file.seek(4 * self.width, os.SEEK_CUR) > self.size:
            raise CacheError("the file ends early")

    def record(self) -> tuple[str, str, bytes]:
        """Source, text and the bytes of the vector."""
        return self.string(), self.string(), self.take(4 * self.width)


@dataclass
class _Records(InputPartition):
    path: str
    at: int
    first: int
    count: int


class _CacheReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["paths"].split("\0")
        self.dimension = int(options["dimension"]) if options.get("dimension") else None
        self.signature, self.vectors = options.get("signature"), options.get("vectors", "true") == "true"
        self.records = int(options.get("records", RECORDS))

    def partitions(self) -> list[InputPartition]:
        """Runs of records: their beginnings are found by going from length to length, nothing else is read."""
        out: list[InputPartition] = []
        before = 0
        for path in self.paths:
            with open(path, "rb", buffering=1 << 16) as f:
                scan = _Scan(f, self.dimension, self.signature)
                for i in range(scan.count):
                    if i % self.records == 0:
                        out.append(_Records(path, f.tell(), before + i, min(self.records, scan.count - i)))
                    scan.skip()
                before += scan.count
        return out

    def read(self, partition: _Records) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb", buffering=1 << 20) as f:
            scan = _Scan(f, self.dimension, self.signature)
            f.seek(partition.at)
            rows, held, first = [], 0, partition.first
            for i in range(partition.count):
                rows.append(scan.record())
                held += sum(map(len, rows[-1]))
                if held >= HELD_BYTES or i + 1 == partition.count:
                    yield self._batch(first, rows, scan.width)
                    rows, held, first = [], 0, partition.first + i + 1

    def _batch(self, first: int, rows: list[tuple[str, str, bytes]], width: int) -> pa.RecordBatch:
        sources, texts, vectors = zip(*rows, strict=True)
        if self.vectors:
            flat = pa.array(np.frombuffer(b"".join(vectors), "<f4").astype(np.float32))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), flat)
        else:
            vec = pa.nulls(len(rows), pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(rows)), pa.int64()), pa.array(sources, pa.string()), pa.array(texts, pa.string()), vec], names=["chunk_id", "source", "text", "vec"])


class CacheFiles(DataSource):
    """Options: paths (separated by a NUL), dimension, signature, vectors, records (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "index_cache"

    def schema(self) -> str:
        return SCHEMA.replace("long", "bigint")

    def reader(self, schema) -> DataSourceReader:
        return _CacheReader(self.options)


def _local(path: str) -> str:
    return path.removeprefix("file://")


def read(spark: SparkSession, path: str, dimension: int | None = None, signature: str | None = None, with_vectors: bool = True) -> DataFrame:
    """chunk_id, source, text, vec of a cache file, or of the files of a folder, that all machines see under that path.
    Ids are places, and go on from file to file in the order of their names.

    A file is read by runs of records at a time, each in a task, which holds HELD_BYTES. Leaving vectors out skips
    decoding them. CacheError, in Spark's own, if a file is not as it should be or as asked for.
    """
    spark.dataSource.register(CacheFiles)
    local = _local(path)
    paths = sorted(e.path for e in os.scandir(local) if e.is_file()) if os.path.isdir(local) else [local]
    options = {"paths": "\0".join(paths), "vectors": str(with_vectors).lower(), "records": str(RECORDS)}
    options |= {k: str(v) for k, v in (("dimension", dimension), ("signature", signature)) if v is not None}
    return spark.read.format("index_cache").options(**options).load()


def write(chunks: DataFrame, path: str, dimension: int, signature: str, folder: str | None = None) -> int:
    """Write chunks (source, text, vec, in order of chunk_id) as one file that all machines see under that path.

    Where each record goes follows from the lengths of those before it, so tasks write their records into their places of
    one file at a time, again if they are lost; it gets its name when all are there. Chunks without a vector are left out,
    and their number is no part of the count. More than MOST_CHUNKS are an error, see `write_files`. folder: a new one for
    what is written in between, beside the file where it is not given. Returns the number written.
    """
    local = _local(path)
    new = f"{local}.new-{uuid.uuid4().hex}"
    count = _write(chunks, lambda file: new, local, 1, dimension, signature, folder)
    os.replace(new, local)
    return count


def write_files(chunks: DataFrame, path: str, dimension: int, signature: str, folder: str | None = None) -> int:
    """Like `write`, as files of a new folder, each of which is a cache of its own with MOST_CHUNKS chunks at most: any
    number of chunks."""
    local = _local(path)
    new = f"{local}.new-{uuid.uuid4().hex}"
    os.makedirs(new)
    try:
        count = _write(chunks, lambda file: f"{new}/{file:06d}.bin", local, None, dimension, signature, folder)
        os.rename(new, local)
    except BaseException:
        shutil.rmtree(new, ignore_errors=True)
        raise
    return count


def _write(chunks: DataFrame, named: Callable[[int], str], local: str, most_files: int | None, dimension: int, signature: str, folder: str | None) -> int:
    """Write files of chunks, by their numbers from 0, under the names that `named` gives them."""
    spark = chunks.sparkSession
    between = folder or f"file://{os.path.dirname(os.path.abspath(local))}/cache-parts-{uuid.uuid4().hex}"
    words = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "text")]
    each = chunks.select("chunk_id", *words, F.col("vec").cast("array<float>").alias("vec"))
    # Files hold whole runs, but for a single one that may be as full as the format lets it be.
    length = min(RECORDS, MOST_CHUNKS)
    per_file = MOST_CHUNKS if most_files == 1 else MOST_CHUNKS // length * length
    # Written first: a condition on vectors works them out once for itself, and dealing rows out by ranges all once more.
    each.write.parquet(f"{between}/each")
    kept = spark.read.schema(each.schema).parquet(f"{between}/each").where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    placed = in_order(kept, ["chunk_id"], f"{between}/placed").withColumn("run", F.floor(F.col("place") / length))
    size = F.octet_length("source") + F.octet_length("text") + F.lit(8 + 4 * dimension)
    try:
        count, wrong = placed.agg(F.count("*"), F.count_if(F.size("vec") != dimension)).first()
        n_files = -(-count // per_file)
        if not 1 <= n_files <= (most_files or n_files):
            raise CacheError("the number of chunks is out of bounds")
        if wrong:
            raise CacheError(f"{wrong} vectors in a cache of {dimension} do not have so many components")
        headers = [_header(dimension, signature, min(per_file, count - i * per_file)) for i in range(n_files)]
        ends, starts = list(map(len, headers)), []
        for r in placed.groupBy("run").agg(F.sum(size).alias("size")).orderBy("run").collect():  # one row for RECORDS chunks
            file = r["run"] * length // per_file
            starts.append((r["run"], file, ends[file]))
            ends[file] += r["size"]
        for i, (header, end) in enumerate(zip(headers, ends, strict=True)):
            with open(named(i), "wb") as f:
                f.write(header)
                f.truncate(end)
        before = F.coalesce(F.sum(size).over(Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each = placed.join(F.broadcast(spark.createDataFrame(starts, "run long, file long, start long")), "run").select("source", "text", "vec", "file", (F.col("start") + before).alias("at")).sortWithinPartitions("file", "at")

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, now, f = 0, None, None
            with ExitStack() as stack:
                for batch in pieces(batches):
                    vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dimension)
                    columns = (batch.column(c).to_pylist() for c in ("file", "at", "source", "text"))
                    for file, at, source, body, vector in zip(*columns, vectors, strict=True):
                        if file != now:
                            _stored(f)
                            stack.close()
                            now, f, upto = file, stack.enter_context(open(named(file), "r+b", buffering=1 << 20)), -1
                        # Going to a place empties the buffer, and most records follow the one before.
                        if at != upto:
                            f.seek(at)
                        upto = at + f.write(_text(source) + _text(body) + vector.tobytes())
                        n += 1
                _stored(f)
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

        written = each.mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0]
        if written != count or [os.path.getsize(named(i)) for i in range(n_files)] != ends:
            raise CacheError(f"{written} of {count} chunks were written")
    finally:
        if folder is None:
            shutil.rmtree(_local(between), ignore_errors=True)
    return count


def _stored(file) -> None:
    """Have what is written to an open file, if any, on the disk."""
    if file is not None:
        file.flush()
        os.fsync(file.fileno())
