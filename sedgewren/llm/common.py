"""What the corpus operators share: the shared folder, tables that cut lineage,
and byte-level tokenising of whole Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}

#: Bytes of a word after lower-casing: 0-9, a-z and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = True
WORD_BYTE[0x61:0x7B] = True
WORD_BYTE[0x80:] = True
#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of a whitespace-separated word.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out if it is scanned by fewer tasks than the session has cores (one file of one row group)."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir of the session. Only a local session, whose executors are the driver, may
    leave it unset; such a session gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="sedgewren-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[sc.applicationId], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sedgewren/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: What `materialise` and `bucketed` have written and `scope` has not deleted, in order.
_written: list[str] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[], str]]:
    """At its end, all tables written in it are deleted but those after which the function that it gives was called, which
    returns their path. Only what is read no more may be written in it: results that are still to be computed read such
    tables."""
    mark, kept = len(_written), set()

    def keep() -> str:
        kept.add(_written[-1])
        return _written[-1]

    try:
        yield keep
    finally:
        here, _written[mark:] = _written[mark:], [p for p in _written[mark:] if p in kept]
        for path in here:
            if path not in kept:
                forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all that this application has written in the shared folder; nothing that reads it works any more."""
    forget(spark, f"{shared_dir(spark)}/sedgewren/{spark.sparkContext.applicationId}")
    _written.clear()


def materialise(df: DataFrame, name: str, partition_by: str | None = None, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd").options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like `materialise`, in as many buckets by a hash of the key as there are shuffle partitions, each sorted by it:
    tables of one session that are written like this join on the key without an exchange. df should be dealt out by the
    key already, so that a bucket is one file. The table is in the catalog only while it is opened."""
    spark = df.sparkSession
    table = f"sedgewren_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, name)
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    _written.append(path)
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def hex_key(text) -> F.Column:
    """The first 60 bits of the MD5 of a string, as a long: a uniform key that SQL engines agree on."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


# ---------------------------------------------------------------- Arrow batches


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (one more than rows); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most most_bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = column_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most_bytes, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def word_spans(buf: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and for each row (one more at the end) the index of its first word.

    Words never cross rows.
    """
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    mask = is_word[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[at[:-1][at[:-1] < n]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends_at = at[1:]
    after[ends_at[ends_at > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where it can be."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Bytes that are hashed at once; tables of powers are as long.
_PIECE = 1 << 20


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < _PIECE + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(_PIECE + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _long_hash(word: np.ndarray) -> np.uint64:
    """The sum that `word_hashes` makes of a word of any length, piece by piece."""
    power, _ = _power_tables()
    total, at = np.uint64(0), 1
    for i in range(0, len(word), _PIECE):
        piece = word[i : i + _PIECE]
        total += (_BYTE_VALUE[piece] * power[: len(piece)]).sum(dtype=np.uint64) * np.uint64(at)
        at = at * pow(int(_BASE), _PIECE, 1 << 64) % (1 << 64)
    return total


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same in every batch and process. What it takes beside its result does
    not grow with the text."""
    out = np.empty(len(starts), np.uint64)
    power, inverse = _power_tables()
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            base = int(starts[first])
            last = int(np.searchsorted(ends, base + _PIECE, "right"))
            if last <= first:
                out[first] = _long_hash(buf[base : ends[first]])
                first += 1
                continue
            piece = buf[base : ends[last - 1]]
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_VALUE[piece] * power[: len(piece)], out=sums[1:])
            a, b = starts[first:last] - base, ends[first:last] - base
            out[first:last] = (sums[b] - sums[a]) * inverse[a]
            first = last
    out += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(out)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive values of h; len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[k : k + n]
    return mix(out)
