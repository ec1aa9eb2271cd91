"""Index refresh: bursts of changes are one trigger, and each trigger builds and publishes a snapshot, or updates an index
of segments."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.operators import segments
from sedgewren.operators.index import build, is_current, publish
from sedgewren.sources import kb
from sedgewren.sources.changes import changes
from sedgewren.streaming.timers import bursts

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str) -> DataFrame:
    """New files under root as a stream; edits and deletions show in the directory's signature."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{txt,md,docx,doc,TXT,MD,DOCX,DOC}").option("recursiveFileLookup", "true").load(root)


def debounce(events: DataFrame, ts: str = "ts", key: str | None = None, gap: str | None = None, lateness: str | None = None, config: RetrievalConfig = DEFAULT) -> DataFrame:
    """key, start, end (of the last event), n_events: one row per burst, in which no event is more than the gap after
    the one before. On a stream give the lateness to wait for; ts must then be a timestamp with time zone."""
    gap = gap or f"{config.debounce_ms} milliseconds"
    if lateness:
        events = events.withWatermark(ts, lateness)
    # A stream needs a key beside the window: the same for all rows, but not a literal.
    groups = [F.session_window(ts, gap).alias("w"), F.col(key) if key else F.col(ts).isNull().alias("_all")]
    return events.groupBy(*groups).agg(F.max(ts).alias("end"), F.count("*").alias("n_events")).select(*([key] if key else []), F.col("w.start").alias("start"), "end", "n_events")


def rebuild(spark: SparkSession, root: str, index_root: str, embed: Callable[[Column], Column] | None = None, embedder: str = "", config: RetrievalConfig = DEFAULT, on_step: Callable[[int, int], None] | None = None) -> int | None:
    """Build the index of a directory and publish it; None if the published one is of the same files and settings.

    Chunks that embed gives no vector are left out. on_step(done, total) is told of each step: listed, published.
    """
    told = on_step or (lambda done, total: None)
    sign = kb.directory_signature(spark, root)
    if is_current(spark, index_root, sign, embedder, config):
        return None
    files = kb.scan(spark, root)
    numbers = kb.numbered(files)
    told(1, 2)
    chunks = kb.chunks_of(kb.read_texts(files), numbers, config)
    if embed is not None:
        chunks = chunks.withColumn("vec", embed(F.col("text"))).where(F.col("vec").isNotNull())
    n = publish(build(chunks), index_root, sign, embedder, config)
    told(2, 2)
    return n


def update_directory(spark: SparkSession, root: str, index_root: str, embed: Callable[[Column], Column] | None = None, embedder: str = "", config: RetrievalConfig = DEFAULT, recursive: bool = False, on_file: Callable[[int, int], None] | None = None) -> segments.Update:
    """Bring an index of segments to the files of a directory; only new and changed ones are read, and on_file(done,
    total) is told of them."""
    listing = kb.scan(spark, root, recursive).select("path", "length", "modificationTime")
    return segments.update(spark, index_root, listing, lambda fresh: kb.read_texts(kb.scan_of(spark, root, fresh, recursive)), embed, embedder, config, on_file)


def follow(spark: SparkSession, root: str, index_root: str, checkpoint: str, embed: Callable[[Column], Column] | None = None, embedder: str = "", config: RetrievalConfig = DEFAULT, recursive: bool = False, on_update: Callable[[segments.Update], None] | None = None, interval: str = "0 seconds") -> StreamingQuery:
    """Keep an index of segments up with a directory: files that are added, changed or removed are one burst until nothing
    has changed for the debounce time, and each burst is one update.

    A micro-batch is single-flight: what happens during an update is in a later one. Timers and listings are in the
    checkpoint, so a query that is started again from it goes on where it was. The first start brings all files.
    """
    over = bursts(spark, changes(spark, root, recursive), "directory", config.debounce_ms)

    def on_burst(batch: DataFrame, _: int) -> None:
        # All of the batch is taken, a row at most: state of parts that nobody asks for would not be committed.
        if batch.collect():
            done = update_directory(batch.sparkSession, root, index_root, embed, embedder, config, recursive)
            if on_update:
                on_update(done)

    return over.writeStream.foreachBatch(on_burst).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def settled(spark: SparkSession, root: str, config: RetrievalConfig = DEFAULT, most_waits: int = 100) -> bool:
    """Wait until the directory has not changed for the debounce time, so that a burst of writes is one rebuild; False
    if it still changes after most_waits waits."""
    before = kb.directory_signature(spark, root)
    for _ in range(most_waits):
        time.sleep(config.debounce_ms / 1000)
        now = kb.directory_signature(spark, root)
        if now == before:
            return True
        before = now
    return False


def refresh(spark: SparkSession, root: str, index_root: str, checkpoint: str, embed: Callable[[Column], Column] | None = None, embedder: str = "", config: RetrievalConfig = DEFAULT, on_step: Callable[[int, int], None] | None = None, **trigger) -> StreamingQuery:
    """Rebuild whenever files arrive and the directory has settled; an error if it never does. `follow` also sees edits and
    removals, and does not wait. A micro-batch is single-flight: what arrives
    meanwhile is in the next one, and an index of the same files is not built again."""

    def on_change(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            if not settled(batch.sparkSession, root, config):
                raise TimeoutError(f"{root} does not come to rest")
            rebuild(batch.sparkSession, root, index_root, embed, embedder, config, on_step)

    return watch(spark, root).select("path").writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
