"""Greedy packing of items into batches for an encoder: by list, and over a whole library in its order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions.embedding import Embedder, packed
from sedgewren.operators.ordering import in_order

#: Items of a block, and blocks or groups of blocks whose maps one task puts together.
BLOCK, GROUP = 16_384, 4096


def batch_numbers(sizes: Column, config: RetrievalConfig = DEFAULT) -> Column:
    """array<int>: the batch, from 1, of each item of an array of token counts, in order.

    A batch holds batch_items items, batch_tokens and batch_context tokens at most; an item that is larger goes alone,
    and an item without tokens is left out (0).
    """

    @F.arrow_udf("array<int>")
    def numbers(lists: pa.Array) -> pa.Array:
        out = []
        for items in lists.to_pylist():
            batch = None if items is None else np.zeros(len(items), np.int32)
            for k, places in enumerate(packed(items or [], config), 1):
                batch[places] = k
            out.append(batch)
        return pa.array(out, pa.list_(pa.int32()))

    return numbers(sizes)


def _steps(sizes: np.ndarray, n: int, config: RetrievalConfig) -> np.ndarray:
    """For each of the first n items: where the next batch would start if one started at it; one without tokens, which no
    batch holds, is passed over. sizes has batch_items more items, or zeros."""
    most = min(config.batch_tokens, config.batch_context)
    used, taken = sizes[:n].copy(), np.ones(n, np.int64)
    going = used > 0
    for k in range(1, config.batch_items):
        more = sizes[k : k + n]
        going &= (more > 0) & (used + more <= most) & (used < config.batch_context)
        used += np.where(going, more, 0)
        taken += going
    return np.arange(n) + taken


def _block_map(config: RetrievalConfig, block: int):
    """Of a block: for each place among its first batch_items where a batch may start, the place in the next block where
    the first batch of that starts, and how many batches start in between."""

    def run(key, table):
        number, frame = key[0].as_py(), table.sort_by("place")
        at = frame.column("place").to_numpy() - number * block
        sizes = np.zeros(block + config.batch_items, np.int64)
        sizes[at] = frame.column("size").to_numpy()
        step = _steps(sizes, block, config)
        exits, batches = np.zeros(block + config.batch_items, np.int64), np.zeros(block + config.batch_items, np.int64)
        exits[block:] = np.arange(config.batch_items)
        for i in range(block - 1, -1, -1):
            exits[i], batches[i] = exits[step[i]], batches[step[i]] + (sizes[i] > 0)
        return pa.table({"block": [number], "exits": [exits[: config.batch_items].tolist()], "batches": [batches[: config.batch_items].tolist()]})

    return run


def _together(key, table):
    """The map of a group of blocks."""
    frame = table.sort_by("block")
    exits, batches = (np.array(frame.column(c).to_pylist()) for c in ("exits", "batches"))
    at, total = np.arange(exits.shape[1]), np.zeros(exits.shape[1], np.int64)
    for e, b in zip(exits, batches, strict=True):
        at, total = e[at], total + b[at]
    return pa.table({"block": [key[0].as_py()], "exits": [at.tolist()], "batches": [total.tolist()]})


def _along(key, table, start):
    """Where the first batch of each block of a group starts, and how many start before."""
    frame = table.sort_by("block")
    at, before = (start.column(c)[0].as_py() for c in ("entry", "before")) if start.num_rows else (0, 0)
    out = []
    for block, exits, batches in zip(*(frame.column(c).to_pylist() for c in ("block", "exits", "batches")), strict=True):
        out.append((block, at, before))
        at, before = exits[at], before + batches[at]
    return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("block", "entry", "before"))})


_MAP, _ENTRY = "block bigint, exits array<bigint>, batches array<bigint>", "block bigint, entry bigint, before bigint"


def _entries(maps: DataFrame, group: int, folder: str, level: int = 0) -> DataFrame:
    """block, entry, before of all blocks: maps are put together by groups until one group is left, and taken apart again."""
    spark = maps.sparkSession
    maps.write.parquet(f"{folder}/maps-{level}")
    maps = spark.read.parquet(f"{folder}/maps-{level}").withColumn("up", F.floor(F.col("block") / group))
    if maps.select("up").distinct().count() > 1:
        ups = _entries(maps.groupBy("up").applyInArrow(_together, _MAP), group, folder, level + 1).withColumnRenamed("block", "up")
    else:
        ups = spark.createDataFrame([], "up bigint, entry bigint, before bigint")
    return maps.groupBy("up").cogroup(ups.groupBy("up")).applyInArrow(_along, _ENTRY)


def _dealt(config: RetrievalConfig, block: int):
    def run(key, table, start):
        number, frame = key[0].as_py(), table.sort_by("place")
        at, halo = frame.column("place").to_numpy() - number * block, config.batch_items
        sizes = np.zeros(block + halo, np.int64)
        sizes[at] = frame.column("size").to_numpy()
        step, n = _steps(sizes, block, config), min(block, int(at.max()) + 1)
        i, batch = start.column("entry")[0].as_py(), start.column("before")[0].as_py()
        out = np.zeros(block + halo, np.int64)
        out[:i] = batch
        while i < n:
            if sizes[i] > 0:
                batch += 1
                out[i : step[i]] = batch
            i = step[i]
        own = at[at < block]
        return pa.table({"place": own + number * block, "batch": out[own]})

    return run


def library_batches(items: DataFrame, folder: str, id_column: str = "chunk_id", size_column: str = "n_tokens", config: RetrievalConfig = DEFAULT, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """id, size, batch (from 1) of all items in the order of their ids, packed as batch_numbers packs a list.

    Where a batch ends only depends on where it starts, so each block of items gives a map from where its first batch may
    start to where the next block's does. Maps are put together in parallel, and each block is then packed for itself.
    Items without tokens have batch 0. folder: a new one that driver and executors share, for what is written in between.
    """
    spark = items.sparkSession
    placed = in_order(items.select(F.col(id_column).alias("id"), F.col(size_column).cast("long").alias("size")), ["id"], f"{folder}/items")
    own = F.floor(F.col("place") / block)
    # The first items of a block may belong to the last batch of the block before.
    also = F.when((F.col("place") % block < config.batch_items) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    blocks = placed.select("place", "size", F.explode(also).alias("block")).groupBy("block")
    starts = _entries(blocks.applyInArrow(_block_map(config, block), _MAP), group, folder)
    numbers = blocks.cogroup(starts.groupBy("block")).applyInArrow(_dealt(config, block), "place bigint, batch bigint")
    return placed.join(numbers, "place").select(F.col("id").alias(id_column), F.col("size").alias(size_column), "batch")


def embed_batches(chunks: DataFrame, make: Callable[[], Embedder], text_column: str = "text") -> DataFrame:
    """chunks (with their batch) and vec: one call of the encoder for each batch, which lies in one task whole. Chunks of
    batch 0, and those without a vector, have none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", vec array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder, held = make(), None

        def encoded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            texts, number = rows.column(text_column).to_pylist(), rows.column("batch").to_numpy()
            vectors: list = [None] * len(texts)
            for k in np.unique(number[number > 0]):
                at = np.flatnonzero(number == k)
                for i, v in zip(at, embedder.embed([texts[i] or "" for i in at]), strict=True):
                    vectors[i] = v.astype(np.float32) if v.any() else None
            yield from rows.append_column("vec", pa.array(vectors, pa.list_(pa.float32()))).combine_chunks().to_batches()

        for batch in batches:
            # The last batch of the encoder may go on in the next batch of rows.
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            number = rows.column("batch").to_numpy()
            whole = int(np.searchsorted(number, number[-1])) if len(number) else 0
            held = rows.slice(whole)
            if whole:
                yield from encoded(rows.slice(0, whole))
        if held is not None and held.num_rows:
            yield from encoded(held)

    return chunks.repartitionByRange("batch").sortWithinPartitions("batch").mapInArrow(run, schema)
