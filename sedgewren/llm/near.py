"""N-gram Jaccard join: MinHash banding, then verification on full sets of word shingles.

Texts of the same words are one node from the start. Band hashes are shuffled to find which nodes meet in a bucket;
each bucket only ties its members to its least one, so a bucket of any size makes as many rows as it has members.
The components of those ties are cells: every pair that meets in a bucket is inside one cell. Unlike texts can tie
many nodes into one cell by chance; a cell of more than one block is therefore cut again, along the pairs of its buckets
whose whole signatures agree nearly as often as the threshold asks. The shingle sets of a cell's members are then
brought together in blocks of bounded size, and all pairs of a block, or of two blocks, that meet in a bucket are
compared on their full sets. A block returns one row per member, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import LOWER, WORD_BYTE, blocks, column_bytes, materialise, mix, window_hashes, word_hashes, word_spans
from sedgewren.llm.components import connected_components
from sedgewren.llm.exact import bitmap_filter, may_contain

WIDTH, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.99999, 160
#: Shingles that are hashed at once: few enough for a core's cache.
_AT_ONCE = 1 << 15
#: Shingles of a block of a cell on average, a member counting as MEMBER_COST more: some 180 members.
BLOCK_SHINGLES, MEMBER_COST = 1_500_000, 8192
#: Members of a bucket whose signatures are compared at once, and rows of a task that compares small buckets.
BUCKET_BLOCK, BUCKET_ROWS = 2048, 20_000
#: Standard deviations by which the agreement of two signatures may stay under the threshold.
DEVIATIONS = 5.0


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """The most rows a band may have, and the number of bands, so that two sets of that similarity meet in a band with
    probability `recall`. More rows let fewer unlike pairs meet."""
    for rows in range(most_hashes, 0, -1):
        missed = math.log1p(-(threshold**rows))
        if missed and (bands := max(1, math.ceil(math.log1p(-recall) / missed))) * rows <= most_hashes:
            return bands, rows
    raise ValueError("most_hashes is too small for this recall")


class Shingles:
    """The distinct words' hashes of a block of rows and, per row, a digest of its words and its shingle hashes.

    A row of fewer words than `width`, but not none, has one shingle of all its words.
    """

    def __init__(self, column: pa.Array, width: int):
        buf, at = column_bytes(column)
        buf = LOWER[buf]
        starts, ends, firsts = word_spans(buf, at, WORD_BYTE)
        h = word_hashes(buf, starts, ends)
        n = np.diff(firsts)
        row = np.repeat(np.arange(len(n)), n)
        place = (np.arange(len(h)) - firsts[:-1][row]).astype(np.uint64) if len(h) else np.empty(0, np.uint64)
        sums = [np.zeros(len(h) + 1, np.uint64) for _ in range(2)]
        for k, s in enumerate(sums):
            np.cumsum(mix(h ^ mix(place + np.uint64(0x51ED27 + 77 * k))), out=s[1:])
        self.digests = [mix((s[firsts[1:]] - s[firsts[:-1]]) ^ n.astype(np.uint64)) for s in sums]
        self.n_words = n
        self.counts = np.where(n > 0, np.maximum(1, n - width + 1), 0)
        self.ends = np.cumsum(self.counts)
        self.hashes = np.empty(int(self.ends[-1]) if len(n) else 0, np.uint64)
        short = (n > 0) & (n < width)
        self.hashes[(self.ends - self.counts)[short]] = self.digests[0][short]
        if len(h) >= width:
            valid = np.ones(len(h) - width + 1, bool)
            for k in range(1, width):
                stop = firsts[1:] - k
                stop = stop[(stop >= firsts[:-1]) & (stop < len(valid))]
                valid[stop] = False
            mask = np.ones(len(self.hashes), bool)
            mask[(self.ends - self.counts)[short]] = False
            self.hashes[mask] = window_hashes(h, width)[valid]

    def set_of(self, i: int) -> np.ndarray:
        return np.unique(self.hashes[self.ends[i] - self.counts[i] : self.ends[i]])

    def bands(self, n_bands: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows that have shingles: a matrix of band hashes, which the number of the band is part of, and one of
        the last bytes of all MinHash values."""
        full = np.flatnonzero(self.counts > 0)
        at = (self.ends - self.counts)[full]
        least = np.empty((n_bands * n_rows, len(full)), np.uint64)
        seeds = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, n_bands * n_rows, np.uint64)
        first = 0
        while first < len(full):
            # Whole rows of _AT_ONCE shingles, or one longer row.
            after = max(first + 1, int(np.searchsorted(at, at[first] + _AT_ONCE)))
            h = self.hashes[at[first] : self.ends[full[after - 1]]]
            offsets = at[first:after] - at[first]
            x, y = np.empty_like(h), np.empty_like(h)
            for k, seed in enumerate(seeds):
                # All of the mixing matters: a multiplication alone orders sets too much alike.
                np.bitwise_xor(h, seed, out=x)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    np.right_shift(x, np.uint64(shift), out=y)
                    np.bitwise_xor(x, y, out=x)
                    np.multiply(x, np.uint64(factor), out=x)
                np.minimum.reduceat(x, offsets, out=least[k, first:after])
            first = after
        out = np.empty((len(full), n_bands), np.uint64)
        for b in range(n_bands):
            key = np.full(len(full), b + 1, np.uint64)
            for k in range(b * n_rows, (b + 1) * n_rows):
                key = mix(key + least[k])
            out[:, b] = key
        return out, np.ascontiguousarray((least & np.uint64(0xFF)).astype(np.uint8).T)


_SIGNED_DDL = "doc_id {}, row_hash bigint, d1 bigint, d2 bigint, n_shingles bigint, bands array<bigint>, sketch binary"


def _signed(width: int, n_bands: int, n_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            s = Shingles(block.column("text"), width)
            full = s.counts > 0
            ends = np.concatenate([[0], np.cumsum(full * n_bands)]).astype(np.int32)
            bands, sketch = s.bands(n_bands, n_rows)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))
            bytes_at = np.concatenate([[0], np.cumsum(full * n_bands * n_rows)]).astype(np.int32)
            sketches = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(bytes_at), pa.py_buffer(sketch.tobytes())])
            digests = [pa.array(d.view(np.int64), mask=~full) for d in s.digests]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("row_hash"), *digests, pa.array(s.counts.astype(np.int64)), keys, sketches],
                names=["doc_id", "row_hash", "d1", "d2", "n_shingles", "bands", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
        for block in blocks(batches, "text"):
            s = Shingles(block.column("text"), width)
            right = (s.digests[0].view(np.int64) == block.column("d1").to_numpy()) & (s.digests[1].view(np.int64) == block.column("d2").to_numpy())
            at = np.flatnonzero(right)
            yield pa.RecordBatch.from_arrays([block.column("node").take(pa.array(at)), pa.array([s.set_of(i).tobytes() for i in at], pa.binary())], schema=schema)

    return run


def least_of(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row that links tie it to."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _strong(least: int):
    """u, v: ties of the members of each bucket whose sketches agree in `least` places or more, at most one each."""

    def run(key, table):
        frame = table.combine_chunks().sort_by([("band", "ascending"), ("first", "ascending"), ("second", "ascending"), ("node", "ascending")])
        columns = [frame.column(c).to_numpy() for c in ("band", "first", "second", "node")]
        new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)]))
        sketch = np.frombuffer(b"".join(frame.column("sketch").to_pylist()), np.uint8).reshape(len(frame), -1)
        us, vs = [], []
        for a, b in zip(new, [*new[1:], len(frame)], strict=True):
            x, node = sketch[a:b], columns[3][a:b]
            linked = np.empty((b - a, b - a), bool)
            step = max(1, (1 << 24) // x.size)
            for i in range(0, b - a, step):
                linked[i : i + step] = (x[i : i + step, None, :] == x[None, :, :]).sum(axis=2) >= least
            label = least_of(linked)
            tied = np.flatnonzero(label != np.arange(b - a))
            us.append(node[tied])
            vs.append(node[label[tied]])
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return run


def _cut(members: DataFrame, n_members: int, n_hashes: int, threshold: float) -> DataFrame:
    """node, cell of those members (node, bands, sketch) that a bucket ties to another with nearly the threshold's
    agreement. Of buckets with the same members one is looked at; a bucket of very many is compared block by block."""
    least = max(1, math.ceil(n_hashes * threshold - DEVIATIONS * math.sqrt(n_hashes * threshold * (1 - threshold))))
    keys = members.select("node", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("x"))
    once = materialise(buckets.where("n > 1").groupBy("n", "a", "b", "x").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks")), "buckets")
    parts = max(1, n_members // BUCKET_ROWS)
    there = members.select("node", "sketch", F.explode("bands").alias("band")).join(once, "band")
    there = there.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    there = there.select("band", "node", "sketch", "blocks", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band"), F.lit(parts))).otherwise(F.xxhash64("band", "first", "second"))
    ties = there.groupBy(task.alias("task")).applyInArrow(_strong(least), "u bigint, v bigint")
    return connected_components(ties).select("node", F.col("root").alias("cell"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of the sizes of all pairwise intersections of sorted unique arrays."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    if not len(values):
        return out.astype(np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    many = np.diff(np.append(np.flatnonzero(new), len(values)))
    shared = np.repeat(many > 1, many)
    column = (np.cumsum(new) - 1)[shared]
    owner = owner[shared]
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        dense = np.zeros((n, 4096), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense @ dense.T
    return np.rint(out).astype(np.int64)


def _verified(threshold: float):
    def run(key, table):
        _, first, second = (k.as_py() for k in key)
        frame = table.combine_chunks().sort_by("node")
        nodes, blocks_of, copies = (frame.column(c).to_numpy() for c in ("node", "block", "copies"))
        once = np.concatenate([[True], nodes[1:] != nodes[:-1]])
        keep = np.flatnonzero(once)
        nodes, blocks_of, copies = nodes[keep], blocks_of[keep], copies[keep]
        sets = [np.frombuffer(frame.column("shingles")[int(i)].as_py(), np.uint64) for i in keep]
        bands = np.array([frame.column("bands")[int(i)].as_py() for i in keep], np.int64)
        meet = np.zeros((len(keep), len(keep)), bool)
        for b in range(bands.shape[1]):
            meet |= bands[:, b][:, None] == bands[:, b][None, :]
        if first != second:
            meet &= blocks_of[:, None] != blocks_of[None, :]
        np.fill_diagonal(meet, False)
        size = np.array([len(s) for s in sets])
        common = overlaps(sets)
        # |A and B| / |A or B| >= t, without a division.
        linked = meet & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9)
        root = least_of(linked)
        return pa.table({"node": nodes, "parent": nodes[root], "links": (linked * copies[None, :]).sum(axis=1).astype(np.int64)})

    return run


def jaccard_links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """doc_id, class_id, n_links: one row per row of docs.

    Two rows are linked if their sets of `width`-word shingles, lower-cased, have that Jaccard similarity; rows of the
    same words are. n_links counts a row's links, copies included; class_id is the smallest id of the rows that links
    tie together. Null, empty and wordless texts have no shingles, are alone and have no link; a text of fewer words
    than `width` has one shingle; texts of any length are compared whole. Ids are of any type that has an order and may
    repeat or be null (a class of null ids only has a null class_id). A pair of exactly the threshold's similarity is
    found with probability `recall`, a more similar one with more; in cells of more than one block a pair is also lost
    if its signatures agree DEVIATIONS standard deviations less often than they should (3 of 10 million pairs). No rows
    give no rows; other columns are not looked at.
    """
    n_bands, n_rows = bands_for(threshold, recall, most_hashes)
    # A row is found again by a hash of its text and id: ids alone may be null or the same for very many rows.
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column, id_column).alias("row_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = materialise(rows.mapInArrow(_signed(width, n_bands, n_rows), _SIGNED_DDL.format(kind)), "signed")
    words = signed.where(F.col("d1").isNotNull())
    # Rows of the same words are one node, and any of them stands for it.
    nodes = words.groupBy("d1", "d2").agg(F.min("row_hash").alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    standing = words.join(nodes, ["d1", "d2"]).where(F.col("row_hash") == F.col("rep"))
    keys = standing.select("node", F.explode("bands").alias("band")).distinct()
    buckets = keys.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = keys.join(buckets, "band").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    cells = connected_components(ties)

    banded = standing.select("node", "bands", "sketch", "n_shingles", "copies", "d1", "d2", "rep").dropDuplicates(["node"])
    planned = materialise(cells.select("node", F.col("root").alias("cell")).join(banded, "node"), "planned")
    weight = F.ceil(F.sum(F.col("n_shingles") + MEMBER_COST) / BLOCK_SHINGLES).cast("int").alias("blocks")
    large = materialise(planned.groupBy("cell").agg(weight, F.count("*").alias("n")).where("blocks > 1"), "large-cells")
    if n_large := large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]:
        of_large = materialise(planned.join(large.select("cell"), "cell", "left_semi").drop("cell"), "cut")
        again = of_large.join(_cut(of_large, n_large, n_bands * n_rows, threshold), "node")
        planned = materialise(planned.join(large.select("cell"), "cell", "left_anti").unionByName(again), "planned")

    by_rep = planned.select("node", "d1", "d2", F.col("rep").alias("row_hash"))
    wanted = may_contain(rows, "row_hash", bitmap_filter(by_rep, "row_hash", "members-filter"))
    texts = wanted.join(by_rep, "row_hash").select("node", "d1", "d2", "text")
    # Repeated rows have one hash: one set of each node goes on.
    sets = texts.mapInArrow(_sets(width), "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    # Blocks by a hash of the node: as large as meant on average, without an order within a cell.
    dealt = planned.join(planned.groupBy("cell").agg(weight), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "cell", "block", "copies", "bands", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    checked = dealt.join(sets, "node").groupBy("cell", "first", "second").applyInArrow(_verified(threshold), "node bigint, parent bigint, links bigint")
    checked = materialise(checked, "checked")

    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(checked.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    smallest = classes.join(nodes, "node").groupBy("root").agg(F.min("least_id").alias("class_least"), F.lit(True).alias("in_class"))
    per_node = nodes.join(classes.join(smallest, "root").select("node", "class_least", "in_class"), "node", "left").join(links, "node", "left")
    class_id = F.when(F.col("in_class"), F.col("class_least")).otherwise(F.col("least_id"))
    per_node = per_node.select("d1", "d2", class_id.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    # Rows without words are no group: they stay out of the join.
    linked = words.select("doc_id", "d1", "d2").join(materialise(per_node, "per-node"), ["d1", "d2"]).select("doc_id", "class_id", "n_links")
    alone = signed.where(F.col("d1").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)
