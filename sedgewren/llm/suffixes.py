"""Repeated passages from sparse suffix arrays over words.

Of all suffixes of a text only those at minimisers are kept: in every run of `LEAST - PREFIX + 1` places the one whose
K-word hash is least. Copies of a passage of LEAST words choose the same places, and one of them has PREFIX words of
the passage to its right. Suffixes whose prefix no other text has are left out by a hash of it. The others are dealt out
by their prefix and sorted by it and by their words, so that suffixes that share a prefix are neighbours. There, matches
are extended to the left and right: for each of the runs of LEAST words that cover the prefix, the suffixes are put in
order of that run, and neighbours are compared word by word (by 64-bit hashes of words). The union of the runs that
neighbours from different texts share is what is repeated. What is moved is one row per text and context of its kept
suffixes: a text that says the same words over and over has one row for all places with the same words around them.

A prefix of more than HOT_SUFFIXES rows is not brought into one task. Its rows are sorted over all tasks by the words from
the place on, then by those before it. What a row has in common with its neighbours is the most that it has in common with
any other, so its context is cut off there, and rows of the same cut context are one class. The runs of the classes are
counted by two 64-bit hashes, and what is found goes back to the rows class by class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import LOWER, WORD_BYTE, blocks, column_bytes, materialise, mix, word_hashes, word_spans
from sedgewren.llm.exact import bitmap_filter, may_contain

LEAST, PREFIX, K = 50, 20, 8
#: Most rows of one prefix that are compared in one task, and rows that are compared at once.
HOT_SUFFIXES, AT_ONCE = 20_000, 8_192
_BASE = np.uint64(0x9FB21C651E98DF25)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, at = column_bytes(column)
    buf = LOWER[buf]
    starts, ends, firsts = word_spans(buf, at, WORD_BYTE)
    return word_hashes(buf, starts, ends), firsts


def _runs_at(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the width words from each place on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * _BASE + h[at + k]
    return mix(out)


def _digests(h: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    n = np.diff(firsts)
    place = (np.arange(len(h)) - np.repeat(firsts[:-1], n)).astype(np.uint64)
    out = []
    for k in (3, 5):
        s = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ mix(place + np.uint64(0xC0FFEE * k))), out=s[1:])
        out.append(mix((s[firsts[1:]] - s[firsts[:-1]]) ^ n.astype(np.uint64)))
    return out


def minimisers(h: np.ndarray, firsts: np.ndarray, span: int, least: int) -> np.ndarray:
    """Places of the least K-word hash of any span consecutive places (the leftmost, if equal) inside a row of at least
    `least` words."""
    if len(h) < least:
        return np.empty(0, np.int64)
    grams = _runs_at(h, np.arange(len(h) - K + 1), K)
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    lowest = grams[:n].copy()
    for k in range(1, span):
        np.minimum(lowest, grams[k : k + n], out=lowest)
    inside = np.zeros(n + 1, np.int32)
    rows = np.flatnonzero(np.diff(firsts) >= least)
    np.add.at(inside, firsts[rows], 1)
    np.add.at(inside, np.minimum(firsts[rows + 1] - K - span + 2, n), -1)
    windows = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    lowest = lowest[windows]
    found = np.full(len(windows), -1, np.int64)
    for k in reversed(range(span)):
        at = windows + k
        found = np.where(grams[at] == lowest, at, found)
    return np.unique(found)


_SUFFIX_DDL = "doc_id {}, row_hash bigint, d1 bigint, d2 bigint, n_words bigint, keys array<bigint>, places array<int>"


def _suffixes(least: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            h, firsts = _words(block.column("text"))
            at = minimisers(h, firsts, least - prefix + 1, least)
            ends = pa.array(np.searchsorted(at, firsts).astype(np.int32))
            row = np.searchsorted(firsts, at, "right") - 1
            # The last minimisers of a row may have fewer words to their right: they start no passage's prefix.
            fits = at + prefix <= firsts[row + 1]
            at, row = at[fits], row[fits]
            ends = pa.array(np.searchsorted(at, firsts).astype(np.int32))
            digests = _digests(h, firsts)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("row_hash"), *(pa.array(d.view(np.int64)) for d in digests), pa.array(np.diff(firsts)), pa.ListArray.from_arrays(ends, pa.array(_runs_at(h, at, prefix).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array((at - firsts[row]).astype(np.int32)))],
                names=["doc_id", "row_hash", "d1", "d2", "n_words", "keys", "places"],
            )

    return run


_CONTEXT_DDL = "key bigint, node bigint, places array<int>, before binary, after binary"


def _contexts(least: int, prefix: int):
    """A row for each text and context of its kept places, with all places that have it: the words before a place that a
    run may reach, the nearest first, and those from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            buf, offsets = column_bytes(block.column("text"))
            buf = LOWER[buf]
            starts, ends, firsts = word_spans(buf, offsets, WORD_BYTE)
            h = word_hashes(buf, starts, ends)
            d1, d2 = (d.view(np.int64) for d in _digests(h, firsts))
            right = (d1 == block.column("d1").to_numpy()) & (d2 == block.column("d2").to_numpy())
            # All words with one space after each.
            begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
            joined = np.full(int(begin[-1]), 0x20, np.uint8)
            letters = buf[WORD_BYTE[buf]]
            joined[np.arange(len(letters)) + np.repeat(np.arange(len(starts)), ends - starts)] = letters
            # The same with the last word first.
            back = np.concatenate([[0], np.cumsum((ends - starts + 1)[::-1])])
            backwards = joined[np.repeat(begin[:-1][::-1] - back[:-1], np.diff(back)) + np.arange(len(joined))].tobytes()
            data = joined.tobytes()
            found = block.column("found")
            lists = np.flatnonzero(right)
            many = np.array([len(found[int(i)]) for i in lists], np.int64)
            kept = pa.concat_arrays([found[int(i)].values for i in lists]) if len(lists) else found.values[:0]
            row = np.repeat(lists, many)
            place = kept.to_numpy().astype(np.int64)
            at = firsts[row] + place
            low, high = np.maximum(at - (least - prefix), firsts[row]), np.minimum(at + least, firsts[row + 1])
            same: dict[tuple[int, bytes, bytes], list[int]] = {}
            for i, r, a, b, c, d in zip(range(len(at)), row.tolist(), back[len(starts) - at].tolist(), back[len(starts) - low].tolist(), begin[at].tolist(), begin[high].tolist(), strict=True):
                same.setdefault((r, backwards[a:b], data[c:d]), []).append(i)
            of = np.array([x[0] for x in same.values()], np.int64)
            held = np.concatenate([np.empty(0, np.int64), *same.values()]).astype(np.int64)
            upto = np.cumsum([0, *map(len, same.values())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_runs_at(h, at[of], prefix).view(np.int64)), block.column("node").take(pa.array(row[of])), pa.ListArray.from_arrays(pa.array(upto), pa.array(place[held].astype(np.int32))),
                    pa.array([x for _, x, _ in same], pa.binary()), pa.array([x for _, _, x in same], pa.binary()),
                ],
                names=["key", "node", "places", "before", "after"],
            )

    return run


def _word_matrix(rows: pa.Table, column: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row of a column, in order and filled up with zeros, and how many there are."""
    words, many, done = np.zeros((rows.num_rows, most), np.uint64), np.zeros(rows.num_rows, np.int64), 0
    # Piece by piece: hashing words takes several times the size of their text.
    for batch in rows.select([column]).to_batches():
        for block in blocks(iter([batch]), column):
            h, firsts = _words(block.column(0))
            many[done : done + block.num_rows] = np.diff(firsts)
            row = np.repeat(np.arange(block.num_rows), np.diff(firsts))
            words[done + row, np.arange(len(h)) - firsts[:-1][row]] = h
            done += block.num_rows
    return words, many


def _unions(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the unions of each row's intervals; those that touch are one."""
    order = np.lexsort((start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order]
    # Intervals of later rows lie behind those of earlier ones.
    shift = row << 32
    upto = np.maximum.accumulate(shift + end)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (shift + start)[1:] > upto[:-1]]))
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return row[first], start[first], upto[last] - shift[first]


def _placed(rows: pa.Table, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """node, start, end: the unions of intervals that are given from a place on, for all places of their rows."""
    places = rows.column("places")
    length = pc.list_value_length(places).to_numpy().astype(np.int64)
    first, flat = np.cumsum(length) - length, pc.list_flatten(places).to_numpy().astype(np.int64)
    many = length[row]
    place = flat[np.repeat(first[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    row, start, end = _unions(np.repeat(row, many), place + np.repeat(start, many), place + np.repeat(end, many))
    return pa.RecordBatch.from_arrays([pa.array(rows.column("node").to_numpy()[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["node", "start", "end"])


class _Runs:
    """The words around some suffixes, and hashes of all runs of `least` words that cover their prefixes."""

    def __init__(self, rows: pa.Table, least: int, prefix: int):
        self.least, self.left = least, least - prefix
        self.key, n = rows.column("key").to_numpy(), rows.num_rows
        (before, n_before), (after, n_after) = _word_matrix(rows, "before", self.left), _word_matrix(rows, "after", least)
        self.words, self.many = np.concatenate([before[:, ::-1], after], axis=1), [n_before, n_after]
        self.sums = []
        for seed in (0x5EED, 0xFACE):
            x = mix(self.words ^ mix(np.arange(self.words.shape[1], dtype=np.uint64) + np.uint64(seed))[None, :])
            s = np.zeros((n, x.shape[1] + 1), np.uint64)
            np.cumsum(x, axis=1, out=s[:, 1:])
            self.sums.append(s)

    def at(self, back: int) -> np.ndarray:
        """The suffixes that have the run which begins `back` words before them."""
        return np.flatnonzero((self.many[0] >= back) & (self.many[1] >= self.least - back))

    def hashes(self, rows: np.ndarray, back: int, which: int) -> np.ndarray:
        s = self.sums[which]
        whole = s[rows, self.left + self.least - back] - s[rows, self.left - back]
        return mix(whole ^ mix(self.key[rows].view(np.uint64) + np.uint64(back)))

    def repeated(self, nodes: np.ndarray) -> np.ndarray:
        """For each suffix and run, whether a suffix of the same prefix in another text has the same words there."""
        out = np.zeros((len(self.key), self.left + 1), bool)
        for back in range(self.left + 1):
            rows = self.at(back)
            if len(rows) < 2:
                continue
            h = self.hashes(rows, back, 0)
            order = np.argsort(h, kind="stable")
            rows, h = rows[order], h[order]
            same = np.flatnonzero((h[1:] == h[:-1]) & (self.key[rows[1:]] == self.key[rows[:-1]]))
            columns = slice(self.left - back, self.left + self.least - back)
            same = same[(self.words[rows[same + 1], columns] == self.words[rows[same], columns]).all(axis=1)]
            new = np.ones(len(rows), bool)
            new[same + 1] = False
            first = np.flatnonzero(new)
            node = nodes[rows]
            several = np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first)
            out[rows, back] = np.repeat(several, np.diff(np.append(first, len(rows))))
        return out


def _compared(least: int, prefix: int):
    """node, start, end of what is repeated around each suffix of a partition that is sorted by prefix."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        runs = _Runs(rows, least, prefix)
        marked = np.zeros((len(runs.key), runs.left + 3), np.int8)
        marked[:, 1:-1] = runs.repeated(rows.column("node").to_numpy())
        change = np.diff(marked, axis=1)
        row, fewest = np.nonzero(change == 1)
        _, most = np.nonzero(change == -1)
        return _placed(rows, row, 1 - most, least - fewest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                # The last prefix may go on in the next batch.
                last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if last:
                    yield found(table.slice(0, last))
                held, n = table.slice(last).to_batches(), n - last
        if n:
            yield found(pa.Table.from_batches(held))

    return run


def _cut(column: str, most: int):
    """The rows of partitions in order of the key and the column, which keep as much of the column as they have in common
    with one of their neighbours. The first and the last row of a batch keep all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            words, many = _word_matrix(rows, column, most)
            key = rows.column("key").to_numpy()
            common = np.where(key[1:] == key[:-1], np.logical_and.accumulate(words[1:] == words[:-1], axis=1).sum(axis=1), 0)
            kept = np.minimum(many, np.maximum(np.append(most, common), np.append(common, most)))
            cut = [x if n == m else b"".join(w + b" " for w in x.split(b" ")[:n]) for x, n, m in zip(batch.column(column).to_pylist(), kept.tolist(), many.tolist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(cut, pa.binary()))

    return run


_RUN_DDL = "run bigint, more bigint, a bigint, b bigint, classes array<bigint>, backs array<int>"


def _runs(least: int, prefix: int):
    """The runs of classes of contexts by two hashes: a row for each different one of a batch, with all classes that have it,
    how far before their places it begins, and the smallest and largest of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = _Runs(pa.Table.from_batches([batch]), least, prefix)
            class_, a, b = (batch.column(c).to_numpy() for c in ("class", "a", "b"))
            for back in range(runs.left + 1):
                rows = runs.at(back)
                if not len(rows):
                    continue
                one, two = (runs.hashes(rows, back, k).view(np.int64) for k in (0, 1))
                order = np.lexsort((two, one))
                one, two, rows = one[order], two[order], rows[order]
                first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
                ends = pa.array(np.append(first, len(rows)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one[first]), pa.array(two[first]), pa.array(np.minimum.reduceat(a[rows], first)), pa.array(np.maximum.reduceat(b[rows], first)),
                        pa.ListArray.from_arrays(ends, pa.array(class_[rows])), pa.ListArray.from_arrays(ends, pa.array(np.full(len(rows), back, np.int32))),
                    ],
                    names=["run", "more", "a", "b", "classes", "backs"],
                )

    return run


def _spread(least: int):
    """node, start, end of what is repeated around the places of rows, which have the beginnings of their repeated runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                backs = pc.list_flatten(rows.column("backs")).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("backs")).to_numpy())
                yield _placed(rows, *_unions(row, -backs, least - backs))

    return run


def _counted(hot: DataFrame, least: int, prefix: int) -> DataFrame:
    """node, start, end of what is repeated around the places of contexts of prefixes that very many rows have."""
    for column, other, most in (("after", "before", least), ("before", "after", least - prefix)):
        in_order = hot.repartitionByRange("key", column, other).sortWithinPartitions("key", column, other)
        hot = materialise(in_order.mapInArrow(_cut(column, most), _CONTEXT_DDL), "suffix-cut")
    context = ["key", "before", "after"]
    classes = hot.groupBy(*context).agg(F.min("node").alias("a"), F.max("node").alias("b"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "suffix-classes")
    runs = materialise(classes.mapInArrow(_runs(least, prefix), _RUN_DDL), "suffix-runs")
    common = runs.groupBy("run", "more").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("run", "more")
    each = runs.join(common, ["run", "more"]).select(F.explode(F.arrays_zip("classes", "backs")).alias("x"))
    found = each.groupBy(F.col("x.classes").alias("class")).agg(F.collect_set("x.backs").alias("backs"))
    # Written first: both sides of the join are then dealt out for it, and a class of very many rows can be split.
    found = materialise(classes.join(found, "class").select(*context, "backs"), "suffix-shared")
    return hot.join(found, context).select("node", "places", "backs").mapInArrow(_spread(least), "node bigint, start int, end int")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, spans: the union of each node's intervals, in order; those that touch are one."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            x = batch.column("x")[i].values
            start, end = x.field("start").to_numpy(), x.field("end").to_numpy()
            order = np.argsort(start, kind="stable")
            start, upto = start[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate([[True], start[1:] > upto[:-1]]))
            last = np.append(new[1:] - 1, len(start) - 1)
            out.append([{"start": int(a), "end": int(b)} for a, b in zip(start[new], upto[last], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, kind)], names=["node", "spans"])


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_repeated, spans (merged, start and end in words): the rows of docs that have passages of at
    least `least` words, lower-cased, which another row has too. Rows without one are not returned.

    A text of fewer words, a null or empty one has no such passage; a passage repeated only inside one row does not
    count; rows of the same words, repeated rows included, repeat each other whole. Ids are of any type and may repeat
    or be null; texts of any length are compared whole. No rows give no rows; other columns are not looked at.
    """
    # A row is found again by a hash of its text and id: ids alone may be null or the same for very many rows.
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column, id_column).alias("row_hash"))
    found = materialise(rows.mapInArrow(_suffixes(least, prefix), _SUFFIX_DDL.format(rows.schema["doc_id"].dataType.simpleString())).where(F.col("n_words") >= least), "suffixes")
    # Rows of the same words are one node, and any of them stands for it.
    nodes = found.groupBy("d1", "d2").agg(F.min("row_hash").alias("rep"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "suffix-nodes")
    standing = found.join(nodes, ["d1", "d2"]).where(F.col("row_hash") == F.col("rep")).dropDuplicates(["node"])
    suffixes = materialise(standing.select("node", F.explode(F.arrays_zip("keys", "places")).alias("s")).select("node", F.col("s.keys").alias("key"), F.col("s.places").alias("place")), "suffix-array")
    shared = materialise(suffixes.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key"), "suffix-keys")
    likely = may_contain(suffixes, "key", bitmap_filter(shared, "key", "suffix-filter"))
    candidates = likely.join(shared, "key").groupBy("node").agg(F.collect_list("place").alias("found"))
    candidates = materialise(candidates.join(nodes.select("node", "d1", "d2", "rep"), "node"), "suffix-candidates")

    by_rep = candidates.withColumnRenamed("rep", "row_hash")
    wanted = may_contain(rows, "row_hash", bitmap_filter(by_rep, "row_hash", "suffix-filter"))
    # Rows that are equal all have the text: one of them goes on.
    texts = wanted.groupBy("row_hash").agg(F.first("text").alias("text")).join(by_rep, "row_hash")
    contexts = materialise(texts.select("node", "d1", "d2", "found", "text").mapInArrow(_contexts(least, prefix), _CONTEXT_DDL), "suffix-contexts")
    hot = materialise(contexts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SUFFIXES).select("key"), "suffix-hot")
    some = not hot.isEmpty()
    few = contexts.join(hot, "key", "left_anti") if some else contexts
    equal = few.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(least, prefix), "node bigint, start int, end int")
    if some:
        equal = equal.unionByName(_counted(contexts.join(hot, "key", "left_semi"), least, prefix))
    spans = equal.groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("x")).mapInArrow(_merged, "node bigint, spans array<struct<start:int,end:int>>")

    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    per_node = nodes.join(spans, "node", "left").where(F.col("spans").isNotNull() | (F.col("copies") > 1)).select("d1", "d2", "copies", "spans")
    out = found.select("doc_id", "d1", "d2", "n_words").join(per_node, ["d1", "d2"]).withColumn("spans", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")))
    return out.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])).alias("n_repeated"), "spans")
