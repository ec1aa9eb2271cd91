"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document: a segment holds a few megabytes of documents, its terms, and for each term the sorted
positions of its occurrences. Segments are written to the shared folder. A search takes a block of the benchmark to
every segment and intersects the position lists of a window's terms, each shifted by the term's offset, from the
rarest term on. Terms are compared by their bytes, so a match is exact. No list ever spans segments, so no term,
however frequent, gathers anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import LOWER, WORD_BYTE, blocks, column_bytes, materialise, word_spans

#: Text bytes of a segment (one document, if longer), and of the benchmark that one pass over the index searches for:
#: its windows are some ten times as large when they are sent. Places that a search tries at once.
SEGMENT_BYTES, BLOCK_BYTES, PLACES = 8 << 20, 4 << 20, 1 << 20
#: A page and a row group for each segment, so that a task that writes or reads segments holds one, however many it has.
#: Parquet looks at their size after a hundred rows otherwise, which is a gigabyte of segments.
_ONE_SEGMENT = {"parquet.block.row.count.limit": "1", "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
_SEGMENT_DDL = "segment string, doc_ids array<{}>, doc_starts binary, term_ends binary, term_bytes binary, list_ends binary, positions binary"
_FOUND_DDL = "segment string, ordinal int, doc_id {}, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of the rows as one binary array, and the index of each row's first word, with the end."""
    buf, at = column_bytes(column)
    buf = LOWER[buf]
    starts, ends, firsts = word_spans(buf, at, WORD_BYTE)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    data = buf[WORD_BYTE[buf]] if len(buf) else buf
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]), firsts


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", SEGMENT_BYTES):
        words, firsts = words_of(block.column("text"))
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        terms = coded.dictionary
        _, term_offsets, term_data = terms.buffers()
        n = len(terms)
        ends = np.frombuffer(term_offsets, np.int32, n + 1)[1:] if n else np.empty(0, np.int32)
        positions = np.argsort(codes, kind="stable").astype(np.int32)
        list_ends = np.cumsum(np.bincount(codes, minlength=n)).astype(np.int32)
        parts = [
            firsts.astype(np.int32).tobytes(), ends.tobytes(), term_data.to_pybytes()[: ends[-1]] if n else b"",
            list_ends.tobytes(), np.diff(positions, prepend=np.int32(0)).tobytes(),
        ]
        ids = block.column("doc_id")
        names = ["segment", "doc_ids", "doc_starts", "term_ends", "term_bytes", "list_ends", "positions"]
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([v], pa.binary()) for v in parts)], names=names)


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The written index: one row per segment."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    ddl = _SEGMENT_DDL.format(rows.schema["doc_id"].dataType.simpleString())
    return materialise(rows.mapInArrow(_segments, ddl), "postings", **_ONE_SEGMENT)


@dataclass
class Windows:
    """Windows of one length, each once: words by number as rows of a matrix, and the items that each one comes from."""

    words: np.ndarray
    owner_starts: np.ndarray
    owners: np.ndarray


@dataclass
class Queries:
    """Windows of a block of items."""

    words: pa.Array
    windows: list[Windows]
    items: list[str]


def queries_of(items: pa.Table, width: int) -> Queries:
    """Each `width` consecutive words of an item are a window; an item of fewer, but not none, is one window."""
    text = items.column("text").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else (pa.array([], pa.string()) if isinstance(text, pa.ChunkedArray) else text)
    words, firsts = words_of(text)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    n = np.diff(firsts)
    found = []
    for length in np.unique(np.minimum(n[n > 0], width)):
        of = np.flatnonzero(n == length if length < width else n >= width)
        many = n[of] - length + 1
        owner = np.repeat(of, many)
        start = firsts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        rows, window = np.unique(codes[start[:, None] + np.arange(length)], axis=0, return_inverse=True)
        both = np.unique(window.ravel() * len(n) + owner)
        window, owner = both // len(n), both % len(n)
        found.append(Windows(rows, np.searchsorted(window, np.arange(len(rows) + 1)), owner.astype(np.int32)))
    ids = ["" if x is None else str(x) for x in items.column("item_id").to_pylist()]
    return Queries(coded.dictionary, found, ids)


@dataclass
class Matches:
    """Of each match the document, the first word, the word after the last, and the item; words are counted in the
    segment. A match of a window that several items have is there for each."""

    doc: np.ndarray
    first: np.ndarray
    after: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, parts: list[Matches]) -> Matches:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) if parts else np.empty(0, np.int64) for c in ("doc", "first", "after", "item")))


@dataclass
class Segment:
    doc_ids: list
    doc_starts: np.ndarray
    terms: pa.Array
    list_ends: np.ndarray
    positions: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Segment:
        ends = np.frombuffer(row["term_ends"], np.int32)
        offsets = np.concatenate([np.zeros(1, np.int32), ends])
        terms = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(row["term_bytes"])])
        positions = np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int32)
        return cls(row["doc_ids"], np.frombuffer(row["doc_starts"], np.int32).astype(np.int64), terms, np.frombuffer(row["list_ends"], np.int32).astype(np.int64), positions)

    def search(self, q: Queries, slop: int = 0) -> Matches:
        """All matches, at most PLACES (or those of one window) tried at once.

        With slop 0 a match has all words of a window at their places; else each may be off by slop words from where
        the rarest word of the window puts it.
        """
        n = len(self.positions)
        if not n or not len(q.words):
            return Matches.of([])
        term_of = pc.index_in(q.words, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(self.list_ends, prepend=0)
        # Every term's positions in one sorted array, the terms far apart; only if a window needs it.
        stride = n + 2 * slop + 1
        keys, parts = None, []
        for group in q.windows:
            terms = term_of[group.words]
            alive = np.flatnonzero((terms >= 0).all(axis=1))
            if not len(alive):
                continue
            terms = terms[alive]
            order = np.argsort(lengths[terms], axis=1, kind="stable")
            many = lengths[np.take_along_axis(terms, order[:, :1], 1)[:, 0]]
            if keys is None and terms.shape[1] > 1:
                keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), lengths) * stride + slop + self.positions
            upto = np.cumsum(many)
            first = 0
            while first < len(alive):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PLACES, "right")))
                here = slice(first, last)
                parts.append(self._matches(group, alive[here], terms[here], order[here], many[here], keys, stride, slop))
                first = last
        return Matches.of(parts)

    def _matches(self, group: Windows, alive: np.ndarray, terms: np.ndarray, order: np.ndarray, many: np.ndarray, keys: np.ndarray | None, stride: int, slop: int) -> Matches:
        n = len(self.positions)
        rarest = terms[np.arange(len(terms)), order[:, 0]]
        window = np.repeat(np.arange(len(alive)), many)
        within = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
        low = self.positions[self.list_ends[rarest[window]] - many[window] + within].astype(np.int64)
        start, high = low - order[window, 0], low.copy()
        for k in range(1, terms.shape[1]):
            if not len(window):
                break
            place = order[window, k]
            expected = start + place
            wanted = terms[window, place] * stride + slop
            found = np.searchsorted(keys, wanted + np.maximum(expected - slop, -slop))
            got = keys[np.minimum(found, n - 1)] - wanted
            fits = (found < n) & (got <= expected + slop) & (got >= expected - slop) & (got >= 0) & (got < n)
            window, start, got = window[fits], start[fits], got[fits]
            low, high = np.minimum(low[fits], got), np.maximum(high[fits], got)
        doc = np.searchsorted(self.doc_starts, low, "right") - 1
        inside = high < self.doc_starts[doc + 1] if len(doc) else np.empty(0, bool)
        doc, low, high, window = doc[inside], low[inside], high[inside], alive[window[inside]]
        each = group.owner_starts[window + 1] - group.owner_starts[window]
        at = np.repeat(group.owner_starts[window] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        return Matches(np.repeat(doc, each), np.repeat(low, each), np.repeat(high + 1, each), group.owners[at].astype(np.int64))

    def spans(self, m: Matches) -> pa.Array:
        """Per document its matches, merged, as words of the document."""
        order = np.argsort(m.first, kind="stable")
        doc, first, upto = m.doc[order], m.first[order], np.maximum.accumulate(m.after[order]) if len(order) else m.after
        new = np.flatnonzero(np.concatenate([[True], (first[1:] > upto[:-1]) | (doc[1:] != doc[:-1])])) if len(order) else np.empty(0, np.int64)
        last = np.append(new[1:] - 1, len(order) - 1) if len(new) else new
        base = self.doc_starts[doc[new]]
        values = pa.StructArray.from_arrays([pa.array((first[new] - base).astype(np.int32)), pa.array((upto[last] - base).astype(np.int32))], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(len(self.doc_starts))).astype(np.int32)), values)

    def items(self, m: Matches, ids: list[str]) -> pa.Array:
        """Per document the different ids of the items that match in it, sorted as strings."""
        names, number = np.unique(np.array(ids, object), return_inverse=True) if ids else (np.empty(0, object), np.empty(0, np.int64))
        both = np.unique(m.doc * max(1, len(names)) + number[m.item]) if len(m.doc) else np.empty(0, np.int64)
        doc, name = both // max(1, len(names)), both % max(1, len(names))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(self.doc_starts))).astype(np.int32)), pa.array(names[name].tolist(), pa.string()))


def search_index(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """doc_id, n_words, spans (merged, of word numbers in the document) and items (sorted ids as strings) for each
    document of the index. items: item_id, text; taken block by block, so that a benchmark of any size is searched.
    """
    spark = index.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    parts = []
    for k in range(n_blocks):
        # A block is BLOCK_BYTES or so by its share of the measured size.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).select("item_id", "text").toArrow()
        sent = spark.sparkContext.broadcast(queries_of(part, width))

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = ["segment", "ordinal", "doc_id", "n_words", "spans", "items"]
            q = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    s = Segment.read(row)
                    n = len(s.doc_ids)
                    m = s.search(q, slop)
                    ids = batch.column("doc_ids").slice(i, 1).flatten()
                    yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * n), pa.array(range(n), pa.int32()), ids, pa.array(np.diff(s.doc_starts)), s.spans(m), s.items(m, q.items)], names=names)

        parts.append(index.mapInArrow(found, _FOUND_DDL.format(index.schema["doc_ids"].dataType.elementType.simpleString())))
    if n_blocks == 1:
        return parts[0].select("doc_id", "n_words", "spans", "items")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    together = rows.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def joined(spans, x):
        last = F.element_at(spans, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (F.size(spans) > 0) & (x["start"] <= F.try_element_at(spans, F.lit(-1))["end"])
        return F.when(touches, F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(longer))).otherwise(F.concat(spans, F.array(x)))

    merged = F.aggregate("all", F.expr("cast(array() as array<struct<start:int,end:int>>)"), joined)
    return together.select("doc_id", "n_words", merged.alias("spans"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans, contaminated: one row per row of docs, repeated ones included.

    Null and empty texts have no words and are clean; null and empty items have no window; a null item id is written
    as an empty string; several items of one id count once. An empty benchmark hits nothing. A text of any length is
    searched whole; one longer than SEGMENT_BYTES is a segment by itself. No rows give no rows, and other columns are
    not looked at.
    """
    found = search_index(build_index(docs, id_column, text_column), benchmark.select("item_id", "text"), width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))
