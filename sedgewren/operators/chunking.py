"""Splits texts at sentence ends into overlapping chunks, in one pass over each text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions.binary import pieces
from sedgewren.functions.text import SPACE, TERMINATORS

#: Chunk ids are the document's id times 2^PLACE_BITS plus the chunk's place in the document.
PLACE_BITS = 20
PLACES = 1 << PLACE_BITS


def document_of(chunk_id: Column) -> Column:
    return F.shiftright(chunk_id, PLACE_BITS)


#: What trimming removes, as characters; the class is written for Java and RE2.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{re.sub(r'x{([0-9A-F]+)}', lambda m: f'u{m[1]}', SPACE)}]", c))
_ENDS = re.compile(TERMINATORS)


def chunks_of_text(text: str, config: RetrievalConfig = DEFAULT) -> Iterator[str]:
    """See split_chunks. A chunk is joined when it is full, so the work follows the length of the text."""
    now, length = [], 0
    for piece in _ENDS.split(text):
        if not (piece := piece.strip(_SPACE)):
            continue
        if length and length + len(piece) > config.chunk_size:
            full = "".join(now)
            yield full.strip(_SPACE)
            kept = full[len(full) - min(config.chunk_overlap, len(full)) :]
            now, length = [kept], len(kept)
        now.append(piece)
        length += len(piece)
    yield "".join(now).strip(_SPACE)


def split_chunks(text: Column, config: RetrievalConfig = DEFAULT) -> Column:
    """array<string>: pieces between terminators are put together without a separator until the next would exceed the
    chunk size; the next chunk then starts with the last characters of the one before. A longer piece stays whole; a null
    text has no chunks."""

    @F.arrow_udf("array<string>")
    def split(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in pieces(texts):
            yield pa.array([None if t is None else [c for c in chunks_of_text(t, config) if c] for t in some.to_pylist()], pa.list_(pa.string()))

    return split(text)


def chunk_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", config: RetrievalConfig = DEFAULT, more: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, doc_id, pos, source, more columns of docs, text. Texts without a chunk give no row; a text of more than
    PLACES chunks is an error, as its ids would run into the next document's."""
    chunks = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), *more, F.posexplode(split_chunks(F.col(text_column), config)).alias("pos", "text"))
    place = F.when(F.col("pos") < PLACES, F.col("pos")).otherwise(F.raise_error(F.lit("a document has too many chunks for their ids")).cast("int"))
    return chunks.select((F.col("doc_id") * PLACES + place).alias("chunk_id"), "doc_id", F.col("pos").cast("long").alias("pos"), "source", *more, "text")
