"""WordPiece encoding with a vocabulary that is read on the driver and broadcast (its line order gives the ids)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sedgewren.functions.binary import pieces

#: Id of an unknown token where the vocabulary has no [UNK].
UNKNOWN = 100
MOST_IDS = 512
#: A three-byte character of lead byte E4-E9 alone; a run of ASCII letters and digits and bytes of other characters;
#: an ASCII mark alone. Bytes up to 0x20 separate.
_BASIC = re.compile(rb"(?P<cjk>[\xe4-\xe9][\x00-\xff]{2})|(?P<mark>[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])|(?P<run>[0-9A-Za-z\x80-\xff])|(?P<gap>[\x00-\x20])", re.S)


def basic_tokens(text: bytes) -> list[bytes]:
    out, run = [], b""
    for m in _BASIC.finditer(text):
        if m["run"] is not None:
            run += m["run"]
            continue
        if run:
            out.append(run)
            run = b""
        if m["gap"] is None:
            out.append(m[0])
    return [*out, run] if run else out


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token to id, the line number; a trailing carriage return is no part of a token, and a later line of the same token wins."""
    with open(path, "rb") as f:
        return {line.rstrip(b"\n").rstrip(b"\r"): i for i, line in enumerate(f)}


def word_pieces(token: bytes, vocabulary: dict[bytes, int]) -> list[int]:
    """Longest pieces from the left, continuations marked ##; a token that cannot be put together is unknown as a whole."""
    if token in vocabulary:
        return [vocabulary[token]]
    ids: list[int] = []
    rest, mark = token, b""
    while rest:
        size = next((n for n in range(len(rest), 0, -1) if mark + rest[:n] in vocabulary), 0)
        if not size:
            return [vocabulary.get(b"[UNK]", UNKNOWN)]
        ids.append(vocabulary[mark + rest[:size]])
        rest, mark = rest[size:], b"##"
    return ids


def encode(text: str, vocabulary: dict[bytes, int], most: int = MOST_IDS) -> list[int]:
    """[CLS], the pieces of the text with A-Z in lower case, [SEP]; cut to `most` ids."""
    lowered = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in text.encode())
    ids = [vocabulary.get(b"[CLS]", 101)]
    for token in basic_tokens(lowered):
        ids += word_pieces(token, vocabulary)
        if len(ids) >= most:
            break
    return [*ids[: most - 1], vocabulary.get(b"[SEP]", 102)]


def encoder(spark: SparkSession, vocabulary: dict[bytes, int], most: int = MOST_IDS):
    """A column function from text to ids; null stays null."""
    sent = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in pieces(texts):
            yield pa.array([None if t is None else encode(t, sent.value, most) for t in some.to_pylist()], pa.list_(pa.int32()))

    def column(text: Column) -> Column:
        return run(text)

    return column
