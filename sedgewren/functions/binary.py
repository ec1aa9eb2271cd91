"""Functions over bytes that Spark's expressions cannot state: Arrow-batched UDFs over whole columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of text in old word-processor files: printable ASCII, Latin-1 supplement, general and CJK punctuation,
# CJK ideographs without Extension A, full-width forms.
DOC_TEXT = "\x20-\x7e\xa0-\xff\u2000-\u206f\u3000-\u303f\u4e00-\u9fff\uff00-\uffef"
_DOC_RUN = re.compile(f"[{DOC_TEXT}]{{3,}}")


#: Bytes and rows of a batch that a function makes Python values of at once.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 256


def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows of all batches in order, a few at a time: Spark's batches are of so many rows, whatever these hold."""
    for batch in batches:
        most = PIECE_ROWS if not len(batch) else max(1, min(PIECE_ROWS, PIECE_BYTES * len(batch) // max(1, batch.nbytes)))
        for first in range(0, len(batch), most):
            yield batch.slice(first, most)


def utf16_runs_of(data: bytes | None) -> str | None:
    """Runs of three or more text characters of 2-byte little-endian units, each followed by a newline. An odd last byte
    is left out. Surrogates are no text characters, so each unit decodes by itself."""
    if data is None:
        return None
    return "".join(f"{m[0]}\n" for m in _DOC_RUN.finditer(data[: len(data) & ~1].decode("utf-16-le", "surrogatepass")))


def utf8_complete_length(data: bytes | None) -> int | None:
    """Length of the longest prefix that cuts no character: it stops before an illegal first byte or a character that
    lacks bytes. Continuation bytes are not looked at."""
    if data is None:
        return None
    i = 0
    while i < len(data):
        c = data[i]
        need = 1 if c < 0x80 else 2 if c >> 5 == 0b110 else 3 if c >> 4 == 0b1110 else 4 if c >> 3 == 0b11110 else 0
        if not need or i + need > len(data):
            break
        i += need
    return i


@F.pandas_udf(T.StringType())
def utf16_runs(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in data:
        yield s.map(utf16_runs_of)


@F.pandas_udf(T.LongType())
def utf8_complete_len(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in data:
        yield s.map(utf8_complete_length)
