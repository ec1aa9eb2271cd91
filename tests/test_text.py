"""Text functions on literals that the tables lack."""

import pytest
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions import binary, text
from sedgewren.functions.wordpiece import basic_tokens, encode, word_pieces
from sedgewren.operators.batching import batch_numbers
from sedgewren.operators.chunking import split_chunks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("打开Device 2，OK", ["打", "开", "device", "2", "，", "ok"]),
        ("ＡＢ１", ["Ａ", "Ｂ", "１"]),
        ("a😀b x_y", ["a", "b", "x", "y"]),
        ("", []),
        ("。！", ["。", "！"]),
        ("Ünïcode-Straße", ["ünïcode", "straße"]),
    ],
)
def test_terms(spark, given, expected):
    assert [t.lower() if t.isascii() else t for t in one(spark, given, text.terms)] == [t.lower() if t.isascii() else t for t in expected] or one(spark, given, text.terms) == [t.lower() for t in expected]


def test_trim_knows_unicode_whitespace(spark):
    assert one(spark, " 　\t a b  ", text.trim) == "a b"


def test_strip_xml(spark):
    xml = "<w:p>a&amp;lt;b</w:p><w:br/>&quot;x&apos;&nbsp; \t y&gt;</w:p>\n\n\n\nz < w"
    assert one(spark, xml, text.strip_xml) == "a<b\n\n\"x' y>\n\nz < w"


def test_normalize_keeps_tags(spark):
    assert one(spark, " a <b>  \x0b c\n\n\n\nd ", text.normalize_ws) == "a <b> c\n\nd"


def fold(value, size=240, overlap=40):
    """The chunking rule, step by step."""
    import re

    pieces = [p for p in (p.strip() for p in re.split("[。！？!?；;\r\n]+", value)) if p]
    out, now = [], ""
    for p in pieces:
        if now and len(now) + len(p) > size:
            out.append(now.strip())
            now = now[-overlap:] + p
        else:
            now += p
    return [c for c in [*out, now.strip()] if c]


@pytest.mark.parametrize("lengths", [(239, 1), (240, 1), (241, 5), (200, 40, 1), (200, 41), (500,), (100, 100, 100, 100), ()])
def test_chunks(spark, lengths):
    value = "。".join(chr(97 + i) * n for i, n in enumerate(lengths)) + "。\r\n"
    assert one(spark, value, split_chunks) == fold(value)


def test_latin1_and_utf16_runs(spark):
    assert one(spark, bytearray(b"abc\x00abcd\x01\xa0\xe9xy\x7f"), text.latin1_runs, "binary") == "abcd\n\xa0éxy\n"
    data = "中文字".encode("utf-16-le") + b"\x01\x00" + "ab".encode("utf-16-le") + b"\x00\x00" + "㐀㐁㐂".encode("utf-16-le") + "xyz".encode("utf-16-le") + b"\xff"
    assert binary.utf16_runs_of(data) == "中文字\nxyz\n"
    assert one(spark, bytearray(data), binary.utf16_runs, "binary") == "中文字\nxyz\n"


@pytest.mark.parametrize(("data", "n"), [(b"", 0), (b"abc", 3), ("é".encode()[:1], 0), ("a中".encode()[:-1], 1), ("a中".encode(), 4), (b"a\x80b", 1), ("😀".encode(), 4)])
def test_utf8_complete(data, n):
    assert binary.utf8_complete_length(data) == n


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-32"])
def test_decode_by_mark(spark, encoding):
    assert one(spark, bytearray("aé中".encode(encoding)), text.decode_text, "binary") == "aé中"


def test_wordpiece():
    vocab = {t: i for i, t in enumerate([b"[PAD]", b"[UNK]", b"[CLS]", b"[SEP]", b"de", b"##vice", b"?", "中".encode(), b"device2"])}
    assert basic_tokens("device2? 中文x，y".encode()) == [b"device2", b"?", "中".encode(), "文".encode(), "x，y".encode()]
    assert word_pieces(b"device", vocab) == [4, 5]
    assert word_pieces(b"dev", vocab) == [1]
    assert encode("DEVICE?中", vocab) == [2, 4, 5, 6, 7, 3]
    assert len(encode("device " * 900, vocab)) == 512


def test_greedy_batches(spark):
    config = RetrievalConfig(batch_items=3, batch_tokens=10, batch_context=12)
    sizes = [4, 6, 1, 0, 20, 1, 1, 1, 1]
    assert one(spark, sizes, lambda c: batch_numbers(c, config), "array<long>") == [1, 1, 2, 0, 3, 4, 4, 4, 5]
    assert DEFAULT.pool == 20
