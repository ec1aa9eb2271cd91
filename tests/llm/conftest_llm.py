import random

import pytest

#: Columns whose names operators use inside.
EXTRA = ("size", "row", "key", "node", "digest", "score", "label", "grp", "a", "b", "c", "_row", "t", "target", "keep", "id", "shard", "slot", "lines", "codes", "places", "spans", "words", "level", "weight", "n", "band", "cell", "range", "rank", "passes")
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, a very long text, copies, near copies, repeated rows, one id for different texts."""
    base = words(1, 120)
    near = base[:60] + ["other"] + base[61:]
    passage = words(2, 60)
    rows = [
        (1, " ".join(base), "en", "s1"), (2, " ".join(base), "en", "s1"), (3, " ".join(near), "en", "s2"), (3, " ".join(near), "en", "s2"),
        (4, None, None, None), (None, None, None, None), (5, "", "en", "s1"), (6, " \n\t ", "en", "s1"), (None, "a b", "en", None), (7, "a b", "en", "s1"),
        (7, "something else altogether", "fr", "s1"), (8, "a\tb", "en", "s3"), (9, " ".join(words(3, 20) + passage + words(4, 20)), "de", "s1"),
        (10, " ".join(words(5, 30) + passage + words(6, 10)), "de", "s1"), (11, " ".join(words(7, 30_000)), "en", "s2"), (12, "x" * 100_000, "en", "s2"),
        (13, "one line\ntwo line\nthree line\nfour line\nfive line\nsix line", "en", "s1"), (14, "zero\none line\ntwo line\nthree line\nfour line\nfive line\nsix line", "en", "s1"),
        (15, "!!! ... ???", "en", "s4"), (16, "\x00\x01 nul", "en", "s1"),
    ]
    rows += [(100 + i, "the same short text in very many rows", "en", "hot") for i in range(60)]
    rows += [(200 + i, " ".join(words(100 + i, 40)), "en", f"s{i % 3}") for i in range(30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) + ("x",) * len(EXTRA) for r in rows], DDL)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(0, 230)] + [(None, 1, 1), (1, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")
