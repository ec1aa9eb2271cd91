"""Decontamination, Jaccard join, repeated passages and language-model scoring: brute force on odd rows."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import frame, words
from pyspark.sql import functions as F

from sedgewren.llm import common, kneser_ney, near, postings, suffixes
from sedgewren.llm.components import connected_components
from sedgewren.llm.near import bands_for, jaccard_links
from sedgewren.llm.postings import decontaminate, search_index
from sedgewren.llm.suffixes import repeated_passages


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def benchmark(spark):
    passage = words(2, 60)
    rows = [(1, " ".join(passage[5:40]).upper().replace("É", "é")), (2, "the same, short TEXT"), (3, ""), (4, None), (None, " ".join(words(7, 30_000)[29_980:])), (5, " ".join(passage[:12])), (5, "two line"), (6, "never seen words here"), (10, "line")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")


def brute_contamination(docs, items, width=10):
    windows = defaultdict(set)
    for r in items:
        w = tokens(r.text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add("" if r.item_id is None else str(r.item_id))
    lengths = {len(w) for w in windows}
    out = Counter()
    for r in docs:
        w, hit, own = tokens(r.text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if who := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    own |= who
        out[r.doc_id, len(w), len(hit), ",".join(sorted(own)), bool(hit)] += 1
    return out


@pytest.mark.parametrize(("segment", "block", "places"), [(8 << 20, 16 << 20, 1 << 20), (1000, 200, 3), (8 << 20, 1 << 20, 1)])
def test_decontamination(odd, benchmark, monkeypatch, segment, block, places):
    monkeypatch.setattr(postings, "PLACES", places)
    monkeypatch.setattr(postings, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(postings, "BLOCK_BYTES", block)
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontaminate(odd, benchmark).collect())
    assert got == brute_contamination(odd.collect(), benchmark.collect())
    assert sum(n for k, n in got.items() if k[4]) > 60


def test_nothing_contaminated(odd, nothing, benchmark):
    assert decontaminate(nothing, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate(odd, benchmark.limit(0)).collect())


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity(spark, slop):
    docs = [(1, "p q r s t"), (2, "p x q r s"), (3, "q p r s"), (4, "p q x x x x r"), (5, "r q p"), (6, "p p q q r r")]
    items = [(1, "p q r"), (2, "r s"), (3, "t")]
    index = postings.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: set(r["items"]) for r in search_index(index, spark.createDataFrame(items, "item_id long, text string"), slop=slop).collect()}
    expected = {}
    for d, text in docs:
        w = text.split()
        own = set()
        for i, item in items:
            q = item.split()
            counts = [(w.count(x), k) for k, x in enumerate(q)]
            rare = min(counts)[1]
            for p in [j for j, x in enumerate(w) if x == q[rare]]:
                if all(any(abs(j - (p - rare + k)) <= slop for j, y in enumerate(w) if y == x) for k, x in enumerate(q) if k != rare):
                    own.add(str(i))
        expected[d] = own
    assert got == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (300, 200), (200, 300), (200, 250)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(100, 161), 100) | dict.fromkeys(range(1, 40), 1) | dict.fromkeys((200, 250, 300), 200)
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_links(rows, width=5, threshold=0.8):
    sets = []
    for r in rows:
        w = tokens(r.text)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            root[top(i)] = top(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[top(i)].append(r.doc_id)
    return Counter((r.doc_id, min((x for x in ids[top(i)] if x is not None), default=None), links[i]) for i, r in enumerate(rows))


def family(seed, n, length, changes):
    base = words(seed, length)
    import random

    r = random.Random(seed)
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(length)] = f"z{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [1_500_000, 60_000])
def test_jaccard(spark, odd, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_SHINGLES", block)
    more = [(3000 + i, t, "en", "s") for i, t in enumerate([*family(50, 60, 200, 6), *family(51, 10, 30, 2)])]
    docs = odd.unionByName(frame(spark, more))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_links(docs).collect())
    assert got == brute_links(docs.collect())


def counted_sets(monkeypatch, spark):
    """Counts the rows whose shingle sets are made, in a file of each task."""
    total = spark.sparkContext.accumulator(0)
    make = near._sets

    def counting(width):
        run = make(width)

        def counted(batches):
            for b in run(batches):
                total.add(b.num_rows)
                yield b

        return counted

    monkeypatch.setattr(near, "_sets", counting)
    return total


def test_near_copies_without_ids_are_read_once(spark, monkeypatch):
    base = words(60, 100)
    texts = [" ".join([*base[:50], f"n{i}", *base[51:]]) for i in range(2000)]
    docs = spark.createDataFrame([(None, t) for t in texts + texts[:500]], "doc_id long, text string")
    total = counted_sets(monkeypatch, spark)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_links(docs).collect())
    assert got == {(None, None, 2499): 2500}
    assert total.value <= 2500


def test_text_ids(spark):
    docs = spark.createDataFrame([("x", "a b c d e f g"), ("b", "a b c d e f g"), ("é", "other words")], "doc_id string, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard_links(docs).collect()} == {("x", "b", 1), ("b", "b", 1), ("é", "é", 0)}


def test_a_chain_of_unlike_texts_is_cut(spark, monkeypatch):
    """Neighbours share half of their shingles: bands tie many of them into large cells, and none is linked."""
    long, at_once = words(61, 40_000), []
    texts = [" ".join(long[20 * i : 20 * i + 60]) for i in range(1900)]
    texts += [" ".join(texts[7].split()[:59] + ["z"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 40_000)
    cut = near._cut
    monkeypatch.setattr(near, "_cut", lambda *a: at_once.append(cut(*a)) or at_once[-1])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_links(docs).collect()}
    assert got == {i: (i, 0) for i in range(1900)} | {7: (7, 1), 1900: (7, 1)}
    # What is left of the cells is next to nothing.
    assert at_once[0].count() < 300


def test_no_links(nothing, spark):
    assert jaccard_links(nothing).collect() == [] and repeated_passages(nothing).collect() == []
    alone = spark.createDataFrame([(1, None), (2, ""), (3, "x y")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard_links(alone).collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0)}


def test_word_hashes_do_not_depend_on_what_is_around(monkeypatch):
    r = np.random.default_rng(7)
    text = "".join(chr(97 + x) for x in r.integers(0, 26, 5000))
    words_ = [text[:1], text[:63], text[:64], text[:65], text[1:900], text[5:70], text]
    buf = np.frombuffer(" ".join(words_).encode(), np.uint8)
    starts, ends, _ = common.word_spans(buf, np.array([0, len(buf)]), common.WORD_BYTE)
    whole = common.word_hashes(buf, starts, ends)
    assert len(set(whole.tolist())) == len(words_)
    monkeypatch.setattr(common, "_PIECE", 64)
    assert (common.word_hashes(buf, starts, ends) == whole).all()
    for w, h in zip(words_, whole, strict=True):
        b = np.frombuffer(w.encode(), np.uint8)
        assert common.word_hashes(b, np.array([0]), np.array([len(b)]))[0] == h


def test_very_long_texts(spark):
    """A word of 3 MB, and a text of 6 MB that two rows share but for a word."""
    long = words(80, 1_200_000)
    docs = [(1, "y" * 3_000_000), (2, " ".join(long)), (3, " ".join([*long[:-3], "z", *long[-2:]])), (4, " ".join(words(81, 60))), (5, "y" * 3_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard_links(df).collect()} == {(1, 1, 1), (5, 1, 1), (2, 2, 1), (3, 2, 1), (4, 4, 0)}
    n = len(long)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in repeated_passages(df).collect()}
    assert spans == {2: [(0, n - 3)], 3: [(0, n - 3)]}
    model = kneser_ney.train(df.select("text"))
    assert model.tokens == sum(len(t.split()) + 1 for _, t in docs)
    assert {r.doc_id: r.n_known for r in kneser_ney.score(df, model).collect()} == {i: len(t.split()) + 1 for i, t in docs}
    item = spark.createDataFrame([(1, " ".join(long[-12:-3])), (2, "nowhere")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate(df, item).collect()} == {1: 0, 2: 9, 3: 9, 4: 0, 5: 0}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.99)):
        b, r = bands_for(threshold, recall, 128)
        assert b * r <= 128 and 1 - (1 - threshold**r) ** b >= recall
    with pytest.raises(ValueError):
        bands_for(0.05, 0.9999, 4)


def brute_passages(rows, least):
    where = defaultdict(set)
    all_words = [tokens(r.text) for r in rows]
    for i, w in enumerate(all_words):
        for s in range(len(w) - least + 1):
            where[tuple(w[s : s + least])].add(i)
    out = Counter()
    for i, w in enumerate(all_words):
        spans = []
        for s in range(len(w) - least + 1):
            if len(where[tuple(w[s : s + least])]) > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + least
                else:
                    spans.append([s, s + least])
        if spans:
            out[rows[i].doc_id, len(w), tuple(map(tuple, spans))] += 1
    return out


@pytest.mark.parametrize(("least", "prefix", "hot", "at_once"), [(50, 20, 20_000, 1 << 15), (25, 10, 20_000, 100), (50, 20, 5, 100), (50, 20, 0, 1 << 15)])
def test_passages(spark, odd, monkeypatch, least, prefix, hot, at_once):
    monkeypatch.setattr(suffixes, "HOT_SUFFIXES", hot)
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    p = words(77, 90)
    more = [" ".join(words(400 + i, 13) + p[: 30 + 4 * i] + words(500 + i, 9)) for i in range(15)] + [" ".join(p[20:] + words(600, 5)), " ".join(["same"] * 80), " ".join(words(601, 9) + ["same"] * 70), " ".join((words(602, 30)) * 3)]
    docs = odd.select("doc_id", "text", "node").unionByName(spark.createDataFrame([(4000 + i, t, "x") for i, t in enumerate(more)], "doc_id long, text string, node string"))
    got = Counter((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.spans)) for r in repeated_passages(docs, least=least, prefix=prefix).collect())
    expected = brute_passages(docs.collect(), least)
    # A word repeated inside one text only does not count.
    assert got == expected and len(expected) > 12


@pytest.mark.parametrize("hot", [20_000, 5])
def test_passages_said_over_and_over(spark, monkeypatch, hot):
    """Places with the same words around them are one row, whose runs are not told place by place."""
    monkeypatch.setattr(suffixes, "HOT_SUFFIXES", hot)
    written = {}
    monkeypatch.setattr(suffixes, "materialise", lambda df, name: written.setdefault(name, common.materialise(df, name)))
    docs = spark.createDataFrame([(i, " ".join(words(700 + i, 7) + ["on", "he"] * (100 + i) + words(800 + i, 6))) for i in range(20)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.spans)) for r in repeated_passages(docs).collect())
    assert got == brute_passages(docs.collect(), 50)
    assert written["suffix-contexts"].count() < 20 * 90
    assert ("suffix-runs" in written) == (hot == 5)
    if hot == 5:
        assert written["suffix-classes"].count() < 20 * 20


def brute_kneser_ney(train):
    """Probability of a token (None: the end) after another, by dictionaries."""
    c = Counter(x for w in train for x in [*w, None])
    pairs = Counter(p for w in train for p in zip(["<s>", *w], [*w, None], strict=True))
    before = Counter(v for _, v in pairs)
    d1, d0 = (kneser_ney.discounts([sum(v == k for v in x.values()) for k in range(1, 5)]) for x in (pairs, before))
    off = lambda n, d: d[min(n, 3) - 1] if n else 0
    total, freed = Counter(), Counter()
    for (u, _), n in pairs.items():
        total[u] += n
        freed[u] += off(n, d1)
    spread = sum(off(n, d0) for n in before.values()) / max(1, len(pairs)) if pairs else 1.0

    def lower(w):
        return (before[w] - off(before[w], d0)) / max(1, len(pairs)) + spread / (len(c) + 1)

    def p(u, w):
        return lower(w) if u not in total else (pairs[u, w] - off(pairs[u, w], d1)) / total[u] + freed[u] / total[u] * lower(w)

    return c, p


@pytest.mark.parametrize(("part", "hot"), [(2_000_000, 1_000_000), (50, 1_000_000), (50, 7), (2_000_000, 1)])
def test_kneser_ney(spark, odd, monkeypatch, part, hot):
    monkeypatch.setattr(kneser_ney, "PART_TOKENS", part)
    monkeypatch.setattr(kneser_ney, "HOT_TOKENS", hot)
    monkeypatch.setattr(kneser_ney, "_HELD", 500)
    monkeypatch.setattr(kneser_ney, "PART_BYTES", part * 20)
    learn = odd.where("doc_id is null or doc_id % 3 <> 0")
    model = kneser_ney.train(learn.select("text"))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    assert hot > 100 or len(model.hot) > 5
    c, p = brute_kneser_ney([split(r.text) for r in learn.collect()])
    n = sum(c.values())
    assert (model.tokens, model.vocabulary) == (n, len(c))
    expected = Counter()
    for r in odd.collect():
        w = [*split(r.text), None]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (len(c) + 1))) for x in w)
        expected[r.doc_id, len(w), sum(c[x] > 0 for x in w), round(base, 4), round(sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w, strict=False)), 4)] += 1
    got = kneser_ney.score(odd.select("doc_id", "text"), model).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in got) == expected
    for u in ("<s>", "the", "a", "never seen"):
        assert sum(p(u, w) for w in c) + p(u, "another word never seen") == pytest.approx(1)


def test_scores_keep_columns_of_any_name(spark, odd):
    model = kneser_ney.train(odd.select("text"))
    scored = kneser_ney.score(odd.select("doc_id", "text", "size", "words", "n"), model)
    assert scored.columns == ["doc_id", "size", "words", "n", "n_tokens", "n_known", "base_score", "score"] and scored.count() == odd.count()


def test_kneser_ney_of_nothing(spark, odd, nothing):
    model = kneser_ney.train(nothing.select("text"))
    assert all(r.n_known == 0 and r.score == r.base_score == 0 for r in kneser_ney.score(odd.select("doc_id", "text"), model).collect())
    assert kneser_ney.score(nothing.select("doc_id", "text"), kneser_ney.train(odd.select("text").where(F.lit(True)))).collect() == []
