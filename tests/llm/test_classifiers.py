"""Held-out accuracy of the classifiers, their edge cases, and the pipeline stage by stage."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import words
from pyspark.sql import functions as F
from test_native import fill
from test_search import brute_contamination, brute_links

import corpus_pipeline
from sedgewren.llm import byte_cnn, toxicity
from sedgewren.llm.labelled import labelled_sample


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def made(spark):
    """Texts of which some have words of their own (toxic) or shout (bad), with labels for all."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = words(10_000 + i, r.randint(30, 90))
        toxic, bad = r.random() < 0.3, r.random() < 0.3
        if toxic:
            for _ in range(r.randint(2, 5)):
                w[r.randrange(len(w))] = r.choice(["vilificus", "horribundus", "putridello", "gruntmuck"])
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("classify", "column", "threshold"), [(toxicity.classify, 2, 0.3), (byte_cnn.classify, 1, 0.7)], ids=["toxicity", "quality"])
def test_held_out_accuracy(made, classify, column, threshold):
    docs, labels, truth = made
    rows = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(rows) == len(truth) and all(r.held_out == held_out(r.doc_id) and r.predicted == (r.score >= threshold) for r in rows.values())
    right = [rows[t[0]].predicted == t[column] for t in truth if held_out(t[0])]
    assert np.mean(right) > 0.97


@pytest.mark.parametrize("classify", [toxicity.classify, byte_cnn.classify])
def test_labels_of_the_held_out_fold_change_nothing(made, classify):
    docs, labels, _ = made
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(doc_id AS string)), 4) = 2 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN pmod(crc32(cast(doc_id AS string)), 4) = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    some = docs.where("doc_id < 50")
    a, b = (sorted((r.doc_id, r.score) for r in classify(docs, x).collect() if r.doc_id < 50) for x in (labels, flipped))
    assert a == b and len(a) == some.count()


@pytest.mark.parametrize("classify", [toxicity.classify, byte_cnn.classify])
def test_odd_rows(odd, nothing, labels, classify):
    rows = classify(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 for r in rows)
    assert classify(nothing, labels).collect() == []
    constant = {r.score for r in classify(odd, labels.limit(0)).collect()}
    assert constant == {0.0}


def test_words_of_few_toxic_texts_are_learnt():
    """A language with 1.6 % of the toxic texts, whose bad words no other has, is told apart all the same."""
    r = random.Random(9)
    plain = {k: ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(300)] for k, letters in (("a", "etaoinshr"), ("b", "lumpcvdky"))}
    bad = {"a": ["vilificus", "horribundus", "putridello"], "b": ["zwaxofeg", "jaqibezo"]}

    def text(lang, toxic):
        w = [r.choice(plain[lang]) for _ in range(30)]
        return " ".join(w[:15] + [r.choice(bad[lang]) for _ in range(3 * toxic)] + w[15:])

    rows = [(text("b" if i % 62 == 0 else "a", True), 1) for i in range(1500)] + [(text("b" if i % 10 == 0 else "a", False), 0) for i in range(3000)]
    r.shuffle(rows)
    model = toxicity.train(pa.table({"text": [t for t, _ in rows], "label": [y for _, y in rows]}), {0: 3000, 1: 1500})
    for lang, toxic in [("a", True), ("b", True), ("a", False), ("b", False)]:
        p = model.scorer()(pa.array([text(lang, toxic) for _ in range(100)]))
        assert np.mean((p >= 0.3) == toxic) > 0.95, (lang, toxic)


def test_toxicity_does_not_depend_on_the_order_of_rows():
    r = random.Random(2)
    plain = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(200)]
    rows = [(" ".join([r.choice(plain) for _ in range(30)] + [r.choice(["vilificus", "putridello"])] * (i % 2)), i % 2) for i in range(300)]
    asked, seen = pa.array([t for t, _ in rows[:50]]), []
    for _ in range(7):
        r.shuffle(rows)
        seen.append(toxicity.train(pa.table({"text": [t for t, _ in rows], "label": [y for _, y in rows]}), {0: 150, 1: 150}).scorer()(asked))
    assert all((x == seen[0]).all() for x in seen)


def test_sample_is_bounded_and_stable(odd, labels):
    a, counts = labelled_sample(odd, labels, "quality", {0: 5, 1: 9}, 2, 4)
    b, _ = labelled_sample(odd.repartition(5), labels, "quality", {0: 5, 1: 9}, 2, 4)
    rows = a.collect()
    assert len(rows) <= 14 and sorted(map(str, rows)) == sorted(map(str, b.collect()))
    known = {i for i, *_ in ((r.doc_id,) for r in odd.where("text is not null").collect()) if i is not None and i < 230 and zlib.crc32(str(i).encode()) % 4 != 2}
    assert sum(counts.values()) == len(known)


def test_sample_of_long_texts_and_repeated_ids(spark):
    """No text is too long to be learnt from, and an id with several texts gives the same one however rows lie."""
    long = "".join(f"{i:07d} " for i in range(40_000))
    docs = spark.createDataFrame([(1, long), (2, "b"), (2, "a"), (2, "c"), (3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (None, 1)], "doc_id long, toxic int")
    draw = lambda d: {r.id: r.text for r in labelled_sample(d, labels, "toxic", {1: 9}, -2, 4)[0].collect()}
    got = draw(docs)
    assert set(got) == {1, 2} and draw(docs.repartition(4)) == draw(docs.orderBy(F.col("text").desc())) == got
    assert got[1] == long


def test_mark_in_long_labelled_texts_is_learnt(spark):
    """Labelled texts that are all long still teach, and a mark at the very end of a long text is found."""
    r = random.Random(3)
    plain = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = ["vilificus", "horribundus", "putridello"]

    def text(toxic):
        w = [r.choice(plain) for _ in range(12_000)]
        if toxic:
            for k in range(0, 12_000, 60):
                w[k + r.randrange(60)] = r.choice(bad)
        return " ".join(w)

    rows = [(i, text(i % 2)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (1000, " ".join(r.choice(plain) for _ in range(30_000))), (1001, " ".join([r.choice(plain) for _ in range(30_000)] + bad * 3))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    score = {x.doc_id: x.score for x in toxicity.classify(docs, labels).collect()}
    assert np.mean([(score[i] >= 0.3) == i % 2 for i in range(60)]) > 0.95 and score[1001] > score[1000]


def test_pooling_covers_the_whole_text():
    """The same as convolving each text by itself, and a mark at the end of a long text is seen."""
    r = np.random.default_rng(1)
    net = byte_cnn.ByteCNN(r.normal(size=(byte_cnn.WIDTH, byte_cnn.SYMBOLS, byte_cnn.FILTERS)).astype(np.float32), r.normal(size=byte_cnn.FILTERS).astype(np.float32), r.normal(size=2 * byte_cnn.FILTERS).astype(np.float32), 0.1)
    texts = ["", None, "a", "ab" * 300, "x" * 64, "y" * 257, " ".join(words(3, 4000)), "the the the the the the the end"]
    together = net.scores(pa.array(texts))
    apart = np.concatenate([net.scores(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, apart, atol=1e-5)

    def one(text):
        x, start, length = byte_cnn.symbols(pa.array([text]))
        s = x[start[0] : start[0] + length[0] + byte_cnn.WIDTH]
        conv = np.array([sum(net.filters[k][s[i + k]] for k in range(byte_cnn.WIDTH)) for i in range(length[0])])
        pooled, at = [], 0
        while True:
            pooled.append(np.maximum(conv[at : at + 256].max(axis=0) + net.bias, 0))
            if at + 256 >= length[0]:
                break
            at += 192
        z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ net.weights + net.intercept
        return 1 / (1 + np.exp(-z))

    for text, score in zip(texts[2:6], together[2:6], strict=True):
        assert one(text) == pytest.approx(score, abs=1e-4)


def test_pipeline_stages(spark, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, sf)
    scores = brute_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert clean.columns == columns and Counter(r.doc_id for r in clean.collect()) == Counter(i for i, s in scores if s < 0.3)
    assert any(s >= 0.3 for _, s in scores)

    one = stage["near_duplicates"](spark, docs, sf)
    expected = {c for _, c, _ in brute_links(docs.collect())}
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(expected)

    apart = stage["decontamination"](spark, docs, sf)
    hit = brute_contamination(docs.collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == sorted(k[0] for k in hit if not k[4])

    mixed = stage["mixing"](spark, docs, sf).collect()
    size = Counter()
    for r in docs.collect():
        size[r.source] += len((r.text or "").split())
    target, taken, largest = fill(size, (5, 2, 1), 1.5, 2), Counter(), Counter()
    for r in mixed:
        taken[r.source] += len((r.text or "").split())
    for r in docs.collect():
        largest[r.source] = max(largest[r.source], len((r.text or "").split()))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2

    placed = stage["sharding"](spark, docs, sf).collect()
    key = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    order = sorted((key(r.text or ""), key(str(r.doc_id)), r.doc_id, len((r.text or "").encode()) + 16) for r in docs.collect())
    upto, total, expected, slots = 0, sum(x[3] for x in order), {}, Counter()
    for _, _, i, size in order:
        # A row goes before a splitter if that brings the splitter nearer to its target.
        shard = sum(not (upto + size < total * t / 40 or (upto < total * t / 40 and upto + size - total * t / 40 < total * t / 40 - upto)) for t in range(1, 40))
        upto += size
        expected[i] = shard, slots[shard]
        slots[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in placed} == expected


def brute_toxicity(docs, labels):
    """id and score of each row, window by window: each by itself, compressed with either dictionary."""
    model = toxicity.toxicity_model(docs, labels)
    import zstandard

    def compressor(content):
        return zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)

    out = []
    for r in docs.select("doc_id", "text").collect():
        scores = []
        for c in model.classifiers:
            ordinary, toxic, saved = compressor(c.ordinary), compressor(c.ordinary + c.toxic), []
            for w in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower()):
                pieces = [b" " + w[i : i + toxicity.WINDOW] + b" " + toxicity.TAIL for i in range(0, max(1, len(w) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)]
                saved.append(max(len(ordinary.compress(p)) - len(toxic.compress(p)) for p in pieces))
            n = len(saved)
            x = [min(max(max(saved), 0), 10), sum(max(s, 0) for s in saved) / math.sqrt(n)] if n else [0, 0]
            for least in toxicity.DISTANCES:
                enough = sum(s >= least for s in saved)
                x += [math.log1p(enough), math.sqrt(enough / n)] if n else [0, 0]
            z = c.weights[0] + sum(b * (v - m) / s for b, v, m, s in zip(c.weights[1:], x, c.centre, c.scale, strict=True))
            scores.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        out.append((r.doc_id, sum(scores) / len(scores)))
    return out


def test_toxicity_window_by_window(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    expected = dict(brute_toxicity(docs, labels))
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert got.keys() == expected.keys() and all(got[i] == pytest.approx(s, abs=1e-9) for i, s in expected.items())


def test_a_training_step_goes_down_the_gradient():
    """One step of training on one batch moves every parameter against the sign of the loss's numerical derivative."""
    r = random.Random(12)
    texts = ["".join(r.choice("abcde fgh") for _ in range(r.randint(20, 200))) for _ in range(12)]
    y = np.array([i % 2 for i in range(12)])
    table = pa.table({"text": pa.array(texts), "label": pa.array(y.tolist(), pa.int32())})
    start = byte_cnn.train(table, {0: 6, 1: 6}, epochs=1, batch=12, rate=0.0)
    after = byte_cnn.train(table, {0: 6, 1: 6}, epochs=1, batch=12, rate=1e-4)

    def loss(net):
        p = np.clip(net.scores(pa.array(texts)), 1e-12, 1 - 1e-12)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    used = sorted({b for t in texts for b in t.encode()})
    places = [("filters", (k, b, f)) for k in (0, 4) for b in used for f in range(byte_cnn.FILTERS)] + [("bias", (f,)) for f in range(byte_cnn.FILTERS)] + [("weights", (f,)) for f in range(2 * byte_cnn.FILTERS)]
    checked = 0
    for name, at in places:
        slopes = []
        for h in (1e-3, 2e-3):
            ends = []
            for sign in (1, -1):
                moved = {n: getattr(start, n).copy() for n in ("filters", "bias", "weights")}
                moved[name][at] += sign * h
                ends.append(loss(byte_cnn.ByteCNN(moved["filters"], moved["bias"], moved["weights"], start.intercept)))
            slopes.append((ends[0] - ends[1]) / (2 * h))
        # Where another place takes over as a maximum there is no derivative.
        if abs(slopes[0]) > 1e-4 and abs(slopes[0] - slopes[1]) < 0.05 * abs(slopes[0]):
            step = getattr(after, name)[at] - getattr(start, name)[at]
            assert np.sign(step) == -np.sign(slopes[0]), (name, at, slopes, step)
            checked += 1
    assert checked > 100


def test_pipeline_odd_rows(spark, odd, nothing, sf):
    for docs in (odd.withColumnRenamed("_row", "row_number"), nothing):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, corpus_pipeline.materialise(stage(spark, docs, sf), "odd")
            assert name == "sharding" or docs.columns == before
        assert docs.columns[0] == "doc_id"


def test_near_duplicates_of_repeated_rows(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text of words"), (None, "a b c d e f"), (None, "lonely"), (2, "")], "doc_id long, text string")
    got = corpus_pipeline.one_of_each_group(spark, docs, sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "a b c d e f"), (1, "quite another text of words"), (None, "lonely"), (2, "")])


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r.shard for r in rows} == set(range(40))
