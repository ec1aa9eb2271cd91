"""Gate, fusion, evaluation and prompts on degenerate cases; snapshots, sources and streams."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewren.config import FILE_DEFAULTS, RetrievalConfig, read_settings, write_settings
from sedgewren.functions.embedding import HashingEmbedder, OnnxEmbedder, embed_column, embedder_of, packed
from sedgewren.functions.wordpiece import read_vocabulary
from sedgewren.operators import dialogue, evaluate, hybrid, index, lexical, topk, vector
from sedgewren.sources import cachefmt, kb, tables
from sedgewren.streaming import refresh
from sedgewren.streaming.progress import ProgressListener

CHUNKS = [(1, "a.txt", "alpha beta beta", [1.0, 0.0]), (2, "b.txt", "beta gamma", [0.8, 0.6]), (3, "a.txt", "delta", [0.0, 1.0]), (4, "c.txt", "。", [0.0, 0.0])]


@pytest.fixture(scope="module")
def idx(spark):
    return index.build(spark.createDataFrame(CHUNKS, "chunk_id long, source string, text string, vec array<double>"))


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string, vec array<double>")


def test_statistics(idx):
    assert {(r.term, r.df) for r in idx.term_df.collect()} == {("alpha", 1), ("beta", 2), ("gamma", 1), ("delta", 1), ("。", 1)}
    assert idx.stats.first().asDict() == {"n_docs": 4, "avgdl": 7 / 4}


def test_repeated_query_terms_count_again(spark, idx):
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_scores(idx, queries(spark, [(1, "beta", None), (2, "beta Beta", None)])).collect()}
    assert got[2, 1] == pytest.approx(2 * got[1, 1]) and set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}


@pytest.mark.parametrize(("cells", "at_once"), [(1 << 22, 8192), (3, 2)])
def test_best_chunks_are_those_of_all_scores(spark, monkeypatch, cells, at_once):
    import random

    r = random.Random(8)
    text = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(n))
    chunks = spark.createDataFrame([(i, "s", text(r.randint(0, 30))) for i in range(200)] + [(900, "s", None)], "chunk_id long, source string, text string")
    some = index.build(chunks)
    asked = spark.createDataFrame([(i, text(5)) for i in range(9)] + [(20, "zzz"), (21, ""), (22, None)], "query_id long, query string")
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", at_once)
    expected = lexical.ranked(lexical.bm25_scores(some, asked), 3).where("score > 0")
    row = lambda x: (x.query_id, x.chunk_id, round(x.score, 5), x["rank"])
    assert sorted(map(row, lexical.bm25_topk(some, asked).collect())) == sorted(map(row, expected.collect()))


def test_gate_keeps_queries_that_fail(spark, idx):
    hits, passed = hybrid.retrieve(idx, queries(spark, [(1, "beta", [1.0, 0.0]), (2, "beta", [-1.0, -1.0]), (3, "x", [])]))
    rows = {r.query_id: r for r in hybrid.contexts(hits, passed, idx.chunks).collect()}
    assert rows[1].used and not rows[2].used and rows[2].context == "" and rows[2].sources == []
    assert 3 not in rows
    assert rows[1].context.startswith("【参考资料】\n1. (来源：") and len(rows[1].sources) == 3


def test_one_candidate_has_score_zero(spark):
    one = index.build(spark.createDataFrame(CHUNKS[:1], "chunk_id long, source string, text string, vec array<double>"))
    hits, passed = hybrid.retrieve(one, queries(spark, [(1, "beta", [1.0, 0.0])]))
    assert [(r.score, r.rank) for r in hits.collect()] == [(0.0, 1)] and passed.first().used


def test_ties_go_by_id(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9)], "chunk_id long, vec array<double>")
    got = vector.cosine_topk(same, queries(spark, [(1, "", [2.0, 0.0])]), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [3, 5]


def test_equal_vectors_give_k_rows_a_task(spark):
    same = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec")).repartition(4)
    asked = queries(spark, [(i, "", [1.0, 0.0]) for i in range(3)])
    hits = vector.nearest(same, asked, 3)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in hits.collect()} == {(q, c, c + 1) for q in range(3) for c in range(3)}
    emitted = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            emitted.add(b.num_rows)
            yield b

    original, vector.ranked = vector.ranked, lambda df, k: df.mapInArrow(count, df.schema)
    try:
        vector.nearest(same, asked, 3).collect()
    finally:
        vector.ranked = original
    assert emitted.value == 4 * 3 * 3


def test_best_of_rows():
    r = np.random.default_rng(2)
    for n, k in ((5, 3), (40, 7), (3, 5), (7, 7)):
        score, ids = r.integers(0, 4, (6, n)).astype(float), r.permutation(100)[:n]
        got_score, got_ids = topk.best_of(score, ids, k)
        for row in range(6):
            expected = sorted(zip(-score[row], ids, strict=True))[:k]
            assert sorted(zip(-got_score[row], got_ids[row], strict=True)) == expected


def test_query_blocks_give_the_same(spark, idx, monkeypatch):
    q = queries(spark, [(i, "", [1.0, i / 10]) for i in range(20)])
    whole = sorted(map(tuple, vector.cosine_topk(idx.chunks, q, 2).collect()))
    monkeypatch.setattr(vector, "BLOCK_BYTES", 64)
    assert sorted(map(tuple, vector.cosine_topk(idx.chunks, q, 2).collect())) == whole


def test_verdict_truth_table(spark, idx):
    golden = spark.createDataFrame(
        [(1, "beta", ["a.txt"], ["alpha"], True), (2, "delta", ["b.txt"], [], False), (3, "nothing", [], [], False), (4, "zzz", None, ["q"], True)],
        "query_id long, query string, expect_sources array<string>, expect_keywords array<string>, must boolean",
    )
    judged = evaluate.judge(golden, lexical.bm25_topk(idx, golden.select("query_id", "query")), idx.chunks)
    got = {r.query_id: (r.src_ok, r.kw_ok, r.must_failed) for r in judged.collect()}
    assert got == {1: (True, True, False), 2: (False, True, False), 3: (True, True, False), 4: (True, False, True)}
    v = evaluate.verdict(judged)
    assert v.first().asDict() == {"n": 4, "recall": 0.75, "keyword_rate": 0.75, "must_failures": 1, "passed": False}
    assert evaluate.exit_code(idx.chunks, golden, v) == 1
    assert evaluate.exit_code(idx.chunks.limit(0), golden, v) == 2 and evaluate.exit_code(idx.chunks, None, None) == 0


def test_eviction(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a b c"), (1, 2, "assistant", "d e"), (1, 3, "user", "f"), (2, 0, "user", "x " * 99)], "conv_id long, turn long, role string, text string")
    keep = lambda n: {(r.conv_id, r.turn) for r in dialogue.evict(turns, RetrievalConfig(n_ctx=n, max_tokens=1)).where("kept").collect()}
    # A turn has five terms beside its text: im, start, the role, im, end.
    assert keep(1000) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    assert keep(2) == {(1, 0), (1, 3), (2, 0)}
    # The last two turns have 13 terms, the system turn has six.
    budget = lambda flag: {r.turn for r in dialogue.evict(turns, RetrievalConfig(n_ctx=14, max_tokens=1), flag).where("kept and conv_id = 1").collect()}
    assert budget(False) == {0, 2, 3} and budget(True) == {0, 3}
    prompt = dialogue.prompts(turns, RetrievalConfig(n_ctx=2, max_tokens=1)).where("conv_id = 1").first().prompt
    assert prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nf<|im_end|>\n<|im_start|>assistant\n"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml" if body else "other.xml", f"<w:p>{body}</w:p>")
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "kb"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.TXT").write_text("alpha one. two。three")
    (root / "sub" / "b.md").write_bytes("﻿beta".encode("utf-16-le"))
    (root / "sub" / "deep" / "c.txt").write_text("hidden")
    (root / "d.docx").write_bytes(docx("gamma &amp; delta"))
    (root / "e.docx").write_bytes(docx(""))
    (root / "f.docx").write_bytes(b"broken")
    (root / "g.doc").write_bytes(b"\x01\x02" + "这是一个旧格式文档的正文内容，长度足够超过二十个字符。".encode("utf-16-le") + b"\x00\x00")
    (root / "h.doc").write_bytes(b"\x00\x01plain old text of one byte\x00")
    (root / "i.pdf").write_text("no")
    return root


def test_directory(spark, tree):
    texts = {r.source: r.text for r in kb.read_texts(kb.scan(spark, str(tree))).collect()}
    assert texts == {"a.TXT": "alpha one. two。three", "b.md": "beta", "d.docx": "gamma & delta", "g.doc": "这是一个旧格式文档的正文内容，长度足够超过二十个字符。", "h.doc": "plain old text of one byte"}
    assert "c.txt" in {r.source for r in kb.scan(spark, str(tree), recursive=True).select("source").collect()}


def test_rebuild_publishes_once_and_keeps_the_last_good_snapshot(spark, tree, tmp_path):
    root = str(tmp_path / "index")
    assert refresh.rebuild(spark, str(tree), root) == 5
    assert refresh.rebuild(spark, str(tree), root) is None
    (tree / "j.txt").write_text("new text")
    assert refresh.rebuild(spark, str(tree), root) == 6
    assert index.manifest(spark, root)["version"] == 2 and index.load(spark, root).chunks.count() == 6
    for f in tree.rglob("*.*"):
        if f.is_file():
            f.unlink()
    (tree / "k.txt").write_text(" \n")
    assert refresh.rebuild(spark, str(tree), root) == 0
    m = index.manifest(spark, root)
    assert not m["enabled"] and index.load(spark, root) is None and index.load(spark, root, disabled=True).chunks.count() == 6
    assert len([f for f in (tmp_path / "index").iterdir() if f.name.startswith("snapshot=")]) == 2
    (tree / "l.txt").write_text("back again")
    assert refresh.rebuild(spark, str(tree), root) == 1 and index.manifest(spark, root)["version"] == 3
    assert [r.text for r in index.load(spark, root).chunks.collect()] == ["back again"]
    assert index.vacuum(spark, root) == 2 and index.load(spark, root).chunks.count() == 1


def test_crashes_while_publishing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    one = lambda t: index.build(spark.createDataFrame([(1, "s", t)], "chunk_id long, source string, text string"))
    text = lambda: index.load(spark, root).chunks.first().text
    assert index.publish(one("first"), root, "a") == 1

    def crash(*_):
        raise RuntimeError

    for step in ("_write_blocks", "_point_to"):
        monkeypatch.setattr(index, step, crash)
        with pytest.raises(RuntimeError):
            index.publish(unbuilt(spark), root, "b")
        monkeypatch.undo()
        assert text() == "first" and index.is_current(spark, root, "a")
    assert index.publish(one("second"), root, "b") == 1 and text() == "second" and index.manifest(spark, root)["version"] == 2
    # What a crashed writer of a manifest leaves is no manifest.
    (tmp_path / "index" / "manifests" / "junk.new").write_text("{")
    assert text() == "second" and index.vacuum(spark, root) == 3


def unbuilt(spark):
    chunks = spark.createDataFrame([(1, "s", "lost")], "chunk_id long, source string, text string")
    return index.Index(chunks, chunks, chunks)


def test_missing_folder_and_other_files(spark, tree, tmp_path):
    assert kb.scan(spark, str(tmp_path / "none")).count() == 0 and kb.scan(spark, str(tmp_path / "none"), recursive=True).count() == 0
    assert refresh.rebuild(spark, str(tmp_path / "none"), str(tmp_path / "index")) == 0 and index.load(spark, str(tmp_path / "index")) is None
    read = {r.path.rpartition("/kb/")[2] for r in kb.scan(spark, str(tree)).select("path").collect()}
    assert read == {"a.TXT", "sub/b.md", "d.docx", "e.docx", "f.docx", "g.doc", "h.doc"}


def test_chunks_are_numbered_by_their_paths(spark, tree):
    files = kb.scan(spark, str(tree))
    chunks = kb.chunks_of(kb.read_texts(files), kb.numbered(files)).orderBy("chunk_id").collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks) and [c.path for c in chunks] == sorted(c.path for c in chunks)
    assert all(c.path.endswith("/" + c.source) for c in chunks)


def test_refresh_with_an_embedder_then_retrieval_from_text(spark, tree, tmp_path):
    make, name = embedder_of(FILE_DEFAULTS | {"embedding.dimension": "64"})
    embed, root, steps = embed_column(make), str(tmp_path / "index"), []
    quick = RetrievalConfig(debounce_ms=10)
    refresh.refresh(spark, str(tree), root, str(tmp_path / "state"), embed, name, quick, on_step=lambda *x: steps.append(x)).awaitTermination(120)
    loaded = index.load(spark, root)
    assert loaded.chunks.count() == 5 and steps == [(1, 2), (2, 2)] and index.manifest(spark, root)["embedder"] == "hashing-64"
    assert refresh.rebuild(spark, str(tree), root, embed, name, quick) is None
    asked = spark.createDataFrame([(1, "gamma delta"), (2, " "), (3, "。"), (4, "zzz qqq")], "query_id long, query string")
    rows = {r.query_id: r for r in hybrid.answer(loaded, asked, embed).collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[1].used and rows[1].sources[0] == "d.docx" and "gamma & delta" in rows[1].context
    assert not rows[2].used and rows[2].best_vector_score is None and rows[2].context == ""
    logged = hybrid.metrics(hybrid.answer(loaded, asked, embed), asked)
    assert 2 not in {r.query_id for r in logged.select("query_id").collect()}
    assert {(r.used, r.context) for r in hybrid.answer(None, asked, embed).collect()} == {(False, "")}


def test_settled_waits_for_the_end_of_a_burst(spark, tmp_path):
    import threading
    import time

    root = tmp_path / "kb"
    root.mkdir()
    (root / "a.txt").write_text("a")

    def write():
        for i in range(6):
            (root / "a.txt").write_text("a" * (i + 2))
            time.sleep(0.2)

    writer = threading.Thread(target=write)
    writer.start()
    assert refresh.settled(spark, str(root), RetrievalConfig(debounce_ms=700))
    assert (root / "a.txt").read_text() == "a" * 7
    writer.join()


def test_settings_file(tmp_path):
    path = str(tmp_path / "s.ini")
    assert read_settings(path) == FILE_DEFAULTS and (tmp_path / "s.ini").exists()
    write_settings(path, {"knowledge_base.directory": "/data/kb", "embedding.backend": " ", "embedding.dimension": "32"})
    found = read_settings(path)
    assert found["knowledge_base.directory"] == "/data/kb" and found["embedding.backend"] == "hashing" and embedder_of(found)[1] == "hashing-32"
    with pytest.raises(ValueError, match="no embedding backend"):
        embedder_of(found | {"embedding.backend": "other"})


def test_session_settings(spark):
    from sedgewren.config import setting

    spark.conf.set("sedgewren.some.key", "v")
    spark.conf.set("sedgewren.blank.key", "  ")
    assert [setting(spark, k, "d") for k in ("some.key", "blank.key", "no.key")] == ["v", "d", "d"]


def test_packed_batches(spark):
    import random

    from sedgewren.operators.batching import batch_numbers

    r = random.Random(4)
    for small in (RetrievalConfig(batch_items=3, batch_tokens=20, batch_context=30), RetrievalConfig(batch_items=8, batch_tokens=50, batch_context=25)):
        sizes = [r.choice([0, 1, 5, 9, 30, 60]) for _ in range(200)]
        numbers = spark.createDataFrame([(sizes,)], "n array<long>").select(batch_numbers(F.col("n"), small)).first()[0]
        got = [0] * len(sizes)
        for k, batch in enumerate(packed(sizes, small), 1):
            for i in batch:
                got[i] = k
        assert got == numbers


def test_onnx_embedder_packs_and_masks():
    class Session:
        calls = []

        def run(self, _, inputs):
            ids, mask = inputs["input_ids"], inputs["attention_mask"]
            self.calls.append(ids.shape)
            total = (ids * mask).sum(axis=1, keepdims=True).astype(np.float32)
            return [np.repeat(np.hstack([total, np.ones_like(total)])[:, None, :], ids.shape[1], axis=1)]

    vocabulary = {t.encode(): i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "##b"])}
    texts = ["a", "a a a b", "", "abb b", *["a b"] * 9]
    e = OnnxEmbedder("none", vocabulary, 2)
    e._session = Session()
    together = e.embed(texts)
    assert [s[0] for s in Session.calls] == [2, 8, 2] and not together[2].any()
    alone = np.vstack([e.embed([t]) for t in texts])
    assert np.allclose(together, alone) and np.allclose(np.linalg.norm(np.delete(together, 2, 0), axis=1), 1)


def test_onnx_runtime_is_used(tmp_path):
    """A model file that is none is refused by the runtime, not by us."""
    onnxruntime = pytest.importorskip("onnxruntime")
    (tmp_path / "m.onnx").write_bytes(b"no model")
    with pytest.raises(Exception) as e:
        OnnxEmbedder(str(tmp_path / "m.onnx"), {b"[CLS]": 0}, 2).embed(["a"])
    assert type(e.value).__module__.startswith(onnxruntime.__name__)


def test_vocabulary_file(tmp_path):
    (tmp_path / "v.txt").write_bytes(b"[PAD]\r\na\nb\r\na\n")
    assert read_vocabulary(str(tmp_path / "v.txt")) == {b"[PAD]": 0, b"b": 2, b"a": 3}


def test_evaluation_run(spark, idx):
    golden = spark.createDataFrame([(1, "beta", ["a.txt"], ["alpha"], True, 2)], "query_id long, query string, expect_sources array<string>, expect_keywords array<string>, must boolean, topk int")
    assert evaluate.run(None, golden).code == 2 and evaluate.run(idx, None).code == 0
    assert evaluate.run(idx, golden).code == 0 and evaluate.run(idx, golden).sources.count() == 3
    failed = evaluate.run(idx, golden.withColumn("expect_keywords", F.array(F.lit("nowhere"))))
    assert failed.code == 1 and failed.judged.first().missing == ["nowhere"]
    report = evaluate.inspect_index(idx.chunks, "beta")
    assert [r.source for r in report["sources"].collect()] == ["a.txt", "b.txt", "c.txt"] and report["totals"].first().asDict() == {"chunks": 4, "sources": 3, "chars": 31}
    assert {(r.source, r.n) for r in report["keyword_hits"].collect()} == {("a.txt", 1), ("b.txt", 1)} and report["first"].count() == 3 and report["keyword_preview"].count() == 2


def test_agreement_verdict_and_valid_vectors(spark):
    pairs = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 1.0]), (3, None, [1.0])], "id long, a array<double>, b array<double>")
    agreed = evaluate.agreement(pairs)
    assert evaluate.agreement_verdict(agreed).first().asDict() == {"n": 3, "n_agree": 1, "passed": False}
    assert evaluate.agreement_verdict(agreed.where("id = 1")).first().passed
    assert evaluate.valid_vectors(pairs.select(F.col("a").alias("vec"))).first().asDict() == {"n": 3, "n_valid": 2}


def test_encode_times():
    got = evaluate.encode_times(lambda: HashingEmbedder(8), ["one", "two", "!"], rounds=2)
    assert got["n_valid"] == 2 and got["least_ms"] <= got["median_ms"] <= got["most_ms"]


def test_latency_summary_of_many_values(spark):
    import random

    r = random.Random(6)
    rows = [("a", r.gauss(0, 1)) for _ in range(40_001)] + [("b", float(r.randint(0, 3))) for _ in range(5000)] + [("c", None), (None, 1.0), (None, 2.0), ("d", -0.5)]
    got = {x.g: x for x in evaluate.latency_summary(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g].median == (values[len(values) // 2] if values else None) and got[g].n == len(values)


def test_changed_files(spark, tree):
    listing = ["path", "length", "modificationTime"]
    known = spark.createDataFrame(kb.scan(spark, str(tree)).select(*listing).collect(), "path string, length long, modificationTime timestamp")
    assert kb.changed_files(kb.scan(spark, str(tree)), known).count() == 0
    (tree / "a.TXT").write_text("longer than it was before, by a lot of characters")
    (tree / "new.md").write_text("new")
    assert {r.source for r in kb.changed_files(kb.scan(spark, str(tree)), known).select("source").collect()} == {"a.TXT", "new.md"}


def test_progress_is_told(spark, tmp_path):
    import time

    told, ended = [], []
    listener = ProgressListener(lambda batch, rows: told.append((batch, rows)), ended.append)
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "p"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "p")).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(60)
        for _ in range(100):
            if ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (0, 7) in told and ended == [None]


def test_refresh_stream(spark, tree, tmp_path):
    q = refresh.refresh(spark, str(tree), str(tmp_path / "index"), str(tmp_path / "state"), config=RetrievalConfig(debounce_ms=10))
    q.awaitTermination(120)
    assert index.load(spark, str(tmp_path / "index")).chunks.count() == 5


def test_debounce_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:0{s}.{ms:03d}",) for s, ms in ((0, 0), (0, 700), (1, 400), (3, 0), (9, 0))]
    spark.createDataFrame(rows, "ts string").select(F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = refresh.debounce(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "e")), lateness="1 second")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n_events for r in spark.table("bursts").collect()) == [1, 3]


def test_cache_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "β", [0.0, 1.0]), (1, "a", "", [1.0, 0.5]), (3, "c", "x", None)], "chunk_id long, source string, text string, vec array<float>")
    path = cachefmt.cache_path(str(tmp_path / "kb"))
    assert path.startswith(str(tmp_path) + "/.rag_cache_")
    assert cachefmt.write(rows, path, 2, "sig") == 2
    assert [tuple(r) for r in cachefmt.read(spark, path, 2, "sig").orderBy("chunk_id").collect()] == [(0, "a", "", [1.0, 0.5]), (1, "b", "β", [0.0, 1.0])]
    assert cachefmt.read(spark, path, with_vectors=False).first().vec is None
    data = open(path, "rb").read()
    for bad in (b"XXXX" + data[4:], data[:4] + b"\x05" + data[5:], data[:-1], data[:8] + b"\x00" * 4 + data[12:], data[:12] + b"\xff" * 4 + data[16:]):
        with pytest.raises(cachefmt.CacheError):
            list(cachefmt.decode(bad))
    with pytest.raises(cachefmt.CacheError):
        list(cachefmt.decode(data, signature="other"))


def test_golden_and_session_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"topk": 5, "questions": [{"q": "x", "must": true}, {"q": "y", "expect_sources": ["s"]}]}')
    got = tables.golden_set(spark, str(tmp_path / "g.json")).orderBy("query_id").collect()
    assert [(r.query, r.expect_sources, r.must, r.topk) for r in got] == [("x", [], True, 5), ("y", ["s"], False, 5)]
    tables.write_session(spark, str(tmp_path / "s"), "m.gguf", True, ["one", "", "two\nlines"])
    s = tables.session(spark, str(tmp_path / "s")).first()
    assert (s.model_path, s.need_close, s.turns) == ("m.gguf", True, ["one", "two\nlines"])
    sessions = tables.session(spark, str(tmp_path / "s"))
    assert tables.restorable(sessions, "other").count() == 0
    # The text that was taken in: the system turn and the turns without the closing mark of the last one.
    text = "<|im_start|>system\nbe brief<|im_end|>\none<|im_start|>user\nhi<|im_end|>\n".removesuffix("<|im_end|>\n")
    counted = spark.createDataFrame([("m.gguf ", True, ["one", "<|im_start|>user\nhi<|im_end|>\n"], len(text))], "model_path string, need_close boolean, turns array<string>, n_tokens long")
    restored = lambda system: tables.restorable(counted, "m.gguf", system, F.length).count()
    assert restored("be brief") == 1 and restored("be long") == 0


def test_prefill_slices(spark):
    rows = spark.createDataFrame([(list(range(1030)),), ([],), (None,), ([7],)], "ids array<int>")
    got = [r[0] for r in rows.select(dialogue.prefill_slices(F.col("ids"))).collect()]
    assert [[len(s) for s in x] if x is not None else None for x in got] == [[512, 512, 6], [], [] if got[2] is not None else None, [1]]
    assert sum(got[0], []) == list(range(1030))


def test_metrics_log(spark, idx, tmp_path):
    q = queries(spark, [(1, "beta", [1.0, 0.0])])
    hits, passed = hybrid.retrieve(idx, q)
    rows = hybrid.metrics(hybrid.contexts(hits, passed, idx.chunks), q)
    for _ in range(2):
        hybrid.log_metrics(rows, str(tmp_path / "m"), 1.5)
    hybrid.log_metrics(rows, None, 1.5)
    got = spark.read.json(str(tmp_path / "m"))
    assert got.count() == 2 and set(got.columns) == {"ts", "query", "used", "best_vector_score", "latency_ms", "chunks", "sources"}
