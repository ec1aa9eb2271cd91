"""Chunks and batches in linear time, pruned search, indexes that follow their files, and the streams that drive them."""

import os
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedgewren.config import DEFAULT, RetrievalConfig
from sedgewren.functions.embedding import packed
from sedgewren.operators import batching, chunking, dialogue, index, lexical, segments, vector
from sedgewren.sources import cachefmt, changes
from sedgewren.streaming import dialogues, refresh, timers

# ---------------------------------------------------------------- chunks and batches


def chunks_by_rule(text: str, config=DEFAULT) -> list[str]:
    pieces = [p for p in (re.sub(r"^\s+|\s+$", "", p) for p in re.split("[。！？!?；;\r\n]+", text)) if p]
    out, now = [], ""
    for p in pieces:
        if now and len(now) + len(p) > config.chunk_size:
            out.append(now)
            now = now[-config.chunk_overlap :] if config.chunk_overlap else ""
        now += p
    return [c for c in (x.strip() for x in [*out, now]) if c]


@pytest.mark.parametrize("config", [DEFAULT, RetrievalConfig(chunk_size=12, chunk_overlap=5), RetrievalConfig(chunk_size=7, chunk_overlap=0), RetrievalConfig(chunk_size=9, chunk_overlap=30)])
def test_chunks(spark, config):
    r = random.Random(1)
    texts = ["".join(r.choice("ab 。!\n;中é　 ") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["x" * 500 + "!" + "y" * 10, "", "!!", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", chunking.split_chunks(F.col("text"), config).alias("c")).collect()
    assert {x.id: x.c for x in rows} == {i: None if t is None else chunks_by_rule(t, config) for i, t in enumerate(texts)}


def test_long_text_is_cut_in_linear_time():
    text = "A sentence of some words that goes on for a while; " * (16 << 20 >> 6)
    start = time.time()
    assert sum(map(len, chunking.chunks_of_text(text))) > len(text) * 0.9
    assert time.time() - start < 10


def test_too_many_chunks_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PLACES", 2)
    docs = spark.createDataFrame([(1, "a" * 240 + "!" + "b" * 240 + "!" + "c" * 240, "s")], "doc_id long, text string, source string")
    with pytest.raises(Exception, match="too many chunks"):
        chunking.chunk_documents(docs).collect()


SMALL = RetrievalConfig(batch_items=3, batch_tokens=20, batch_context=30)


@pytest.mark.parametrize(("n", "block", "group"), [(0, 8, 4), (1, 8, 4), (8, 8, 4), (500, 8, 4), (500, 5, 2), (300, 16384, 4096)])
@pytest.mark.parametrize("config", [SMALL, RetrievalConfig(batch_items=5, batch_tokens=50, batch_context=25)])
def test_library_batches(spark, tmp_path, n, block, group, config):
    r = random.Random(n)
    sizes = [r.choice([0, 1, 1, 5, 9, 30, 60]) for _ in range(n)]
    rows = [(i * 3 - 50, s) for i, s in enumerate(sizes)]
    r.shuffle(rows)
    found = batching.library_batches(spark.createDataFrame(rows, "chunk_id long, n_tokens long").repartition(3), str(tmp_path / "b"), config=config, block=block, group=group)
    expected = [0] * n
    for k, batch in enumerate(packed(sizes, config), 1):
        for i in batch:
            expected[i] = k
    assert [(x.chunk_id, x.batch) for x in found.orderBy("chunk_id").collect()] == [(i * 3 - 50, b) for i, b in enumerate(expected)]


def test_one_call_a_batch(spark):
    class Counting:
        """Puts the number of texts of a call into each vector."""

        dimension = 2

        def embed(self, texts):
            return np.array([[len(texts), len(t)] if t else [0, 0] for t in texts], float).reshape(-1, 2)

    rows = [(i, "t" * (i % 5), i // 4 if i % 9 else 0) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = batching.embed_batches(spark.createDataFrame(rows, "chunk_id long, text string, batch long"), Counting).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = {b: sum(x[2] == b for x in rows) for _, _, b in rows}
    assert {x.chunk_id: x.vec for x in got} == {i: [many[b], len(t)] if b and t else None for i, t, b in rows}


# ---------------------------------------------------------------- pruned search


def library(seed: int, n: int) -> list[tuple]:
    """Texts of common words, and of topics that only some neighbouring texts have."""
    r = random.Random(seed)
    return [(i, f"s{i % 3}", " ".join(r.choice(["the", "and", "of", "or"] + [f"topic{i // 20}x{k}" for k in range(4)]) for _ in range(r.randint(0, 40)))) for i in range(n)]


def test_pruned_search_is_exact_and_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE_BITS", 4)
    chunks = spark.createDataFrame(library(1, 900), "chunk_id long, source string, text string").coalesce(1)
    asked = [(1, "the topic3x1 and topic3x2"), (2, "topic7x0 topic30x1 topic30x1"), (3, "the of"), (4, "nothing of this"), (5, ""), (6, "unknown"), (7, "topic0x0")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    built = index.build(chunks)
    index.publish(built, str(tmp_path / "i"), "a")
    stored = index.load(spark, str(tmp_path / "i"))
    exhaustive = sorted(map(tuple, lexical.bm25_topk(built, queries).collect()))
    assert sorted(map(tuple, lexical.bm25_topk(stored, queries).collect())) == exhaustive
    monkeypatch.setattr(lexical, "TERMS_TOLD", 0)
    assert sorted(map(tuple, lexical.bm25_topk(stored, queries).collect())) == exhaustive
    monkeypatch.undo()
    for q in (1,):
        one = lexical.Pruned(stored, queries.where(f"query_id = {q}"))
        assert one.topk().count() == 3
        assert 0 < one.read.value < one.pairs.value
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = lexical.bm25_topk(stored, queries)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)
    assert pushed and all("term" in p and "topic30x1" in p for p in pushed) and "/chunks" not in plan and "text" not in plan
    # The other tables of a stored index are those of one that is not.
    assert sorted(map(tuple, stored.postings.select("chunk_id", "term", "tf").collect())) == sorted(map(tuple, built.postings.select("chunk_id", "term", "tf").collect()))
    assert sorted(map(tuple, stored.term_df.collect())) == sorted(map(tuple, built.term_df.collect()))
    assert sorted(map(tuple, stored.doc_len.collect())) == sorted(map(tuple, built.doc_len.collect())) and stored.stats.first() == built.stats.first()


# ---------------------------------------------------------------- segments


class Shelf:
    """Files in memory, and how many of them were read."""

    def __init__(self, spark):
        self.spark, self.files, self.read = spark, {}, []

    def put(self, path, text, time):
        self.files[path] = (text, time)

    def listing(self):
        rows = [(p, len(t), time) for p, (t, time) in self.files.items()]
        return self.spark.createDataFrame(rows, "path string, length long, modificationTime string").withColumn("modificationTime", F.col("modificationTime").cast("timestamp"))

    def texts(self, fresh):
        paths = [r.path for r in fresh.select("path").collect()]
        self.read.append(sorted(paths))
        return self.spark.createDataFrame([(p, p.upper(), self.files[p][0]) for p in paths], "path string, source string, text string")

    def update(self, root, **more):
        return segments.update(self.spark, root, self.listing(), self.texts, **more)


def searched(spark, found, queries):
    """By path and place, as numbers of files differ between an index that was followed and one that was built anew."""
    names = {r.chunk_id: (r.path, r.chunk_id % chunking.PLACES) for r in found.chunks.collect()}
    everything = lexical.bm25_scores(found, queries).collect()
    best = lexical.bm25_topk(found, queries).collect()
    return sorted((r.query_id, names[r.chunk_id], round(r.score, 6)) for r in everything), sorted((r.query_id, r.rank, round(r.score, 6)) for r in best)


def test_followed_index_is_one_built_anew(spark, tmp_path):
    r, shelf, root = random.Random(3), Shelf(spark), str(tmp_path / "followed")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma delta"), (3, "file7")], "query_id long, query string")
    text = lambda i: f"file{i} " + " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega!"]) for _ in range(r.randint(1, 60)))
    assert segments.load(spark, root) is None and segments.compact(spark, root) == 0 and segments.vacuum(spark, root) == 0
    for i in range(12):
        shelf.put(f"f{i:02d}", text(i), "2024-01-01")
    shelf.put("blank", " \n", "2024-01-01")
    first = shelf.update(root)
    assert (first.read, first.removed, first.kept) == (13, 0, 0) and len(shelf.read[-1]) == 13
    assert shelf.update(root) == segments.Update(0, 0, 13, first.chunks) and len(shelf.read) == 1
    steps = [
        (lambda: shelf.put("f03", text(3), "2024-02-01"), (1, 1, 12), ["f03"]),
        (lambda: [shelf.files.pop("f05"), shelf.put("f20", text(20), "2024-02-01"), shelf.put("f00", text(0), "2024-03-01")], (2, 2, 11), ["f00", "f20"]),
        (lambda: shelf.files.pop("f20"), (0, 1, 12), None),
    ]
    for change, counts, read in steps:
        change()
        done, reads = shelf.update(root), len(shelf.read)
        assert (done.read, done.removed, done.kept) == counts
        assert read is None or shelf.read[-1] == read
        assert len(shelf.read) == reads
    anew = str(tmp_path / "anew")
    shelf.update(anew)
    followed, built = segments.load(spark, root), segments.load(spark, anew)
    assert followed.totals == built.totals and followed.chunks.count() == done.chunks
    assert sorted(map(tuple, followed.term_df.collect())) == sorted(map(tuple, built.term_df.collect()))
    assert searched(spark, followed, queries) == searched(spark, built, queries)
    before, reads = searched(spark, followed, queries), len(shelf.read)
    assert segments.compact(spark, root) == done.chunks and len(shelf.read) == reads
    assert searched(spark, segments.load(spark, root), queries) == before
    assert segments.vacuum(spark, root) > 3 and searched(spark, segments.load(spark, root), queries) == before
    assert shelf.update(root).kept == 12
    # Nothing there: disabled, and kept all the same.
    files, shelf.files = shelf.files, {}
    assert shelf.update(root).kept == 12 and segments.load(spark, root) is None and segments.load(spark, root, disabled=True).chunks.count() == done.chunks
    shelf.files = files
    assert shelf.update(root).read == 0 and searched(spark, segments.load(spark, root), queries) == before
    # Other settings: all files again.
    again = shelf.update(root, config=RetrievalConfig(chunk_size=50))
    assert (again.read, again.removed, again.kept) == (12, 12, 0) and segments.load(spark, root).chunks.count() == again.chunks > done.chunks


def test_update_that_crashes_changes_nothing(spark, tmp_path, monkeypatch):
    shelf, root = Shelf(spark), str(tmp_path / "i")
    shelf.put("a", "alpha", "2024-01-01")
    shelf.update(root)
    shelf.put("a", "beta", "2024-02-01")

    def crash(*_):
        raise RuntimeError

    for step in ("write_tables", "_point_to"):
        monkeypatch.setattr(segments, step, crash)
        with pytest.raises(RuntimeError):
            shelf.update(root)
        monkeypatch.undo()
        assert [r.text for r in segments.load(spark, root).chunks.collect()] == ["alpha"]
    shelf.update(root)
    assert [r.text for r in segments.load(spark, root).chunks.collect()] == ["beta"]


# ---------------------------------------------------------------- streams


def test_listing_and_differences(tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name in ("a.txt", "b.MD", "c.pdf", "sub/d.docx", "sub/deep/e.doc"):
        (tmp_path / name).write_text(name)
    before = changes.listing(str(tmp_path))
    assert {os.path.relpath(p, tmp_path) for p in before} == {"a.txt", "b.MD", "sub/d.docx"}
    assert len(changes.listing(str(tmp_path), recursive=True)) == 4 and changes.listing(str(tmp_path / "none")) == {}
    (tmp_path / "a.txt").unlink()
    (tmp_path / "b.MD").write_text("longer")
    (tmp_path / "f.txt").write_text("")
    found = {(os.path.basename(p), c, n) for p, c, n, _ in changes.differences(before, changes.listing("file://" + str(tmp_path)))}
    assert found == {("a.txt", "removed", 5), ("b.MD", "changed", 6), ("f.txt", "added", 0)}


def wait_for(what, seconds=60):
    end = time.time() + seconds
    while not what():
        assert time.time() < end, "waited in vain"
        time.sleep(0.2)


def test_index_follows_a_directory(spark, tmp_path):
    root, kept, state = tmp_path / "kb", str(tmp_path / "index"), str(tmp_path / "state")
    root.mkdir()
    (root / "a.txt").write_text("alpha")
    (root / "b.txt").write_text("beta")
    told = []
    config = RetrievalConfig(debounce_ms=1500)
    start = lambda: refresh.follow(spark, str(root), kept, state, config=config, on_update=told.append)
    texts = lambda: sorted(r.text for r in segments.load(spark, kept).chunks.collect())
    q = start()
    try:
        wait_for(lambda: len(told) == 1)
        assert (told[0].read, told[0].removed) == (2, 0) and texts() == ["alpha", "beta"]
        for k in range(3):  # a burst
            (root / "a.txt").write_text("alpha" + " more" * (k + 1))
            time.sleep(0.4)
        wait_for(lambda: len(told) == 2)
        assert (told[1].read, told[1].removed, told[1].kept) == (1, 1, 1) and texts() == ["alpha more more more", "beta"]
        (root / "b.txt").unlink()
        wait_for(lambda: len(told) == 3)
        assert (told[2].read, told[2].removed) == (0, 1) and texts() == ["alpha more more more"]
    finally:
        q.stop()
    (root / "c.txt").write_text("while nobody looked")
    q = start()
    try:
        wait_for(lambda: len(told) == 4)
        assert (told[3].read, told[3].removed, told[3].kept) == (1, 0, 1) and texts() == ["alpha more more more", "while nobody looked"]
        time.sleep(3)
        assert len(told) == 4
    finally:
        q.stop()


def test_bursts_by_event_time_are_those_of_a_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"k{r.randint(0, 4)}", 1_700_000_000 + r.randint(0, 6000)) for _ in range(250)]
    r.shuffle(rows)
    for i in range(0, len(rows), 50):
        spark.createDataFrame(rows[i : i + 50], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    # Long after all others: they are over, and this one stays open.
    spark.createDataFrame([("z", 1_700_100_000)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    over = timers.bursts(spark, stream, "key", 60_000, "ts", "3 hours")
    q = over.writeStream.format("memory").queryName("over").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    batch = refresh.debounce(spark.read.parquet(str(tmp_path / "e")).where("key <> 'z'"), key="key", gap="60 seconds")
    expected = {(x.key, x.start.timestamp(), x.end.timestamp(), x.n_events) for x in batch.collect()}
    # A session window is open at its end, a burst closed: gaps of exactly a minute differ.
    got = {(x.key, x.first_ms / 1000, x.last_ms / 1000, x.n_events) for x in spark.table("over").collect()}
    exact = {k for k, _ in rows if any(b - a == 60 for a, b in zip(*(lambda t: (t, t[1:]))(sorted({s for x, s in rows if x == k})), strict=False))}
    assert {x for x in got if x[0] not in exact} == {x for x in expected if x[0] not in exact} and len(got) > 50


def test_progress_by_file(spark, tmp_path):
    root, kept, told = tmp_path / "kb", str(tmp_path / "index"), []
    root.mkdir()
    for i in range(6):
        (root / f"f{i}.txt").write_text(f"text {i}")
    (root / "broken.docx").write_bytes(b"no zip")
    (root / "empty.md").write_text(" ")
    done = refresh.update_directory(spark, str(root), kept, on_file=lambda n, total: told.append((n, total)))
    assert told[0] == (0, 8) and told[-1] == (8, 8) and told == sorted(set(told)) and done.read == 8
    assert {os.path.basename(r.path) for r in segments.silent_files(spark, kept).collect()} == {"broken.docx", "empty.md"}
    assert refresh.update_directory(spark, str(root), kept).read == 0


# ---------------------------------------------------------------- cache files


def test_cache_file_in_many_runs(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    rows = [(i * 7 % 501, f"s{i % 3}é", "ü" * r.randint(0, 300), [r.random() for _ in range(5)] if i % 10 else None) for i in range(501)]
    df = spark.createDataFrame(rows, "chunk_id long, source string, text string, vec array<double>").repartition(5)
    monkeypatch.setattr(cachefmt, "RECORDS", 64)
    path = str(tmp_path / "c.bin")
    assert cachefmt.write(df, path, 5, "sig") == 450
    # The same bytes as a record at a time in order.
    kept = [(s, t, v) for _, s, t, v in sorted(rows, key=lambda x: x[0]) if v]
    data = b"".join(cachefmt.encode(iter(kept), 450, 5, "sig"))
    assert open(path, "rb").read() == data and os.listdir(tmp_path) == ["c.bin"]
    back = cachefmt.read(spark, "file://" + path, 5, "sig")
    assert back.rdd.getNumPartitions() == 8
    got = sorted(back.collect(), key=lambda x: x.chunk_id)
    assert [(x.chunk_id, x.source, x.text) for x in got] == [(i, s, t) for i, (s, t, _) in enumerate(kept)]
    assert all(np.allclose(x.vec, v, atol=1e-6) for x, (_, _, v) in zip(got, kept, strict=True))
    assert all(x.vec is None for x in cachefmt.read(spark, path, with_vectors=False).collect())
    for bad in (b"XXXX" + data[4:], data[:-1], data[: len(data) // 2], data[:12] + b"\xff" * 4 + data[16:]):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(Exception, match="not a cache|ends early|out of bounds"):
            cachefmt.read(spark, str(tmp_path / "bad.bin")).collect()
    for wrong in ({"dimension": 4}, {"signature": "other"}):
        with pytest.raises(Exception, match="dimension|other files"):
            cachefmt.read(spark, path, **wrong).collect()
    with pytest.raises(cachefmt.CacheError):
        cachefmt.write(df.where("chunk_id < 0"), str(tmp_path / "none.bin"), 5, "sig")
    with pytest.raises(cachefmt.CacheError):
        cachefmt.write(df, str(tmp_path / "none.bin"), 4, "sig")
    assert sorted(os.listdir(tmp_path)) == ["bad.bin", "c.bin"]


def test_vectors_of_a_cache_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(ids: pd.Series) -> pd.Series:
        seen.add(len(ids))
        return pd.Series([[float(i), 1.0] for i in ids])

    chunks = spark.range(40).select(F.col("id").alias("chunk_id"), F.lit("s").alias("source"), F.lit("t").alias("text"), embed("id").alias("vec"))
    assert cachefmt.write(chunks, str(tmp_path / "c.bin"), 2, "sig") == 40 == seen.value


def test_more_chunks_than_one_cache_file_may_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cachefmt, "RECORDS", 8)
    monkeypatch.setattr(cachefmt, "MOST_CHUNKS", 21)
    rows = [(i, f"s{i % 3}é", "ü" * (i % 7), [float(i), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "chunk_id long, source string, text string, vec array<double>").repartition(3)
    with pytest.raises(cachefmt.CacheError):
        cachefmt.write(df, str(tmp_path / "one.bin"), 2, "sig")
    assert cachefmt.write(df.where("chunk_id < 21"), str(tmp_path / "full.bin"), 2, "sig") == 21
    path = str(tmp_path / "all")
    assert cachefmt.write_files(df, path, 2, "sig") == 50
    # Each file is a cache that any reader of the format takes.
    files = [list(cachefmt.decode((tmp_path / "all" / name).read_bytes(), 2, "sig")) for name in sorted(os.listdir(path))]
    assert [len(f) for f in files] == [16, 16, 16, 2] and sum(files, []) == [tuple(r[1:]) for r in rows]
    assert sorted(map(tuple, cachefmt.read(spark, path, 2, "sig").collect())) == rows
    with pytest.raises(cachefmt.CacheError):
        cachefmt.write_files(df.where("false"), str(tmp_path / "none"), 2, "sig")
    assert sorted(os.listdir(tmp_path)) == ["all", "full.bin"]


# ---------------------------------------------------------------- vectors with bounds


def test_pivoted_search_is_exact_and_leaves_groups_out(spark, tmp_path):
    r = np.random.Generator(np.random.PCG64(3))
    centres = r.normal(size=(20, 12))
    rows = [(i, (centres[i % 20] + r.normal(size=12) * 0.05).tolist()) for i in range(600)] + [(600 + i, centres[0].tolist()) for i in range(30)]
    rows += [(700, None), (701, []), (702, [0.0] * 12)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vec array<double>").repartition(3)
    asked = spark.createDataFrame([(i, rows[i * 37][1]) for i in range(15)] + [(90, r.normal(size=12).tolist()), (91, None), (92, [0.0] * 12)], "query_id long, vec array<double>")
    for k in (1, 4, 50, 700):
        folder = str(tmp_path / f"v{k}")
        vector.write_pivoted(chunks, folder, pivots=25, sample=300)
        stored = vector.Pivoted(spark, folder)
        assert sorted(map(tuple, stored.topk(asked, k).collect())) == sorted(map(tuple, vector.cosine_topk(chunks, asked, k).collect()))
        assert k > 4 or stored.compared < 0.5 * stored.pairs
    vector.write_pivoted(chunks, str(tmp_path / "one"))
    stored = vector.Pivoted(spark, str(tmp_path / "one"))
    plan = stored.topk(asked.where("query_id = 3"), 2)._jdf.queryExecution().executedPlan().toString()
    # The first groups are enough: nothing else is scanned.
    assert "FileScan" not in plan and stored.read == vector.FIRST_GROUPS < stored.groups
    vector.write_pivoted(chunks.limit(0), str(tmp_path / "none"))
    assert vector.Pivoted(spark, str(tmp_path / "none")).topk(asked, 2).collect() == []


def test_live_prompts_are_those_of_all_turns(spark, tmp_path):
    r = random.Random(11)
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else r.choice(["user", "assistant"]), " ".join(["word"] * r.choice([0, 3, 10, 60, 200]))) for c in range(12) for t in range(r.randint(1, 14))]
    late = rows[:]
    r.shuffle(late)
    config, path, got = RetrievalConfig(n_ctx=150, max_tokens=20), str(tmp_path / "turns"), {}
    schema = "conv_id long, turn long, role string, text string"

    def keep(batch, _):
        for x in batch.collect():
            assert x.conv_id not in got or got[x.conv_id].n_seen < x.n_seen
            got[x.conv_id] = x

    for part in (late[: len(late) // 2], late[len(late) // 2 :]):
        for i in range(0, len(part), 12):
            spark.createDataFrame(part[i : i + 12], schema).coalesce(1).write.mode("append").parquet(path)
        # A new query that goes on from the checkpoint of the one before.
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = dialogues.live_prompts(spark, stream, config).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    expected = dialogue.prompts(spark.createDataFrame(rows, schema), config).collect()
    assert {k: (x.n_kept, x.prompt) for k, x in got.items()} == {x.conv_id: (x.n_kept, x.prompt) for x in expected}
    assert any(x.n_kept < x.n_seen for x in got.values())


# ---------------------------------------------------------------- command line


def test_command_line(spark, tmp_path, capsys):
    import json

    from sedgewren.__main__ import main

    root, kept = tmp_path / "kb", str(tmp_path / "index")
    root.mkdir()
    (root / "a.txt").write_text("alpha beta!gamma")
    (root / "b.txt").write_text("delta")
    assert main(["search", kept, "alpha"]) == 2 and main(["evaluate", kept, str(tmp_path / "q.json")]) == 2
    capsys.readouterr()
    assert main(["update", str(root), kept]) == 0
    assert json.loads(capsys.readouterr().out) == {"read": 2, "removed": 0, "kept": 0, "chunks": 2}
    assert main(["search", kept, "alpha", "--top-k", "1"]) == 0
    assert [json.loads(x)["source"] for x in capsys.readouterr().out.splitlines()] == ["a.txt"]
    assert main(["inspect", kept, "--keyword", "delta"]) == 0
    assert "# totals" in (out := capsys.readouterr().out) and '{"source":"b.txt","n":1}' in out
    for keyword, code in (("beta", 0), ("nowhere", 1)):
        (tmp_path / "q.json").write_text(json.dumps({"questions": [{"q": "alpha", "expect_sources": ["a.txt"], "expect_keywords": [keyword], "must": True}]}))
        assert main(["evaluate", kept, str(tmp_path / "q.json")]) == code
    capsys.readouterr()
    assert main(["threads", str(tmp_path / "s.ini"), "one", "two", "--threads", "1", "2"]) == 0
    assert set(json.loads(capsys.readouterr().out)) == {"1", "2"}
