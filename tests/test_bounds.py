"""What a step holds or moves stays bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sedgewren.operators.topk import Held


def test_prefill_takes_the_terms_out_once(spark, sf):
    from sedgewren.plans.catalog import prefill_slices

    plan = prefill_slices(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # Two ways to take the terms of a text out, and neither of them for each slice.
    assert plan.count("regexp_extract_all") == 2


def test_packages_are_opened_a_few_at_a_time():
    from sedgewren.sources.kb import docx_xml

    out = list(docx_xml.func(iter([pa.array([b"x" * 100] * 1000), pa.array([b"y" * 900_000] * 5), pa.array([], pa.binary())])))
    assert sum(map(len, out)) == 1005 and max(map(len, out)) <= 256 and len(out[-1]) == 1


def test_held_hits_are_the_best_and_take_little_memory():
    rng = np.random.default_rng(1)
    score, ids = np.round(rng.random((256, 8192)), 2), rng.permutation(8192)
    held = Held(np.arange(256), 3)
    tracemalloc.start()
    for a in range(0, 8192, 2048):
        held.add(score[:, a : a + 2048], ids[a : a + 2048])
    held.add(score - 1, ids + 8192)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for row in range(256):
        best = np.lexsort((ids, -score[row]))[:3]
        assert sorted(zip(-held.found[0][row], held.found[1][row], strict=True)) == sorted(zip(-score[row][best], ids[best], strict=True))
    assert peak < 50 << 20


def test_texts_and_not_their_terms_are_dealt_out(spark, sf):
    from sedgewren.plans.catalog import bm25_scores, term_frequency

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [chunk_id" in plan(term_frequency(spark, sf))
    assert "Aggregate [query_id" not in plan(bm25_scores(spark, sf))


def test_the_length_of_a_vector_is_worked_out_once(spark):
    from pyspark.sql import functions as F

    from sedgewren.functions.vectors import l2_normalize

    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None)], "id long, v array<double>").select("id", l2_normalize(F.col("v")).alias("u"))
    assert "/ sqrt(" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.id: r.u for r in rows.collect()} == {1: [0.6, 0.8], 2: None, 3: None, 4: None}


def test_hybrid_search_runs_once_and_moves_pairs_but_not_their_terms(spark, sf):
    from sedgewren.operators import index, lexical
    from sedgewren.plans.catalog import grounded_prompts, hybrid_context

    for query in (hybrid_context, grounded_prompts):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
    texts = ["a b a c", "", "A zz b b", None, "d", "c 中文 c c"]
    some = index.build(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "q", "a a b 中"])], "query_id long, query string")
    scores = lambda df: {(r.query_id, r.chunk_id): round(r.score, 9) for r in df.collect()}
    pairs = asked.select("query_id").crossJoin(some.chunks.select("chunk_id"))
    found = lexical.bm25_scores(some, asked, within=pairs)
    assert scores(found) == scores(lexical.bm25_scores(some, asked)) and len(scores(found)) > 10
    assert "term" not in " ".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "chunk_id" in x)


def test_segments_are_written_and_read_one_at_a_time(spark):
    from pyspark.sql import functions as F
    from pyarrow import parquet

    from sedgewren.llm.postings import build_index

    docs = spark.range(0, 6, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), "id", F.lit(" and others ")), 500_000).alias("text"))
    (path,) = build_index(docs).inputFiles()
    written = parquet.ParquetFile(path.removeprefix("file://")).metadata
    assert written.num_rows == 6
    # A row group is what a writer holds and what a reader decodes at once: before, all segments of a task were in one.
    assert max(written.row_group(i).total_byte_size for i in range(written.num_row_groups)) < 16 << 20


def test_words_and_their_keys_are_never_broadcast(spark):
    from sedgewren.llm.variants import near_pairs, variant_forms

    words = spark.createDataFrame([("hello" + "abc"[i % 3] * (i // 3 + 1), i + 1) for i in range(30)], "word string, n long")
    for found in (near_pairs(words), variant_forms(words)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_posting_blocks_are_made_a_few_ranges_at_a_time(spark, monkeypatch):
    from collections import Counter, defaultdict

    from sedgewren.operators import index

    monkeypatch.setattr(index, "RANGES_WRITTEN", 2)
    rng = np.random.default_rng(3)
    rows = [(i - i % 5 // 4, i // 7, [f"t{x}" for x in rng.integers(0, 9, rng.integers(0, 12))]) for i in range(60)] + [(60, 8, None)]
    batches = [pa.RecordBatch.from_pylist([{"chunk_id": c, "range": r, "dl": len(t or []), "terms": t} for c, r, t in rows[a : a + 11]], pa.schema([("chunk_id", pa.int64()), ("range", pa.int64()), ("dl", pa.int64()), ("terms", pa.list_(pa.string()))])) for a in range(0, len(rows), 11)]
    want = defaultdict(Counter)
    for c, r, t in rows:
        for term in t or []:
            want[term, r][c, len(t)] += 1
    out = list(index._blocks(iter(batches)))
    got = {(x["term"], x["range"]): x for b in out for x in b.to_pylist()}
    assert max(len(set(b["range"].to_pylist())) for b in out) == 2 and sum(b.num_rows for b in out) == len(got) == len(want)
    for key, held in want.items():
        postings = [{"chunk_id": c, "tf": n, "dl": dl} for (c, dl), n in sorted(held.items())]
        assert got[key]["postings"] == postings
        assert (got[key]["n"], got[key]["max_tf"], got[key]["min_dl"]) == (len(held), max(held.values()), min(dl for _, dl in held))
    assert list(index._blocks(iter([]))) == []
