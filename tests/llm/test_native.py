"""Sharding, mixing, exact dedup and line dedup: brute force on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sedgewren.llm import exact, registry
from sedgewren.llm.exact import DigestIndex, exact_groups
from sedgewren.llm.histogram import thresholds
from sedgewren.llm.lines import dedup_chunks, dedup_runs
from sedgewren.llm.mixing import mix, mix_keys, source_targets
from sedgewren.llm.q_mixing import mixed
from sedgewren.llm.q_sharding import shards
from sedgewren.llm.sharding import histogram_shards, shard_keys


@pytest.mark.parametrize("name", registry.ORACLES)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    df = registry.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert Counter(plain(r) for r in found.fetchall()) == Counter(plain(r[c] for c in columns) for r in df.collect())


def sizes(rows):
    return [len((r.text or "").encode()) for r in rows]


def test_thresholds_are_the_nearest_rows(spark):
    rows = [("g" if i % 3 else "h", (i * 7919) % (1 << 20) << 40, 0, i, i % 11) for i in range(500)] + [("hot", 5, 6, i, 2) for i in range(300)]
    keys = spark.createDataFrame(rows, "grp string, a long, b long, c long, weight long")
    wanted = [("g", t, 100.0 * t) for t in range(1, 9)] + [("h", 1, 0.0), ("h", 2, 1e9), ("hot", 1, 301.0), ("hot", 2, 333.4)]
    targets = spark.createDataFrame([(*w, 0.0) for w in wanted], "grp string, t long, target double, tolerance double")
    got = {(r.grp, r.t): r for r in thresholds(keys, targets).collect()}
    assert len(got) == len(wanted)
    for grp, t, target in wanted:
        mine = sorted((r for r in rows if r[0] == grp), key=lambda r: r[1:4])
        r = got[grp, t]
        under = sum(x[4] for x in mine if x[1:4] < (r.a, r.b, r.c) or (r.inclusive and x[1:4] == (r.a, r.b, r.c)))
        sums = [0]
        for x in mine:
            sums.append(sums[-1] + x[4])
        assert abs(under - min(target, sums[-1])) == min(abs(s - min(target, sums[-1])) for s in sums)


@pytest.mark.parametrize("law", ["bytes", "rows"])
@pytest.mark.parametrize("n", [1, 4, 40])
def test_shards(odd, law, n):
    rows = histogram_shards(shard_keys(odd), n, law).collect()
    assert Counter((r.id, r["size"], r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    if law == "rows":
        counts = [len(by[k]) for k in range(n)]
        assert max(counts) - min(counts) <= 1
    else:
        largest, total, upto = max(r["size"] for r in rows), sum(r["size"] for r in rows), 0
        for k in range(n):
            upto += sum(r["size"] for r in by[k])
            assert abs(upto - total * (k + 1) / n) <= largest / 2 + 1


def test_equal_texts_share_neighbouring_shards_and_hot_texts_are_ranked_apart(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = histogram_shards(shard_keys(docs), 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    keys = [(r.a, r.b, r.c) for r in order]
    assert keys == sorted(keys)
    totals = [sum(r["size"] for r in rows if r.shard == k) for k in range(8)]
    assert max(totals) - min(totals) <= 2 * max(r["size"] for r in rows)


def test_very_many_equal_rows_are_ranked_apart(spark):
    docs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    docs = docs.unionByName(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("hot").alias("text")))
    rows = histogram_shards(shard_keys(docs), 8, "rows").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 12_000 and all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} == {1500}
    keys = [(r.a, r.b, r.c) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert keys == sorted(keys)


def test_tolerance_stops_early(odd):
    rows = histogram_shards(shard_keys(odd), 4, "rows", tolerance=0.2).collect()
    counts = Counter(r.shard for r in rows)
    assert sum(counts.values()) == odd.count() and max(counts.values()) - min(counts.values()) <= 0.4 * odd.count() / 4 + 2


def test_nothing_to_shard(nothing):
    assert shards(nothing).collect() == [] and mixed(nothing).collect() == [] and exact_groups(nothing).collect() == [] and dedup_chunks(nothing).collect() == []


def fill(sizes_by_source, weights, share, most):
    """Targets by handing out the rest again and again."""
    order = sorted(sizes_by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), share * sum(sizes_by_source.values()), set(order)
    while rest > 1e-9 and open_:
        total, given = sum(weight[s] for s in open_), rest
        rest = 0.0
        for s in list(open_):
            target[s] += given * weight[s] / total
            if target[s] > most * sizes_by_source[s]:
                rest += target[s] - most * sizes_by_source[s]
                target[s] = float(most * sizes_by_source[s])
                open_.remove(s)
    return target


@pytest.mark.parametrize(("weights", "share", "most"), [((5, 2, 1), 1.5, 2), ((1,), 0.3, 1), ((1, 9), 2.5, 3)])
def test_mix(odd, weights, share, most):
    keys = mix_keys(odd)
    rows = mix(keys, source_targets(keys, weights, share, most)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given = odd.collect()
    assert Counter((r.id, r.source, r["size"]) for r in rows) == Counter((r.doc_id, r.source, count(r.text)) for r in given)
    by = defaultdict(int)
    for r in given:
        by[r.source] += count(r.text)
    expected = fill(by, weights, share, most)
    for s, target in expected.items():
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == by[s] and r.target == pytest.approx(target) and r.taken <= most * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r["size"] for r in mine) / 2 + 1e-6
        assert max(r.passes for r in mine if r["size"]) - min(r.passes for r in mine if r["size"]) <= 1 if by[s] else True
    again = mix(k2 := mix_keys(odd.repartition(7)), source_targets(k2, weights, share, most)).collect()
    assert Counter((r.id, r.source, r.taken) for r in rows) == Counter((r.id, r.source, r.taken) for r in again)


def test_a_smaller_mix_is_part_of_a_larger_one(odd):
    keys = mix_keys(odd)
    small, large = ({(r.id, r.source, r["size"]): r.passes for r in mix(keys, source_targets(keys, (1,), share, 1)).collect()} for share in (0.2, 0.7))
    assert all(large[k] >= v for k, v in small.items())


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "colliding"])
def test_exact_groups(odd, digest):
    rows = exact_groups(odd, digest=digest).collect()
    given = odd.collect()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in given:
        groups[normal(r.text)].append(r.doc_id)
    expected = Counter()
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        expected.update((i, keep, len(ids)) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == expected
    assert sum(r.kept for r in rows) == len(groups) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    if digest is exact.sha256:
        assert {r.digest for r in rows} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_index_of_several_runs(spark):
    """Seven memtables: three levels of runs, digests that occur again are known when they arrive."""
    batches = [[("x", 5), ("y", 2)], [("x", 3), ("z", None)], [("x", 9), ("q", 1), ("q", 0)], [("r", 7)], [("y", 1)], [("z", 4), ("s", 8)], [("t", 6)]]
    index, again, row = DigestIndex(), [], 0
    for b in batches:
        rows = [(d, i, row + k) for k, (d, i) in enumerate(b)]
        row += len(b)
        again.append({r.digest for r in index.flush(spark.createDataFrame(rows, "digest string, doc_id long, row long")).collect()})
    assert again == [set(), {"x"}, {"x", "q"}, set(), {"y"}, {"z"}, set()]
    assert [r.level for r in index.runs] == [2, 1, 0]
    expected = {("x", 3, 3), ("y", 1, 2), ("z", 4, 2), ("q", 0, 2), ("r", 7, 1), ("s", 8, 1), ("t", 6, 1)}
    asked = spark.createDataFrame([("x",), ("absent",), ("z",), ("x",)], "digest string")
    assert {r.digest for r in index.probe(asked).collect()} == {"x", "z"}
    distinct = spark.createDataFrame([(k,) for k in "xzt"], "digest string")
    assert {(r.digest, r.keep.id, r.n) for r in index.read(distinct).collect()} == {e for e in expected if e[0] in "xzt"}
    assert {(r.digest, r.keep.id, r.n) for r in index.compact().collect()} == expected and len(index.runs) == 1


def test_runs_are_merged_without_an_exchange(spark):
    index = DigestIndex()
    for k in range(2):
        index.runs.append(index._stored(spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.struct(F.lit(False).alias("no_id"), F.col("id"), (F.col("id") + 1000 * k).alias("row")).alias("keep"), F.lit(1).cast("long").alias("n")), 0))
    a, b = (r.rows.select("digest", F.col("n").alias(f"n{k}")) for k, r in enumerate(index.runs))
    plan = a.join(b, "digest", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index._merge_last()
    assert index.runs[0].rows.where("n = 2").count() == 100


def test_exact_groups_of_several_memtables(spark, odd):
    few, many = (Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in exact_groups(odd, memtable_rows=n).collect()) for n in (1 << 30, 17))
    assert few == many


def test_scope_deletes_what_is_not_kept(spark):
    from pathlib import Path

    from sedgewren.llm import common

    before = list(common._written)
    with common.scope(spark) as keep:
        common.materialise(spark.range(3), "one")
        kept = common.materialise(spark.range(4), "two")
        keep()
        common.bucketed(spark.range(5), "three", "id")
        paths = [Path(p.removeprefix("file://")) for p in common._written[len(before) :]]
        assert len(paths) == 3 and all(p.exists() for p in paths)
    assert [p.exists() for p in paths] == [False, True, False] and kept.count() == 4
    assert common._written[:-1] == before and common._written[-1].removeprefix("file://") == str(paths[1])


def test_bitmap_filter_never_misses(spark):
    have = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("k"))
    passed = {r.k for r in exact.may_contain(spark.range(4000).select(F.col("id").cast("string").alias("k")), "k", exact.bitmap_filter(have, "k")).collect()}
    assert passed >= {str(i) for i in range(0, 4000, 2)} and len(passed) < 2100


def brute_lines(rows):
    """Chunks, and which of them go, step by step."""
    docs = {}
    for r in rows:
        lines = (r.text or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        chunks, start = [], 0
        for i in range(len(lines)):
            before = h[i - 1] if i else 0
            if i == len(lines) - 1 or (before % 2147483647 * 1000003 + h[i]) % 2147483647 % 4 == 0:
                chunks.append((start, lines[start : i + 1]))
                start = i + 1
        docs[r.doc_id, r.text] = chunks
    first = {}
    order = lambda k: (k[0] is None, k[0] or 0, hashlib.md5((k[1] or "").encode()).hexdigest())
    seen = Counter(tuple(c) for r in rows for _, c in docs[r.doc_id, r.text])
    for k in sorted(docs, key=order):
        for start, c in docs[k]:
            first.setdefault(tuple(c), (k, start))
    out = []
    for r in rows:
        k = (r.doc_id, r.text)
        gone = [c for s, c in docs[k] if len(c) > 1 and "\n".join(c).strip(" \t\n\v\f\r") and seen[tuple(c)] > 1 and first[tuple(c)] != (k, s)]
        kept = ["\n".join(c) for s, c in docs[k] if not (len(c) > 1 and "\n".join(c).strip(" \t\n\v\f\r") and seen[tuple(c)] > 1 and first[tuple(c)] != (k, s))]
        out.append((r.doc_id, None if r.text is None else "\n".join(kept), sum(map(len, gone)), len(gone)))
    return Counter(out)


def test_lines(spark, odd):
    shared = "\n".join(f"shared line {i}" for i in range(30))
    rows = [(1000 + i, f"head {i}\n" * (i % 3) + shared + f"\ntail {i}\n\n\n\n", "en", "s") for i in range(12)] + [(1000, "head\n" + shared, "en", "s"), (None, shared, "en", "s")]
    docs = odd.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, size string"))
    got = Counter((r.doc_id, r.text, r.n_removed, r.n_chunks_removed) for r in dedup_chunks(docs).collect())
    assert got == brute_lines(docs.collect())
    assert sum(n for k, n in got.items() if k[3]) >= 12


def brute_runs(rows):
    """Pairs of lines in the order of their places, and which lines go, step by step."""
    docs = {(r.doc_id, r.text): (r.text or "").split("\n") for r in rows}
    first, gone = {}, defaultdict(set)
    for k in sorted(docs, key=lambda k: (k[0] is None, k[0] or 0, hashlib.md5((k[1] or "").encode()).hexdigest())):
        for i, pair in enumerate(zip(docs[k], docs[k][1:])):
            if "".join(pair).strip(" \t\n\v\f\r"):
                earlier = first.setdefault(pair, (k, i))
                if earlier not in ((k, i), (k, i - 1)):
                    gone[k] |= {i, i + 1}
    out = []
    for r in rows:
        k = (r.doc_id, r.text)
        left = "\n".join(x for i, x in enumerate(docs[k]) if i not in gone[k])
        out.append((r.doc_id, None if r.text is None else left, len(gone[k]), sum(i - 1 not in gone[k] for i in gone[k])))
    return Counter(out)


def test_runs(spark, odd):
    shared = "\n".join(f"shared line {i}" for i in range(30))
    rows = [(1000 + i, f"head {i}\n" * (i % 3) + shared + f"\ntail {i}\n\n\n \t\n") for i in range(12)] + [(1000, "head\n" + shared), (None, shared), (1001, None)]
    # A repeated run of two lines, wherever it lies, and nothing else; blank lines and a line by itself stay.
    rows += [(2000 + i, "\n".join([f"own {i} {k}" for k in range(i)] + ["first of two", "second of two"] + [f"after {i}", "alone", f"more {i}"])) for i in range(20)]
    rows += [(3000, "a\na\na"), (3001, "b\nb\nb\nb"), (3002, "c\nd\nc\nd\nc")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    made = dedup_runs(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_removed, r.n_runs_removed) for r in made) == brute_runs(docs.collect())
    by = {r.doc_id: r for r in made if r.doc_id is not None and r.doc_id >= 2000}
    for i in range(1, 20):
        assert by[2000 + i].text.split("\n") == [f"own {i} {k}" for k in range(i)] + [f"after {i}", "alone", f"more {i}"] and by[2000 + i].n_runs_removed == 1
    assert (by[2000].n_removed, by[3000].text, by[3001].text, by[3002].text) == (0, "a\na\na", "b\nb", "c\nd")


def test_runs_of_no_rows(nothing):
    assert dedup_runs(nothing).collect() == []
