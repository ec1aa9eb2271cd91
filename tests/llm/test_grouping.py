"""Conversation repair, near vectors and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewren.llm import lattice
from sedgewren.llm.lattice import near_vectors, nearest_e8
from sedgewren.llm.turns import damaged, repair_conversations, with_missing
from sedgewren.llm.variants import count_words, near_pairs, variant_forms

# ---------------------------------------------------------------- conversations

TURNS = "conv_id long, turn long, role string, text string, part string, block string, place string, blank string, n string, c string"


def turns_of(n_conversations: int, longest: int, seed: int) -> list[tuple]:
    r, rows = random.Random(seed), []
    texts = ["Hello there.", "Yes!", "why?", "cut off", "", " \n", "Same.", None, "a.b!c?", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "superuser"]
    for c in range(n_conversations):
        for t in range(r.randint(1, longest)):
            row = (c, r.choice([t, t, t, t + 3, None]), r.choice(roles[: r.choice([4, 5, 9])]), r.choice(texts))
            rows += [row] * r.choice([1, 1, 1, 1, 2])
    return [*rows, (None, None, None, None), (None, 1, "user", "who?"), (None, 2, "assistant", "me.")]


def damage_of(rows):
    spaced = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def repaired_of(rows: list[tuple[str, str]]) -> tuple[int, str, str, Counter]:
    """Cost, audit, hash and counts of one conversation, by trying every edit with whole audits."""
    seen, faults, counts = set(), [], Counter()
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @lru_cache(None)
    def best(i: int, state: str, inserts: int) -> tuple[int, str]:
        ways = [(0, "")] if i == len(rows) and state in "ea" else []
        follow = {"e": "sua", "s": "u", "u": "a", "a": "u"}[state].replace("a" if state == "e" else "-", "")
        if inserts < 2:
            for new in follow.replace("s", ""):
                cost, audit = best(i, new, inserts + 1)
                ways.append((cost + 3, "I" + audit))
        if i < len(rows):
            cost, audit = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for new in follow:
                    cost, audit = best(i + 1, new, 0)
                    if rows[i][0][:1] == new:
                        ways.append((cost + extra, "K" + audit))
                    if new != "s":
                        ways.append((cost + extra + 3, "R" + audit))
        return min(ways, default=(10**9, ""))

    cost, audit = best(0, "e", 0)
    i, out, opened = 0, [], False
    for e in audit:
        place = len(out) - opened
        name = ("user", "assistant")[place % 2]
        if e == "K":
            opened |= not out and rows[i][0][:1] == "s"
            out.append(f"{rows[i][0]}:{rows[i][1]}")
        elif e == "R":
            out.append(f"{name}:{rows[i][1]}")
        elif e == "I":
            out.append(f"{name}:")
        i += e != "I"
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), counts


def expected_repairs(rows, damage=True):
    by = defaultdict(list)
    for conv, turn, role, text in damage_of(rows) if damage else rows:
        by[conv].append((turn, role, text))
    for conv in {r[0] for r in rows}:
        mine = sorted(by[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        cost, audit, digest, n = repaired_of([x[1:] for x in mine])
        known = [x[0] for x in mine if x[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        yield conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, digest


@pytest.mark.parametrize("block_rows", [2, 7, 8192])
def test_repair(spark, block_rows):
    rows = turns_of(60, 9, 3) + [(1000, t, ("user", "assistant", "user", "system")[t % 4], f"turn {t}" + "." * (t % 3)) for t in range(150)]
    df = spark.createDataFrame([(*r, *["-"] * 6) for r in rows], TURNS).repartition(3)
    got = with_missing(repair_conversations(damaged(df), block_rows=block_rows), df).collect()
    assert Counter(map(tuple, got)) == Counter(expected_repairs(rows))


def test_repair_of_nothing_and_of_dropped_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert with_missing(repair_conversations(damaged(empty)), empty).collect() == []
    dropped = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, 0, "user", "Hi.") for c in dropped], "conv_id long, turn long, role string, text string")
    rows = with_missing(repair_conversations(damaged(df)), df).collect()
    assert sorted(map(tuple, rows)) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in dropped]


# ---------------------------------------------------------------- vectors


def brute_links(vectors: list, threshold: float):
    usable = [i for i, (_, v) in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(vectors), list(range(len(vectors)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = {i: np.array(vectors[i][1]) / np.linalg.norm(vectors[i][1]) for i in usable}
    for k, i in enumerate(usable):
        for j in usable[k + 1 :]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (v, _) in enumerate(vectors):
        ids[find(i)].append(v)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((v, links[i], least[find(i)], v == least[find(i)]) for i, (v, _) in enumerate(vectors))


def odd_vectors(seed: int = 5) -> list:
    r = np.random.Generator(np.random.PCG64(seed))
    unit = lambda x: x / np.linalg.norm(x)
    base = [unit(r.normal(size=16)) for _ in range(40)]
    vectors = [(i, list(map(float, b))) for i, b in enumerate(base)]
    tight, loose = base[0], base[1]
    vectors += [(100 + i, list(map(float, tight + r.normal(size=16) * 0.02))) for i in range(150)]
    vectors += [(400 + i, list(map(float, loose + r.normal(size=16) * 0.055))) for i in range(120)]
    vectors += [(600 + i, list(map(float, 3 * base[2]))) for i in range(50)] + [(700, list(map(float, base[2])))]
    vectors += [(800, None), (801, []), (802, [0.0] * 16), (803, [1.0, None]), (804, [float("nan")] * 16), (805, [float("inf")] + [0.0] * 15)]
    vectors += [(806, [1e300] * 16), (807, [2e300] * 16), (808, [1e-310] * 16), (809, [1.0, 2.0]), (809, [1.0, 2.001]), (None, [1.0, 2.0]), (None, None), (None, [-5.0, 1.0, 0.0])]
    return vectors


@pytest.mark.parametrize(("ball_least", "block"), [(4, 16), (32, 1024), (10**9, 64)])
def test_near_vectors(spark, monkeypatch, ball_least, block):
    monkeypatch.setattr(lattice, "BALL_LEAST", ball_least)
    monkeypatch.setattr(lattice, "BLOCK", block)
    vectors = odd_vectors()
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in vectors], "vec_id long, embedding array<double>, node string, ball string, home string").repartition(4)
    # More tables than by default, so that no link near the threshold is missed.
    got = Counter(map(tuple, near_vectors(df, tables=16, probes=24).collect()))
    with np.errstate(over="ignore", under="ignore"):
        expected = brute_links([(i, list(np.array(v) / max(map(abs, v))) if i in (806, 807, 808) else v) for i, v in vectors], 0.95)
    assert got == expected


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of cosines from 0.95 to 0.96 only, all compared by brute force."""
    r = np.random.Generator(np.random.PCG64(9))
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = r.normal(size=a.shape)
    o -= (o * a).sum(axis=1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    c = np.linspace(0.9501, 0.96, len(a))[:, None]
    b = c * a + np.sqrt(1 - c * c) * o
    rows = [(2 * i, x.tolist()) for i, x in enumerate(a)] + [(2 * i + 1, x.tolist()) for i, x in enumerate(b)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(x.n_links for x in got) / len(rows) > 0.99
    assert all(x.component_id in (x.vec_id, x.vec_id - 1) for x in got)


def test_lattice_points_are_the_nearest():
    r = np.random.Generator(np.random.PCG64(2))
    x = r.normal(size=(300, 8)) * 2
    p = nearest_e8(x)
    whole = np.all(p == np.rint(p), axis=1)
    assert np.all(np.all(p - 0.5 == np.rint(p - 0.5), axis=1) | whole) and np.all(p.sum(axis=1) % 2 == 0)
    around = lattice._shortest()
    assert len(around) == 240 and np.allclose((around**2).sum(axis=1), 2) and len({tuple(v) for v in around}) == 240
    off = ((x - p) ** 2).sum(axis=1)
    assert np.all(off[:, None] <= ((x[:, None, :] - p[:, None, :] - around[None]) ** 2).sum(axis=2) + 1e-12)


# ---------------------------------------------------------------- words


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(counts: dict[str, int]):
    near = {w: sorted((x for x in counts if one_edit(w, x)), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: x[0] if x and counts[x[0]] >= 5 * counts[w] else None for w, x in near.items()}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None


def test_variants(spark, odd):
    r = random.Random(4)
    words = ["".join(r.choice("abéz") for _ in range(r.randint(6, 9))) for _ in range(150)]
    words += ["aaaaaa" + "b" * k for k in range(6)] + ["Chainé", "chainé", "CHAINe", "chainee", "chaineee", "ÿÿÿÿÿÿ", "À×÷ÀÀÀ", "short"]
    texts = [" ".join(r.choice(words[: r.choice([10, 60, 400])]) for _ in range(80)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, None), (6, ""), (7, "x" * 300_000 + " " + texts[1]), (7, texts[2]), (7, texts[2])]
    df = spark.createDataFrame([(i, t, "n", "m", "k") for i, t in rows], "doc_id long, text string, word string, n string, key string").repartition(3)
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            low = low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low
            counts[low] += len(low) >= 6
    counts = {w: n for w, n in counts.items() if n >= 5}
    found = count_words(df)
    assert {x.word: x.n for x in found.collect()} == counts
    assert Counter(map(tuple, variant_forms(found).collect())) == Counter(variants_of(counts))
    assert variant_forms(count_words(odd.limit(0))).collect() == []


def test_near_pairs_of_random_words(spark):
    r = random.Random(8)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(700)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    expected = {(a, b) if (len(a), a) < (len(b), b) else (b, a) for k, a in enumerate(words) for b in words[k + 1 :] if one_edit(a, b)}
    got = [(x.a, x.b) for x in near_pairs(df.select("word", F.col("n"))).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
