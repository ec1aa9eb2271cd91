"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

Words are numbered by the order of their 64-bit hashes. Map tasks count what they read in sorted arrays and send
slices of them; reduce tasks merge the slices of a key range and write sorted arrays into the shared folder, which
every worker maps: the operating system keeps in memory what is looked up, and nothing is loaded whole. Training and
scoring move arrays, never a row per token. All words and all bigrams count; nothing is pruned. The continuations of a
word that occurs more than HOT_TOKENS times are divided by ranges of the word that follows, each a part of its own, so
that no part has to hold all that follows a common word.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import LOWER, NON_SPACE, blocks, column_bytes, fresh_path, word_hashes, word_spans

#: Text bytes for each key range of the vocabulary, tokens for each of the bigrams; the least and the most ranges.
PART_BYTES, PART_TOKENS, LEAST_PARTS, MOST_PARTS = 64 << 20, 2_000_000, 4, 1 << 20
#: Occurrences of a word for each of the parts that its continuations are divided into: all words together have no more
#: than tokens / HOT_TOKENS such parts, and twice as many words at most are known to every worker.
HOT_TOKENS = 1_000_000
#: Distinct keys that a map task holds before it sends them.
_HELD = 4_000_000
_COUNTS_DDL = "part int, keys binary, counts binary"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, at = column_bytes(column)
    buf = LOWER[buf]
    starts, ends, firsts = word_spans(buf, at, NON_SPACE)
    return word_hashes(buf, starts, ends), firsts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counted(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.RecordBatch], np.ndarray], part_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of part, sorted keys and counts of all keys of the batches; a part may have several rows."""

    def sent(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = part_of(keys)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        for a, b in zip(at, [*at[1:], len(part)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([keys[a:b].tobytes()], pa.binary()), pa.array([counts[a:b].astype(np.uint32).tobytes()], pa.binary())], names=["part", "keys", "counts"])

    held, n = [], 0
    for block in blocks(batches, "text"):
        keys, counts = np.unique(keys_of(block), return_counts=True)
        held.append((keys, counts.astype(np.int64)))
        n += len(keys)
        if n > _HELD:
            held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
            n = len(held[0][0])
            if n > _HELD // 2:
                yield from sent(*held[0])
                held, n = [], 0
    if held:
        yield from sent(*_summed(*map(np.concatenate, zip(*held, strict=True))))


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a part and their counts, summed."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
    return _summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """A file of the shared folder; a task that runs twice writes the same bytes and replaces the file in one step."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(part, values)
    os.replace(part, f"{folder}/{name}.npy")


def _parts(amount: float, each: int) -> int:
    return min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, int(np.ceil(np.log2(max(1.0, amount / each)))))))


_open: dict[str, np.ndarray | None] = {}


def _mapped(path: str) -> np.ndarray | None:
    """The array of a file, mapped; None if there is no such part. Mappings hold no file descriptor."""
    if path not in _open:
        if len(_open) > MOST_PARTS:
            _open.clear()
        _open[path] = None
        if os.path.exists(path):
            with open(path, "rb") as f:
                np.lib.format.read_magic(f)
                shape, _, kind = np.lib.format.read_array_header_1_0(f)
                m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
                _open[path] = np.frombuffer(m, kind, int(np.prod(shape)), f.tell()).reshape(shape)
    return _open[path]


def discounts(of_counts: list[int]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of n-grams that occur once, twice, three and four times.

    Where one of these numbers is 0 the formula has no value, and half a count is taken off.
    """
    n1, n2, n3, n4 = of_counts
    if min(n1, n2, n3, n4) == 0:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.0), k) for k, d in enumerate(found, 1)]


def _discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


@dataclass
class KneserNeyModel:
    folder: str
    #: Number of the first word of each part of the vocabulary, and one more at the end.
    word_offsets: np.ndarray
    n_parts: int = 1
    tokens: int = 0  # all training tokens, ends included
    ends: int = 0  # ends of texts among them
    types: int = 0  # distinct bigrams
    bigram_discounts: list[float] = field(default_factory=lambda: [0.5] * 3)
    word_discounts: list[float] = field(default_factory=lambda: [0.5] * 3)
    spread: float = 1.0  # share of the word distribution that all words, known or not, share equally
    #: Numbers of the words with parts of their own, in order; the first of each one's parts, with the end.
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    hot_parts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @property
    def words(self) -> int:
        return int(self.word_offsets[-1])

    @property
    def word_parts(self) -> int:
        return len(self.word_offsets) - 1

    @property
    def vocabulary(self) -> int:
        """Distinct training tokens, the end included."""
        return self.words + (self.ends > 0)

    def parts_of(self, number: np.ndarray) -> np.ndarray:
        """Part of each word number; numbers go up to words + 1, the end and the start of a text."""
        return (number.astype(np.uint64) * np.uint64(self.n_parts) // np.uint64(self.words + 2)).astype(np.int64)

    def bigram_parts(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Part of each bigram; it never falls as u and then w grow."""
        part = self.parts_of(u)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            own = np.flatnonzero(self.hot[at] == u.astype(np.int64))
            first, many = self.hot_parts[at[own]], self.hot_parts[at[own] + 1] - self.hot_parts[at[own]]
            # Words that are numbered higher have higher parts: w * many / (words + 2), without an overflow.
            share = w[own].astype(np.float64) / (self.words + 2)
            part[own] = self.n_parts + first + np.minimum((share * many).astype(np.int64), many - 1)
        return part

    def _stats(self, part: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts u of a part are known, and total and numbers of continuations by count of the known ones."""
        if part >= self.n_parts:
            k = int(np.searchsorted(self.hot_parts, part - self.n_parts, "right")) - 1
            stats = [_mapped(f"{self.folder}/context-stats-{p + self.n_parts:07d}.npy") for p in range(self.hot_parts[k], self.hot_parts[k + 1])]
            total = sum(x.sum(axis=0) for x in stats if x is not None)
            return np.full(len(u), bool(np.any(total))), np.broadcast_to(total, (len(u), 4)).astype(np.float64) if np.any(total) else np.zeros((0, 4))
        contexts = _mapped(f"{self.folder}/contexts-{part:07d}.npy")
        if contexts is None:
            return np.zeros(len(u), bool), np.zeros((0, 4))
        c = np.minimum(np.searchsorted(contexts, u.astype(np.uint32)), len(contexts) - 1)
        seen = contexts[c] == u.astype(np.uint32)
        return seen, _mapped(f"{self.folder}/context-stats-{part:07d}.npy")[c[seen]].astype(np.float64)

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, -1 if it isn't known, and how often it occurs."""
        unique, inverse = np.unique(hashes, return_inverse=True)
        numbers, counts = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        part = _word_part(unique, self.word_parts)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        for a, b in zip(first, [*first[1:], len(part)], strict=True):
            p = int(part[a])
            if (keys := _mapped(f"{self.folder}/words-{p:07d}.npy")) is not None:
                at = np.minimum(np.searchsorted(keys, unique[a:b]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == unique[a:b])
                numbers[a + hit] = self.word_offsets[p] + at[hit]
                counts[a + hit] = _mapped(f"{self.folder}/counts-{p:07d}.npy")[at[hit]]
        return numbers[inverse], counts[inverse]

    def word_probability(self, number: np.ndarray) -> np.ndarray:
        """Lower order: by the number of distinct words before a word; what the discounts free, all words share equally."""
        share = self.spread / (self.vocabulary + 1)
        before = np.zeros(len(number), np.int64)
        order = np.argsort(number, kind="stable")
        known = order[number[order] >= 0]
        part = self.parts_of(number[known])
        cuts = np.searchsorted(part, np.arange(self.n_parts + 1))
        for p in np.unique(part):
            at = known[cuts[p] : cuts[p + 1]]
            dense = _mapped(f"{self.folder}/before-{p:07d}.npy")
            if dense is not None:
                before[at] = dense[number[at] - _first_number(p, self.n_parts, self.words)]
        return (before - _discount(before, self.word_discounts)) / max(1, self.types) + share

    def probability(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P(w | u) of word numbers, -1 for unknown ones."""
        lower = self.word_probability(w)
        out = lower.copy()
        known = np.flatnonzero(u >= 0)
        part = self.bigram_parts(u[known], np.maximum(w[known], 0))
        order = np.argsort(part, kind="stable")
        known, part = known[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        for a, b in zip(first, [*first[1:], len(part)], strict=True):
            p, at = int(part[a]), known[a:b]
            seen, s = self._stats(p, u[at])
            at = at[seen]
            if not len(at):
                continue
            total = s[:, 0]
            freed = s[:, 1:] @ np.array(self.bigram_discounts) / total
            n = np.zeros(len(at), np.int64)
            keys = _mapped(f"{self.folder}/bigrams-{p:07d}.npy")
            if keys is not None:
                counts = _mapped(f"{self.folder}/bigram-counts-{p:07d}.npy")
                wanted = (u[at].astype(np.uint64) << np.uint64(32)) | np.maximum(w[at], 0).astype(np.uint64)
                unique, inverse = np.unique(wanted, return_inverse=True)
                k = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
                n = np.where(keys[k] == unique, counts[k], 0).astype(np.int64)[inverse]
                n[w[at] < 0] = 0
            out[at] = (n - _discount(n, self.bigram_discounts)) / total + freed * lower[at]
        return out


def _word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each word hash: its leading bits."""
    return (hashes >> np.uint64(65 - parts.bit_length())).astype(np.int64)


def _first_number(part: int, n_parts: int, words: int) -> int:
    """The smallest number n with n * n_parts // (words + 2) == part."""
    return -(-int(part) * (words + 2) // n_parts)


def _numbers(m: KneserNeyModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number and count of each token, the end of each row included; number of the token before it; index of each
    row's first token, with the end."""
    h, firsts = _words(column)
    number, count = m.number(h)
    rows = len(firsts) - 1
    first = firsts + np.arange(rows + 1)
    number_, count_ = np.full(len(h) + rows, m.words, np.int64), np.full(len(h) + rows, m.ends, np.int64)
    place = np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(firsts))
    number_[place], count_[place] = number, count
    before = np.empty(len(number_), np.int64)
    before[1:] = number_[:-1]
    before[first[:-1]] = m.words + 1
    return number_, count_, before, first


def train(texts: DataFrame, text_column: str = "text") -> KneserNeyModel:
    """The model of all texts, each taken whole; repeated rows count each time, and no rows make a model that knows no
    word. The shared folder must be one that Python can open on every machine (file:)."""
    spark = texts.sparkSession
    path = fresh_path(spark, "kneser-ney")
    if "://" in path and not path.startswith("file://"):
        raise ValueError("memory mapping needs a spark.checkpoint.dir that is mounted as a folder on every machine")
    folder = path.removeprefix("file://").removeprefix("file:")
    rows = texts.select(F.col(text_column).alias("text"))
    ends, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    word_parts = _parts(size, PART_BYTES)

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, lambda b: _words(b.column("text"))[0], lambda k: _word_part(k, word_parts))

    def write_words(key, table):
        part = key[0].as_py()
        keys, counts = _group(table)
        _save(folder, f"words-{part:07d}", keys)
        _save(folder, f"counts-{part:07d}", counts)
        common = np.flatnonzero(counts > HOT_TOKENS)
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (common, counts[common])]
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()), "hot": lists[0], "times": lists[1]})

    # One row for each part.
    sizes = {r["part"]: r for r in rows.mapInArrow(word_counts, _COUNTS_DDL).groupBy("part").applyInArrow(write_words, "part int, n bigint, tokens bigint, hot array<bigint>, times array<bigint>").collect()}
    offsets = np.concatenate([[0], np.cumsum([sizes[p]["n"] if p in sizes else 0 for p in range(word_parts)])])
    tokens = ends + sum(r["tokens"] for r in sizes.values())
    if offsets[-1] >= 1 << 32:
        raise ValueError("more distinct words than 32-bit numbers")
    n_parts = _parts(tokens, PART_TOKENS)
    model = KneserNeyModel(folder, offsets, n_parts, tokens, ends)
    hot = [(int(offsets[p] + k), n) for p, r in sorted(sizes.items()) for k, n in zip(r["hot"], r["times"], strict=True)]
    hot += [(model.words + 1, ends)] if ends > HOT_TOKENS else []  # the start of a text
    model.hot = np.array([k for k, _ in hot], np.int64)
    model.hot_parts = np.cumsum([0, *(-(-n // HOT_TOKENS) for _, n in hot)]).astype(np.int64)
    sent = spark.sparkContext.broadcast(model)

    def bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value

        def keys(batch: pa.RecordBatch) -> np.ndarray:
            number, _, before, _ = _numbers(m, batch.column("text"))
            return (before.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)

        return _counted(batches, keys, lambda k: m.bigram_parts(k >> np.uint64(32), k & np.uint64(0xFFFFFFFF)))

    def write_bigrams(key, table):
        m, part = sent.value, key[0].as_py()
        keys, counts = _group(table)
        _save(folder, f"bigrams-{part:07d}", keys)
        _save(folder, f"bigram-counts-{part:07d}", counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
        u = (keys >> np.uint64(32)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        stats = np.column_stack([np.add.reduceat(x, at) for x in (counts, counts == 1, counts == 2, counts > 2)])
        _save(folder, f"contexts-{part:07d}", u[at])
        _save(folder, f"context-stats-{part:07d}", stats.astype(np.int64))
        w, before = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        goes_to = m.parts_of(w)
        cut = np.flatnonzero(np.concatenate([[True], goes_to[1:] != goes_to[:-1]]))
        ends_at = [*cut[1:], len(w)]
        of_counts = [[int((counts == k).sum()) for k in range(1, 5)]]
        n = len(cut)
        return pa.table({
            "part": pa.array(goes_to[cut], pa.int32()), "words": pa.array([w[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, ends_at, strict=True)], pa.binary()),
            "before": pa.array([before[a:b].astype(np.uint32).tobytes() for a, b in zip(cut, ends_at, strict=True)], pa.binary()),
            # The numbers of the whole part are on its first row.
            "of_counts": pa.array(of_counts + [[0] * 4] * (n - 1), pa.list_(pa.int64())), "types": pa.array([len(keys)] + [0] * (n - 1), pa.int64()),
        })

    def write_before(key, table):
        m, part = sent.value, key[0].as_py()
        first, after = _first_number(part, m.n_parts, m.words), _first_number(part + 1, m.n_parts, m.words)
        dense = np.zeros(after - first, np.int64)
        for w, n in zip(table.column("words").to_pylist(), table.column("before").to_pylist(), strict=True):
            dense[np.frombuffer(w, np.uint32).astype(np.int64) - first] += np.frombuffer(n, np.uint32)
        _save(folder, f"before-{part:07d}", dense.astype(np.uint32))
        add = lambda column: np.sum(np.array(table.column(column).to_pylist(), np.int64), axis=0)
        by = [int((dense == k).sum()) for k in range(1, 5)]
        return pa.table({"of_counts": pa.array([add("of_counts").tolist()], pa.list_(pa.int64())), "types": pa.array([int(add("types"))], pa.int64()), "of_before": pa.array([by + [int((dense > 2).sum())]], pa.list_(pa.int64()))})

    counted = rows.mapInArrow(bigram_counts, _COUNTS_DDL).groupBy("part").applyInArrow(write_bigrams, "part int, words binary, before binary, of_counts array<bigint>, types bigint")
    # One row for each part, MOST_PARTS at most.
    found = counted.groupBy("part").applyInArrow(write_before, "of_counts array<bigint>, types bigint, of_before array<bigint>").collect()
    if found:
        of_counts, of_before = (np.sum([r[c] for r in found], axis=0).tolist() for c in ("of_counts", "of_before"))
        model.types = sum(r["types"] for r in found)
        model.bigram_discounts, model.word_discounts = discounts(of_counts), discounts(of_before[:4])
        d = model.word_discounts
        model.spread = (d[0] * of_before[0] + d[1] * of_before[1] + d[2] * of_before[4]) / model.types
    return model


def score(docs: DataFrame, model: KneserNeyModel, text_column: str = "text") -> DataFrame:
    """docs without its text, and n_tokens, n_known, base_score, score: one row per row.

    Tokens are the words of the whole text, A-Z lower-cased, and its end, so that a null or empty text has one. score
    is log10 of the model's probability of the tokens; words that training lacks share what it leaves to all words.
    base_score is the unigram score with half a count added. With nothing to learn from, all words are equally unknown.
    Texts of any length are scored whole, repeated rows alike; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for block in blocks(batches, text_column, 4 << 20):
            number, count, before, first = _numbers(m, block.column(text_column))
            base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
            log_p = np.log10(m.probability(before, number))
            add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every row has its end
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), pa.array(np.diff(first)), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(log_p))], names=[*kept, "n_tokens", "n_known", "base_score", "score"])

    ddl = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.mapInArrow(run, ddl + "n_tokens bigint, n_known bigint, base_score double, score double")
