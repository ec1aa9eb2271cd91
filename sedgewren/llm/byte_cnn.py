"""Quality by a byte-level convolutional network in numpy.

A text is a row of symbols: its bytes, each marked if the bytes up to it repeat at a short lag. Learned filters slide
over all of it. Responses are max-pooled in overlapping chunks that cover the whole text; a text's chunks are combined
by mean and maximum, and a logistic unit makes one probability of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import blocks, column_bytes
from sedgewren.llm.labelled import fitted, fold, labelled_sample

WIDTH, FILTERS = 5, 16
#: A chunk is CHUNK pieces of PIECE bytes; the next one starts STEP pieces on.
PIECE, CHUNK, STEP = 64, 4, 3
#: Lags up to which a repetition is seen, and the bytes that must repeat.
LAGS, REPEATED = 32, 16
SYMBOLS = 512
#: Zeros after each text: no filter and no lag reaches from one text into another.
_PAD = LAGS + REPEATED + WIDTH
#: Chunks of a text that one training step looks at, drawn anew from all of them each time; scoring looks at all.
_CHUNKS_A_STEP = 12


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all rows with zeros after each, and start and length of each row; an empty row has one zero."""
    buf, at = column_bytes(column)
    n = np.diff(at)
    lengths = np.maximum(n, 1)
    starts = np.concatenate([[0], np.cumsum(lengths + _PAD)])
    x = np.zeros(int(starts[-1]) + _PAD, np.uint8)
    x[np.arange(len(buf)) + np.repeat(starts[:-1] - at[:-1], n)] = buf
    repeats = np.zeros(len(x), bool)
    for lag in range(1, LAGS + 1):
        same = x[lag:] == x[:-lag]
        k = 1
        while k < REPEATED:
            same = same[k:] & same[:-k]
            k *= 2
        repeats[lag + REPEATED - 1 :] |= same
    # Zeros are never marked: those between texts would depend on the neighbours.
    return x + (repeats & (x != 0)).astype(np.uint16) * np.uint16(256), starts[:-1], lengths


def _pieces(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece of all rows, and the index of each row's first piece, with the end."""
    many = -(-lengths // PIECE)
    firsts = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(starts)), many)
    at = starts[row] + PIECE * (np.arange(len(row)) - firsts[row])
    return at, np.minimum(at + PIECE, starts[row] + lengths[row]), firsts


def _chunks(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First piece of each chunk of all rows, and the index of each row's first chunk, with the end."""
    pieces = np.diff(firsts)
    many = np.where(pieces > CHUNK, -(-(pieces - CHUNK) // STEP) + 1, 1)
    chunk_firsts = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(pieces)), many)
    return firsts[row] + STEP * (np.arange(len(row)) - chunk_firsts[row]), chunk_firsts


@dataclass
class ByteCNN:
    filters: np.ndarray  # WIDTH, SYMBOLS, FILTERS
    bias: np.ndarray
    weights: np.ndarray  # of the means of the chunks, then of their maxima
    intercept: float
    constant: float | None = None

    def responses(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = self.filters[0].take(x[at], axis=0)
        for k in range(1, WIDTH):
            out += self.filters[k].take(x[at + k], axis=0)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        x, starts, lengths = symbols(column)
        at, ends, firsts = _pieces(starts, lengths)
        top = np.empty((len(at), FILTERS), np.float32)
        for a in range(0, len(at), 512):
            b = min(a + 512, len(at))
            n = ends[a:b] - at[a:b]
            offsets = np.cumsum(n) - n
            places = np.arange(int(n.sum())) + np.repeat(at[a:b] - offsets, n)
            top[a:b] = np.maximum.reduceat(self.responses(x, places), offsets, axis=0)
        first, chunk_firsts = _chunks(firsts)
        last = np.repeat(firsts[1:] - 1, np.diff(chunk_firsts))
        pooled = top[first]
        for k in range(1, CHUNK):
            np.maximum(pooled, top[np.minimum(first + k, last)], out=pooled)
        pooled = np.maximum(pooled + self.bias, 0)
        begin = chunk_firsts[:-1]
        mean = np.add.reduceat(pooled, begin, axis=0) / np.diff(chunk_firsts)[:, None]
        most = np.maximum.reduceat(pooled, begin, axis=0)
        z = np.hstack([mean, most]) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: pa.Table, counts: dict[int, int], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteCNN:
    """By Adam on the log loss of text and label (1: good), labels weighed by how common they are among all labelled rows.

    Without texts of both labels every text scores the share of label 1.
    """
    y = texts.column("label").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return ByteCNN(*(np.zeros(0),) * 3, 0.0, constant=share)
    w = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    w /= w.mean()
    x, starts, lengths = symbols(texts.column("text").combine_chunks().cast(pa.large_string()))
    _, _, firsts = _pieces(starts, lengths)
    random = np.random.default_rng(seed)
    net = ByteCNN(random.normal(0, 0.05, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), random.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    parameters = [net.filters, net.bias, net.weights, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    most_chunks = np.where(np.diff(firsts) > CHUNK, -(-(np.diff(firsts) - CHUNK) // STEP) + 1, 1)
    t = 0
    steps = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for b in range(0, len(y), batch):
            rows = order[b : b + batch]
            picked = [random.choice(most_chunks[r], min(most_chunks[r], _CHUNKS_A_STEP), replace=False) for r in rows]
            of = np.repeat(np.arange(len(rows)), [len(p) for p in picked])
            begin = starts[rows][of] + np.concatenate(picked) * STEP * PIECE
            n = np.minimum(begin + CHUNK * PIECE, starts[rows][of] + lengths[rows][of]) - begin
            offsets = np.cumsum(n) - n
            places = np.arange(int(n.sum())) + np.repeat(begin - offsets, n)
            r = net.responses(x, places)
            top = np.maximum.reduceat(r, offsets, axis=0)
            # The first place of each chunk that reaches its maximum.
            reached = np.where(r == np.repeat(top, n, axis=0), np.arange(len(r))[:, None], len(r))
            best = places[np.minimum.reduceat(reached, offsets, axis=0)]
            z = np.maximum(top + net.bias, 0)
            doc_offsets = np.concatenate([[0], np.cumsum([len(p) for p in picked])])[:-1]
            many = np.array([len(p) for p in picked])[:, None]
            mean = np.add.reduceat(z, doc_offsets, axis=0) / many
            most = np.maximum.reduceat(z, doc_offsets, axis=0)
            both = np.hstack([mean, most])
            p = 1 / (1 + np.exp(-np.clip(both @ net.weights + parameters[3][0], -30, 30)))
            g = (w[rows] * (p - y[rows]) / len(rows)).astype(np.float32)
            g_both = g[:, None] * net.weights
            g_z = (g_both[:, :FILTERS] / many)[of]
            is_most = z == most[of]
            g_z = (g_z + is_most * g_both[of, FILTERS:] / np.maximum(1, np.add.reduceat(is_most, doc_offsets, axis=0))[of]) * (z > 0)
            g_filters = np.zeros_like(net.filters)
            column = np.broadcast_to(np.arange(FILTERS), best.shape)
            for k in range(WIDTH):
                np.add.at(g_filters[k], (x[best + k], column), g_z)
            t += 1
            step = rate * (1 - 0.9 * t / steps)
            for value, grad, (m, v) in zip(parameters, (g_filters, g_z.sum(axis=0), g @ both, np.array([g.sum()])), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.intercept = float(parameters[3][0])
    return net


def quality_model(docs: DataFrame, labels: DataFrame, low_rows: int = 2000, good_rows: int = 4000, skip_fold: int = 2, folds: int = 4) -> ByteCNN:
    """Trained, in one task, on at most low_rows and good_rows labelled documents outside the skipped fold, see
    `labelled_sample`."""
    return fitted(*labelled_sample(docs, labels, "quality", {0: low_rows, 1: good_rows}, skip_fold, folds), train)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, repeated ones included.

    Null and empty texts score like a single zero byte; texts of any length are scored whole. No rows give no rows, and
    without labels of both kinds every text scores the share of label 1; ids with several labels have the largest.
    Labels, language, source and id are no inputs of the score, and other columns are not looked at.
    """
    model = quality_model(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(sent.value.scores(block.column("text")))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
