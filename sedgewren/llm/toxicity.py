"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary texts and one on windows of toxic texts. A window's
distance is by how many bytes it compresses shorter with both of them than with the ordinary one alone. Toxic texts are
mostly ordinary text, so the toxic dictionary is trained in rounds: first on all windows of the toxic texts, then on those
whose distance is telling. The texts are dealt into halves, and a window is only ever measured with the dictionary of the
other half, so that none is taken because it is in the dictionary itself.

Windows are the words of a text, longer ones cut into overlapping pieces, so that they cover the whole text and equal
windows are compressed once. Each is followed by a fixed tail that both dictionaries hold, because zstandard stores
the last bytes of a block as they are. What the distances of a text's windows say about the text is calibrated on
labelled texts that neither dictionary was trained on. All this is done PARTS times, each time with another part of the
texts to calibrate on, and scores are averaged; parts are dealt by hashes of texts, so the order of rows does not matter.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import LOWER, NON_SPACE, blocks, column_bytes, word_spans
from sedgewren.llm.labelled import fitted_parts, fold, labelled_sample

#: Bytes of a window and of the step between windows of a longer word; level of compression.
WINDOW, STEP, LEVEL = 48, 32, 9
TAIL = bytes(range(1, 25))
#: Bytes of the dictionaries; length of the segments that training chooses and of the pieces it counts them by.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, PIECE = 100_000, 1_500, 24, 6
#: Classifiers whose scores are averaged, each calibrated on another part of the texts and trained on the others.
PARTS = 3
#: Rounds of choosing the windows that the toxic dictionary is trained on; distances that calibration looks at.
ROUNDS, DISTANCES = 3, (2, 3, 4, 5, 6)
#: Words kept in a worker's memory with their distances.
_CACHE = 400_000
_SPACES = re.compile(rb"[\x20\x09-\x0d]+")


def _windows(text: bytes) -> list[bytes]:
    return [w[i : i + WINDOW] for w in _SPACES.split(text) if w for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)]


def _trained(windows: list[bytes], size: int) -> bytes:
    """Content of a dictionary of at most that size, trained on the windows: some of them in a row are a sample."""
    windows = list(windows)
    random.Random(7).shuffle(windows)
    samples, now = [], b""
    for w in windows:
        now += b" " + w
        if len(now) > 100:
            samples.append(now)
            now = b""
    try:
        return zstandard.train_dictionary(size + 600, samples, k=SEGMENT, d=PIECE).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples to train on: the windows are the content, each once
        return b"".join(b" " + w for w in dict.fromkeys(windows))[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)


def _lengths(compressor: zstandard.ZstdCompressor, windows: Iterable[bytes]) -> dict[bytes, int]:
    return {w: len(compressor.compress(b" " + w + b" " + TAIL)) for w in windows}


def telling_distance(toxic: list[tuple[int, int]], ordinary: list[tuple[int, int]]) -> int:
    """The least distance from which on windows of toxic texts are most surely more frequent than those of ordinary ones.

    Both are pairs of a distance and a number of windows. Sureness is the difference of the shares over its standard error.
    """
    of = [max(1, sum(n for _, n in x)) for x in (toxic, ordinary)]
    best = (-math.inf, 1)
    for least in range(1, 12):
        here, there = (sum(n for d, n in x if d >= least) for x in (toxic, ordinary))
        if here:
            best = max(best, ((here / of[0] - there / of[1]) / math.sqrt(here / of[0] ** 2 + (there + 1) / of[1] ** 2), least))
    return best[1]


def toxic_dictionary(ordinary: bytes, toxic_texts: list[bytes], ordinary_texts: list[bytes]) -> bytes:
    """Trained on the windows of toxic texts that tell them from ordinary texts; see the module's docstring.

    A window counts once for each text. The ordinary texts are not those that the ordinary dictionary was trained on.
    """
    halves = [Counter(w for t in toxic_texts[i::2] for w in sorted(set(_windows(t)))) for i in (0, 1)]
    there = Counter(w for t in ordinary_texts for w in set(_windows(t)))
    plain = _lengths(_compressor(ordinary), halves[0].keys() | halves[1].keys() | there.keys())
    chosen, size = halves, ORDINARY_BYTES
    for _ in range(ROUNDS):
        contents = [_trained(list(c.elements()), size) for c in chosen]
        chosen, size = [], TOXIC_BYTES
        for half, content in zip(halves, reversed(contents), strict=True):
            length = _lengths(_compressor(ordinary + content), half.keys() | there.keys())
            least = telling_distance([(plain[w] - length[w], n) for w, n in half.items()], [(plain[w] - length[w], n) for w, n in there.items()])
            chosen.append(Counter({w: n for w, n in half.items() if plain[w] - length[w] >= least}))
    return _trained(list((chosen[0] + chosen[1]).elements()), TOXIC_BYTES)


@dataclass
class Classifier:
    """Two dictionaries, and what the distances of a text's windows say about it."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [_compressor(self.ordinary), _compressor(self.ordinary + self.toxic)]

    def scores(self, saved: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        x = (features(saved, firsts) - self.centre) / self.scale
        return _sigmoid(x @ self.weights[1:] + self.weights[0])


def distances(column: pa.Array, compressors: list[list[zstandard.ZstdCompressor]], cache: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each word of the rows, of a long one the largest of its windows, a row for each pair of compressors, and
    the index of each row's first word, with the end."""
    buf, at = column_bytes(column)
    buf = LOWER[buf]
    starts, ends, firsts = word_spans(buf, at, NON_SPACE)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    data = np.ascontiguousarray(buf[NON_SPACE[buf]]) if len(buf) else buf
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    pairs = [(ordinary.compress, toxic.compress) for ordinary, toxic in compressors]
    saved = np.empty((len(coded.dictionary), len(pairs)), np.int16)
    if len(cache) > _CACHE:
        cache.clear()
    for k, w in enumerate(coded.dictionary.to_pylist()):
        got = cache.get(w)
        if got is None:
            windows = [b" " + w[i : i + WINDOW] + b" " + TAIL for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)]
            got = [max(len(ordinary(x)) - len(toxic(x)) for x in windows) for ordinary, toxic in pairs]
            if len(w) <= WINDOW:
                cache[w] = got
        saved[k] = got
    return saved[coded.indices.to_numpy(zero_copy_only=False)].T if len(coded) else np.empty((len(pairs), 0), np.int16), firsts


@dataclass
class ToxicityModel:
    """The mean of some classifiers' scores, or the same score for all texts."""

    classifiers: list[Classifier]
    constant: float = 0.0

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        compressors, cache = [c.compressors() for c in self.classifiers], {}

        def scores(column: pa.Array) -> np.ndarray:
            if not self.classifiers:
                return np.full(len(column), self.constant)
            saved, firsts = distances(column, compressors, cache)
            return np.mean([c.scores(np.ascontiguousarray(s), firsts) for c, s in zip(self.classifiers, saved, strict=True)], axis=0)

        return scores


def features(saved: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Per row: the largest distance, all positive ones per root of the number of windows, and for each of DISTANCES the
    logarithm and the root of the share of the windows that have it."""
    n = np.diff(firsts)
    out = np.zeros((len(n), 2 + 2 * len(DISTANCES)))
    full = n > 0
    if full.any():
        at = firsts[:-1][full]
        out[full, 0] = np.clip(np.maximum.reduceat(saved, at), 0, 10)
        out[full, 1] = np.add.reduceat(np.maximum(saved, 0).astype(np.int64), at) / np.sqrt(n[full])
        for k, least in enumerate(DISTANCES):
            enough = np.add.reduceat((saved >= least).astype(np.int64), at)
            out[full, 2 + 2 * k] = np.log1p(enough)
            out[full, 3 + 2 * k] = np.sqrt(enough / n[full])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0
    for _ in range(50):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (w * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _dealt(texts: list[bytes], salt: int) -> list[bytes]:
    """In an order of their own, which does not depend on the order of the rows."""
    return sorted(texts, key=lambda t: (xxhash.xxh64_intdigest(t, salt), t))


def _classifier(learn: dict[int, list[bytes]], held: dict[int, list[bytes]], counts: dict[int, int]) -> Classifier:
    """Half of the ordinary texts to learn from are for their dictionary, half to choose the windows of the other."""
    ordinary = _trained([w for t in learn[0][::2] for w in sorted(set(_windows(t)))], ORDINARY_BYTES)
    found = Classifier(ordinary, toxic_dictionary(ordinary, learn[1], learn[0][1::2]), np.zeros(0), np.zeros(0), np.ones(0))
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    w = np.where(y == 1, counts[1] / len(held[1]), counts[0] / len(held[0]))
    w *= len(y) / w.sum()
    compressors, cache, x = [found.compressors()], {}, []
    for k in (0, 1):
        (saved,), firsts = distances(pa.array([t.decode() for t in held[k]]), compressors, cache)
        x.append(features(np.ascontiguousarray(saved), firsts))
    x = np.vstack(x)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return replace(found, weights=logistic((x - centre) / scale, y, w), centre=centre, scale=scale)


def train_part(texts: pa.Table, counts: dict[int, int], part: int, parts: int = PARTS, salt: int = 0) -> Classifier | None:
    """From text and label (1: toxic) of a sample, the classifier that is calibrated on one part of it; None if there are
    fewer texts of either kind than parts. counts: of all labelled rows, by label.

    Texts are dealt into parts by their hashes, so that the order of the rows does not matter; salt deals them otherwise.
    """
    everything = [(t.encode().lower(), y) for t, y in zip(texts.column("text").to_pylist(), texts.column("label").to_pylist(), strict=True) if t]
    by = {k: sorted((t for t, y in everything if y == k), key=lambda t: (xxhash.xxh64_intdigest(t, salt), t)) for k in (0, 1)}
    if min(map(len, by.values())) < parts:
        return None
    learn, held = ({y: [t for i, t in enumerate(v) if (i % parts == part) == there] for y, v in by.items()} for there in (False, True))
    return _classifier(learn, held, counts)


def _model(classifiers: list[Classifier | None], counts: dict[int, int]) -> ToxicityModel:
    return ToxicityModel([c for c in classifiers if c], counts.get(1, 0) / max(1, sum(counts.values())))


def train(texts: pa.Table, counts: dict[int, int], parts: int = PARTS, salt: int = 0) -> ToxicityModel:
    """All parts, one after the other."""
    return _model([train_part(texts, counts, k, parts, salt) for k in range(parts)], counts)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_column: str = "text", score: str = "score") -> DataFrame:
    """All columns of docs and one more, the score, from 0 to 1. Null and empty texts have no window and score like a text that saves nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = sent.value.scorer()
        for block in blocks(batches, text_column, 16 << 20):
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(scores(block.column(text_column)))], names=[*names, score])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{score}` double")


def toxicity_model(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", toxic_rows: int = 2500, ordinary_rows: int = 5000, skip_fold: int = 2, folds: int = 4) -> ToxicityModel:
    """Trained, a classifier in each task, on at most toxic_rows and ordinary_rows labelled documents outside the skipped fold, see
    `labelled_sample`. With fewer texts of either kind than PARTS every text scores the share of toxic labels.
    """
    sample, counts = labelled_sample(docs, labels, "toxic", {1: toxic_rows, 0: ordinary_rows}, skip_fold, folds, id_column, text_column)
    return _model(fitted_parts(sample, counts, train_part, PARTS), counts)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, repeated ones included.

    Null and empty texts score like a text whose windows save nothing; texts of any length are scored whole; rows of a
    null id are not held out. No rows give no rows, and ids with several labels have the largest. Labels, language,
    source and id are no inputs of the score, and other columns are not looked at.
    """
    model = toxicity_model(docs, labels)
    scored = score_toxicity(docs.select(F.col("doc_id"), F.col("text")), model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
