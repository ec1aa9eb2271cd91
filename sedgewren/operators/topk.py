"""The k best hits of each query among what one task has seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


#: Cells of a score matrix that are put in order at once.
CELLS = 1 << 19


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a matrix the k best scores and their ids, equal scores by the smaller id; fewer than k only if
    there are fewer columns. ids: one for each column, or for each element."""
    ids = np.broadcast_to(ids, score.shape)
    if score.shape[1] <= k:
        return score, ids
    order = np.argsort(ids[0], kind="stable")[None, :] if ids.strides[0] == 0 else np.argsort(ids, axis=1, kind="stable")
    score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    last = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    above, equal = score > last, score == last
    keep = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return score[keep].reshape(-1, k), ids[keep].reshape(-1, k)


class Held:
    """The best hits so far of some queries; equal scores go by the smaller id, so that k is never exceeded."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k, self.found = query_ids, k, None

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """score: a row for each query, a column for each id."""
        for a in range(0, score.shape[1], step := max(1, CELLS // max(1, score.shape[0]))):
            self._add(score[:, a : a + step], ids[a : a + step])

    def _add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if self.found is not None and self.found[0].shape[1] == self.k:
            # Most hits are under what their query already has; only the others are put in order.
            row, column = np.nonzero(score >= self.least()[:, None])
            if len(row) < score.size // 8:
                self._put(row, score[row, column], ids[column])
                return
        new = best_of(score, ids, self.k)
        if self.found is not None:
            new = best_of(*map(np.hstack, zip(self.found, new, strict=True)), self.k)
        self.found = tuple(map(np.array, new))

    def _put(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Hits of some rows beside the k that each of these holds."""
        if not len(row):
            return
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, self.k), row])
        score = np.concatenate([self.found[0][touched].ravel(), score])
        ids = np.concatenate([self.found[1][touched].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        first = np.searchsorted(row[order], touched)
        best = order[first[:, None] + np.arange(self.k)]
        self.found[0][touched], self.found[1][touched] = score[best], ids[best]

    def least(self) -> np.ndarray:
        """Of each query what a hit must score, at least, to be among the best: nothing as long as there are fewer than k."""
        if self.found is None or self.found[0].shape[1] < self.k:
            return np.full(len(self.query_ids), -np.inf)
        return self.found[0].min(axis=1)

    def rows(self, least: float = -np.inf) -> Iterator[pa.RecordBatch]:
        """query_id, chunk_id, score of hits that score more than least."""
        if self.found is not None:
            score, ids = self.found
            row, column = np.nonzero(score > least)
            yield pa.RecordBatch.from_arrays([pa.array(self.query_ids[row]), pa.array(ids[row, column]), pa.array(score[row, column])], names=["query_id", "chunk_id", "score"])
