"""The best rows of each query among those that a task has seen, kept in bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores that are held at once.
CELLS = 2 << 20


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids in an array that sorts as the engine does."""
    return np.array(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


class Best:
    """The ``k`` best of each of ``n`` queries, ties to the smaller id."""

    def __init__(self, k: int, n: int):
        self.k, self.n, self.parts, self.held = k, n, [], 0

    def rows_at_once(self) -> int:
        return max(1, CELLS // max(1, self.n))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row an id and a column a query; -inf where the row is none of the query's."""
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[order], ids[order]
        mark = scores > -np.inf
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            above = scores > least
            equal = mark & (scores == least)
            mark = above | (equal & (np.cumsum(equal, axis=0, dtype=np.int32) <= self.k - above.sum(axis=0)))
        row, query = np.nonzero(mark)
        self.parts.append((query, scores[row, query], ids[row]))
        self.held += len(query)
        if self.held > 8 * self.k * self.n:
            self.parts = [self.result()]
            self.held = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query, score, id), or None where nothing was added."""
        if not self.parts:
            return None
        query, score, ids = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        return query[keep], score[order][keep], ids[order][keep]

    def batches(self, query_ids: pa.Array, id_type: pa.DataType):
        """The result as rows of query_id, chunk_id, score."""
        found = self.result()
        if found is not None:
            query, score, ids = found
            for at in range(0, len(query), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query[part])), pa.array(ids[part].tolist(), id_type), pa.array(score[part] + 0.0)], names=["query_id", "chunk_id", "score"])
