"""The best rows of each query over blocks of scores, inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are worked on at once; also the rows that are kept, about, before they are reduced to the best.
BLOCK_SCORES = 1_000_000


def block_rows(width: int) -> int:
    """The rows of a block of ``width`` columns."""
    return max(1, BLOCK_SCORES // max(1, width))


def cut(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with rows of ``sizes`` (null: 0) that are at most ``limit`` together, one row at least."""
    ends, start = np.cumsum(np.asarray(pc.fill_null(sizes, 0), dtype=np.int64)), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Best:
    """The best ``k`` ids of each query by rounded score, ties by id; what it holds follows from k, the queries and the block."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.parts, self.held = k, np.full(queries, -np.inf), [], 0
        self.first = True
        self.last = np.full(queries, -1)  # where the k-th row of a query is in the first part
        self.most = max(BLOCK_SCORES, 2 * k * queries)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """A block of scores, rows of ids by queries."""
        row, query = np.nonzero(~(scores < self.least - 1e-8))  # wider than the rounding, and with NaN
        if len(row):
            exact = scores[row, query]
            rounded = np.where(np.isnan(exact), np.inf, np.round(exact, 9))  # NaN counts as the largest number
            least, last = self.least[query], self.last[query]
            left = (last < 0) | (rounded > least)
            tie = np.flatnonzero((last >= 0) & (rounded == least))
            if len(tie):  # only a smaller id takes the place of the k-th row
                held = self.parts[0]["id"].combine_chunks().take(pa.array(last[tie]))
                left[tie] = np.asarray(pc.fill_null(pc.less(ids.take(pa.array(row[tie])), held), True))
            row, query, exact, rounded = row[left], query[left], exact[left], rounded[left]
            self.parts.append(pa.table({"query": query, "rounded": rounded, "score": exact, "id": ids.take(pa.array(row))}))
            self.held += len(row)
            if self.held > self.most or self.first:
                self.first = False
                self.reduce()

    def reduce(self) -> pa.Table | None:
        """What is left of all blocks so far: query, rounded, score, id."""
        if not self.parts:
            return None
        found = pa.concat_tables(self.parts).sort_by([("query", "ascending"), ("rounded", "descending"), ("id", "ascending")]).combine_chunks()
        query = np.asarray(found["query"])
        place = np.arange(len(query)) - np.searchsorted(query, query)
        found = found.take(pa.array(np.flatnonzero(place < self.k)))
        last = place[place < self.k] == self.k - 1
        self.least[query[place == self.k - 1]] = np.asarray(found["rounded"])[last]
        self.last[query[place == self.k - 1]] = np.flatnonzero(last)
        self.parts, self.held = [found], len(found)
        return found
