"""The best results of each query inside one task, and queries in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries of one broadcast.
BLOCK_QUERIES = 2048
#: Scores that a task holds at once.
CELLS = 1 << 21
#: Contributions to them: (query, term, document).
ENTRIES = 1 << 19


def key_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def blocks(queries: DataFrame, rows: int | None = None, limit: int = BLOCK_QUERIES, key: str = "query_id") -> Iterator[DataFrame]:
    """The queries in parts of about ``limit`` rows, dealt out by a hash of the key, so no order is needed; ``rows`` is their number, if known."""
    n = -(-(queries.count() if rows is None else rows) // limit)
    for i in range(n):
        yield queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


class Best:
    """The ``k`` best scores of each query, ties by id.

    With ``slack``, also what lies within so much below the k-th best. Of equal
    scores only the k least ids stay, so copies of one text do not pile up.
    """

    def __init__(self, queries: int, k: int, ids: pa.DataType, slack: np.ndarray | None = None):
        self._k, self._ids = k, ids
        self._slack = np.zeros(queries) if slack is None else slack
        self._cut = np.full(queries, -np.inf)
        self._held = pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "id": pa.array([], ids)})
        self._new: list[pa.Table] = []
        self._rows = 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: queries x rows, -inf where a row is no result."""
        if scores.shape[1] > self._k:
            at = scores.shape[1] - self._k
            np.maximum(self._cut, np.partition(scores, at, axis=1)[:, at], out=self._cut)
        q, r = np.nonzero((scores >= (self._cut - self._slack)[:, None]) & (scores > -np.inf))
        self._append(q, scores[q, r], ids.take(pa.array(r)))

    def add_pairs(self, q: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of single (query, row) pairs."""
        ok = np.flatnonzero(scores >= (self._cut - self._slack)[q])
        self._append(q[ok], scores[ok], ids.take(pa.array(ok)))

    def _append(self, q: np.ndarray, s: np.ndarray, ids: pa.Array) -> None:
        if len(q):
            self._new.append(pa.table({"q": pa.array(q.astype(np.int64)), "s": pa.array(s), "id": ids.cast(self._ids)}))
            self._rows += len(q)
        if self._rows > max(4 * self._k * len(self._cut), 1 << 17):
            self._compact()

    def _compact(self) -> None:
        rows = pa.concat_tables([self._held, *self._new]).combine_chunks()
        self._new, self._rows = [], 0
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")]))
        q, s = rows["q"].to_numpy(), rows["s"].to_numpy()
        if len(q) == 0:
            return
        # each query's k-th score
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        ends = np.append(starts[1:], len(q))
        full = ends - starts >= self._k
        np.maximum.at(self._cut, q[starts[full]], s[starts[full] + self._k - 1])
        runs = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (s[1:] != s[:-1]))))
        place = np.arange(len(q)) - np.repeat(runs, np.diff(np.append(runs, len(q))))
        self._held = rows.filter(pa.array((place < self._k) & (s >= (self._cut - self._slack)[q])))

    @property
    def cut(self) -> np.ndarray:
        """What a score of each query must reach by now."""
        return self._cut

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Query numbers, scores and ids."""
        self._compact()
        ids = self._held["id"]
        return self._held["q"].to_numpy(), self._held["s"].to_numpy(), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
