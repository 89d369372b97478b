"""Terms of a batch of texts, vectorised: runs of ASCII letters and digits of lower-cased UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of texts whose terms are worked out at once; arrays over the terms take many times as much.
ROWS, BYTES = 2048, 1 << 20

_TERM = np.zeros(256, dtype=bool)
_TERM[ord("0") : ord("9") + 1] = True
_TERM[ord("a") : ord("z") + 1] = True


def pieces(batch: pa.RecordBatch, text: int = 1, align: np.ndarray | None = None, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of texts (``BYTES`` by default), whatever Spark puts into a batch; a longer text is a slice of its own.

    align: sorted groups of the rows; a slice holds rows of one only.
    """
    if batch.num_rows == 0:
        return
    size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    borders = [] if align is None else (np.flatnonzero(align[1:] != align[:-1]) + 1).tolist()
    start = 0
    for border in [*borders, batch.num_rows]:
        while start < border:
            most = (ends[start - 1] if start else 0) + (BYTES if limit is None else limit)
            stop = min(border, start + ROWS, max(start + 1, int(np.searchsorted(ends, most, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def term_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(row, term number) of every term in order, and the distinct terms; null texts have none."""
    column = texts.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and n else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0] if n else np.zeros(1, dtype=np.int64)
    inside = _TERM[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    # a text's first byte opens a term whatever stands before it
    first = bounds[:-1][bounds[:-1] < len(raw)]
    opens[first] = inside[first]
    starts = np.flatnonzero(opens)
    offsets = np.append(np.flatnonzero(opens[inside]), np.count_nonzero(inside))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[inside]))
    coded = words.dictionary_encode()
    rows = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, bounds)))
    return rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(row, term number, count) of each text's distinct terms, by row, and the distinct terms."""
    rows, codes, terms = term_rows(texts)
    keys, counts = np.unique(rows * max(1, len(terms)) + codes, return_counts=True)
    return keys // max(1, len(terms)), keys % max(1, len(terms)), counts, terms


def counted_by_term(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(term number, row, count) of each text's distinct terms, by term, the lengths of all texts, and the distinct terms."""
    rows, codes, terms = term_rows(texts)
    keys = np.sort(codes * max(1, len(texts)) + rows)
    opens = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
    code, row = np.divmod(keys[opens], max(1, len(texts)))
    return code, row, np.diff(np.append(opens, len(keys))), np.bincount(rows, minlength=len(texts)), terms
