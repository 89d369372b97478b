"""The 32-bit FNV-1a content hash over UTF-16 units, vectorised over a batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that are hashed at once.
ROWS = 2048

_PRIME, _BASIS = np.uint32(16777619), 2166136261


def fnv1a(texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    return _hashes(np.frombuffer(b"".join(raw), dtype="<u2"), np.array([len(r) // 2 for r in raw], dtype=np.int64))


def fnv1a_ascii(texts: pa.StringArray) -> np.ndarray:
    """As ``fnv1a``, of ASCII texts without nulls: their bytes are their units, so no text becomes a Python string."""
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint32)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return _hashes(np.frombuffer(b"" if data is None else data, dtype=np.uint8)[ends[0] : ends[-1]], np.diff(ends))


def _hashes(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of texts that lie side by side. All advance a unit at a time; the longest come first, so those still running are a prefix."""
    order = np.argsort(-sizes, kind="stable")
    at = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    # 32 bits, as products wrap
    hashes, unit = np.full(len(sizes), _BASIS, dtype=np.uint32), np.empty(len(sizes), dtype=units.dtype)
    done = 0
    for size in np.unique(sizes).tolist():
        n = int(np.searchsorted(-sizes, -size, "right"))
        running, read, where = hashes[:n], unit[:n], at[:n]
        for _ in range(done, size):
            # places are within the units; "clip" only spares a copy
            np.take(units, where, out=read, mode="clip")
            running ^= read
            running *= _PRIME
            where += 1
        done = size
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


@F.pandas_udf(StringType())
def content_hash(texts: pd.Series) -> pd.Series:
    """Eight hexadecimal digits; null is hashed as the empty text."""
    # some at a time, as a batch of Spark's is encoded in full otherwise
    parts = (fnv1a(["" if t is None else t for t in texts.iloc[at : at + ROWS]]) for at in range(0, len(texts), ROWS))
    return pd.Series([f"{h:08x}" for part in parts for h in part.tolist()], dtype=object)
