"""Helpers for functions that map Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Bytes of texts handed to a step at once.
PIECE_BYTES = 8 << 20


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each string, empty where null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Each string, empty where null."""
    return ["" if x is None else x for x in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2048, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, cut by rows and by bytes, so that results of one batch stay small; a larger row is a batch of its own."""
    for batch in batches:
        ends = np.cumsum(_row_bytes(batch))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the texts and binary values of each row."""
    out = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            out += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return out


def by_place(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | None = None) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names: ``run`` sees and gives columns in order, without names."""
    out = schema or df.schema
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(out)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain.names)

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(named, plain).toDF(*out.names)


def record(**columns: tuple[list | pa.Array, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in columns.values()], names=list(columns))
