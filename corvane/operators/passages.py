"""Which texts hold which passages: one walk over each text, whatever the number of passages."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.best import key_type

#: Characters of passages in one broadcast; an automaton has a node for each at most.
BLOCK_CHARS = 1_000_000


def containing(texts: DataFrame, text: str, passages: DataFrame, passage: str, key: str = "query_id", limit: int = BLOCK_CHARS) -> DataFrame:
    """(key, columns of ``texts`` but the text) of each text and passage that it holds as a substring.

    Passages go to the executors in blocks of about ``limit`` characters, each
    matched by an Aho-Corasick automaton. Null texts hold nothing, null and
    empty passages are held by nothing; a pair comes once for each of its rows.
    """
    spark = texts.sparkSession
    columns = [c for c in texts.columns if c != text]
    wanted = passages.where(F.length(passage) > 0).select(key, passage)
    schema = wanted.select(key).join(texts.select(*columns)).schema
    kind = key_type(wanted, key)
    chars = wanted.agg(F.sum(F.length(passage))).head()[0] or 0
    parts = -(-chars // limit)
    out: DataFrame | None = None
    for k in range(parts):
        block = spark.sparkContext.broadcast([tuple(r) for r in wanted.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k).collect()])

        def run(batches, block=block):
            known = ahocorasick.Automaton()
            for name, value in block.value:
                known.add_word(value, [*known.get(value, []), name])
            if len(known) == 0:
                return
            known.make_automaton()
            for batch in batches:
                at, names = [], []
                for i, value in enumerate(batch.column(0).to_pylist()):
                    # distinct passages, in the order in which they end
                    for owners in {id(o): o for _, o in known.iter(value or "")}.values():
                        at += [i] * len(owners)
                        names += owners
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array(names, kind), *(c.take(pa.array(at)) for c in batch.columns[1:])], names=[key, *columns])

        part = texts.select(text, *columns).mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out
