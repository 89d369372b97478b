"""Packing by power-of-two decomposition.

A document's ids, an end id appended, are cut into pieces whose lengths are
powers of two: as many of ``limit`` as fit, then the binary digits of the rest
from large to small. Each piece is a whole sequence of its length's bucket, so
no sequence crosses documents and none is padded; a trainer takes its batches
from one bucket at a time.

Nothing is shuffled: a document is encoded and cut in the task that reads it.
``sequence_id`` numbers the pieces of a task within its partition, as a plain
scan deals partitions out the same way each time, a retried task gives the
same numbers.

Defined results: a null or empty text is the end id alone, one piece of length
1; repeated rows and rows with a null id are packed each on their own.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import tokenizers_
from corvane.llm.arrow import as_texts, pieces, record
from corvane.storage import table

LIMIT = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

#: ids: little-endian unsigned 32-bit numbers.
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"


def lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Powers of two that add up to ``n``, each ``limit`` at most; ``limit`` must be a power of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(documents: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, see SCHEMA; ``bucket`` is the binary logarithm of its length."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    file = vocabulary or tokenizers_.path(VOCABULARY)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = tokenizers_.word_encoder(file)
        for batch in pieces(batches, 1024):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens")}
            for doc_id, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
                ids = encoder.encode(text) + end
                n, start = len(ids) // 4, 0
                for size in lengths(n, limit):
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(size)
                    out["ids"].append(ids[4 * start : 4 * (start + size)])
                    out["doc_tokens"].append(n)
                    start += size
                if len(out["ids"]) >= 8192:
                    yield _batch(out)
                    out = {k: [] for k in out}
            if out["ids"]:
                yield _batch(out)

    cut = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return cut.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return record(**{k: (v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each length, so that a trainer reads equal lengths together."""
    packed.write.partitionBy("bucket").parquet(path)


def report(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(pack(table(spark, sf_dir, "documents")))


def crc32(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
