"""Token counts kept in a digest cache.

A text's key is the SHA-256 of its normalised content, beside the digest of the
tokenizer's file. Normalised means what the tokenizer itself cannot tell apart:
null is empty, the word mark U+2581 is a space. Distinct keys alone are joined to
the stored counts; only the texts of keys that miss are read on, reduced to one
for each key (map-side first, so a text that makes up a third of all rows leaves
each task once), encoded, and appended to the cache, a folder for each tokenizer.
So with a filled cache no text is shuffled, and where many keys miss, a bitmap of
them keeps nearly all others from moving. Counts are joined back by key; those
of keys with more than ``HEAVY`` rows are broadcast, so no task gets all rows of one.

Defined results: null and empty texts have 0 tokens; repeated rows repeat;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import jaccard_join, tokenizers_
from corvane.llm.arrow import as_texts, pieces, record
from corvane.storage import new_path, stored, table

MODEL = "piece_bpe_32k.model"
#: More tokens than this are over the limit.
LIMIT = 4096

#: Rows of one text from which its count is broadcast, and rows of a broadcast.
HEAVY = 500
BROADCAST_ROWS = 500_000

CACHE = "digest binary, n_tokens long, tokenizer string"


def key(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), "▁", " "), 256))


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """The stored counts (digest, n_tokens) of a tokenizer version, None where there is no cache yet; keys may repeat."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_ROWS rows; df is a stored table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest) of each row, stored as it is read several times; texts are hashed once."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), key(text).alias("digest"))
    return stored(rows, "keys")


def likely(texts: DataFrame, misses: DataFrame, n: int) -> DataFrame:
    """The rows whose digest may be among ``n`` misses: all that are, and few others, by a broadcast bitmap.

    So of the texts that the cache knows hardly one is shuffled, however many
    others there are; beyond ``jaccard_join.BITMAP_BITS`` / 16 misses more pass.
    """
    hashed = F.xxhash64("digest")
    bits, wanted = jaccard_join.bitmap(misses.select(hashed.alias("key")), n)

    def run(batches):
        held = np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            rows = batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            yield rows.select([0, 1])

    placed = texts.select("digest", "text", F.pmod(hashed, F.lit(bits)).alias("place"))
    return placed.mapInArrow(run, "digest binary, text string")


def fill(documents: DataFrame, cache: str, model: str | None = None, keys: DataFrame | None = None) -> None:
    """Encodes the distinct texts that the cache misses and appends their counts; ``keys`` are those of ``documents``, if known."""
    file = model or tokenizers_.path(MODEL)
    tokenizer = tokenizers_.version(file)
    text = F.col("text").cast("string")
    texts = documents.select(key(text).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    if (known := cached(documents.sparkSession, cache, tokenizer)) is not None:
        # digests only, until it is known which texts are needed
        distinct = (keyed(documents) if keys is None else keys).select("digest").distinct()
        misses = stored(distinct.join(known, "digest", "left_anti"), "misses")
        if (n := misses.count()) > BROADCAST_ROWS:
            texts = likely(texts, misses, n)
        texts = texts.join(_few(misses), "digest", "left_semi")
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))

    def run(batches):
        counter = tokenizers_.piece_counter(file)
        for batch in pieces(batches):
            counts = [counter.count(t) for t in as_texts(batch.column(1))]
            yield record(digest=(batch.column(0), pa.binary()), n_tokens=(counts, pa.int64()))

    counted = distinct.mapInArrow(run, "digest binary, n_tokens long")
    counted.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(documents: DataFrame, cache: str, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row."""
    rows = keyed(documents)
    fill(documents, cache, model, rows)
    counts = cached(documents.sparkSession, cache, tokenizers_.version(model or tokenizers_.path(MODEL)))
    # two writers may both have added a key; they agree
    counts = counts.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    heavy = rows.groupBy("digest").count().where(F.col("count") > HEAVY).select("digest").join(counts, "digest").withColumnRenamed("n_tokens", "of_heavy")
    rows = rows.join(_few(stored(heavy, "heavy")), "digest", "left")
    # rows that have their count go on under keys of their own, which nothing matches
    own = F.when(F.col("of_heavy").isNull(), F.col("digest")).otherwise(F.concat("digest", F.unhex(F.hex(F.coalesce("doc_id", F.lit(0))))))
    out = rows.withColumn("digest", own).join(counts, "digest", "left").withColumn("n_tokens", F.coalesce("of_heavy", "n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded here."""
    return count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-counts"))
