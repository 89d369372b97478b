r"""Phrase collocations by hashed bucket counts and Apriori pruning.

Words are what is left between spaces and tabs of the pieces between
``[.,;:!?\x0A-\x0D]``, A-Z lower-cased; all counts are per language (null:
``und``). Pass k reads the texts once: it counts phrases of k words exactly
and, in ``BUCKETS`` hashed counters, those of k + 1 words. A phrase is counted in
the next pass only if its counter reached the threshold and both phrases of one
word less are in the bitmap of frequent ones. The broadcasts are these two
bitmaps, of fixed size whatever the corpus: a filled bitmap lets more phrases
through to the exact counts, which alone decide.

Counts of a task are added up before they move; a task's counters travel as the
places and values of those in use. Rows that name a frequent word meet its
count in ``SALTS`` copies, and the best of a language are chosen within
``SALTS`` parts before they are ranked together, so neither a word nor a language is
one task's.

Defined results: null and empty texts have no words; a piece's phrases do not
cross its ends; overlapping occurrences count each; repeated rows count each;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import wordhash
from corvane.llm.arrow import as_bytes, pieces
from corvane.storage import new_path, scratch, stored, table

#: Counters of phrases that are one word longer, and bits of the frequent ones; a broadcast has an eighth of a byte for each.
BUCKETS = 1 << 22
FREQUENT_BITS = 1 << 24
#: Counters that travel together.
BLOCK = 1 << 16
LEAST = 100
LONGEST = 5
FIRST = 2000
SALTS = 16

_BREAKS = wordhash.byte_table((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_SEPARATORS = _BREAKS | wordhash.byte_table((0x20, 0x20), (0x09, 0x09))
_KEYS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class _Tokens:
    """The words of a batch, one after the other."""

    #: Numbers of words and of their languages, exact; hashes of both.
    word: np.ndarray
    lang: np.ndarray
    hash: np.ndarray
    lang_hash: np.ndarray
    #: Words of one piece have one number.
    piece: np.ndarray
    words: pa.Array
    langs: pa.Array

    def starts(self, k: int) -> np.ndarray:
        """Whether k words from each place on lie in one piece."""
        n = len(self.piece) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)

    def hashes(self, k: int) -> np.ndarray:
        n = max(0, len(self.hash) - k + 1)
        out = self.lang_hash[:n] * _KEYS[0]
        for j in range(k):
            out += self.hash[j : j + n] * _KEYS[j + 1]
        return wordhash.mix(out + np.uint64(k))

    def counted(self, k: int, at: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, n) of the phrases that start at the places ``at``."""
        # exact numbers: a phrase's follows from that of its beginning and its last word
        number = self.lang[at] * len(self.words) + self.word[at]
        first = np.arange(len(at))
        for j in range(1, k):
            _, number = np.unique(number, return_inverse=True)
            number = number * len(self.words) + self.word[at + j]
        _, first, n = np.unique(number, return_index=True, return_counts=True)
        at = at[first]
        parts = [self.words.take(pa.array(self.word[at + j])) for j in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return _rows(lang=self.langs.take(pa.array(self.lang[at])), phrase=phrase.cast(pa.string()), n=pa.array(n))


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of ``_SCHEMA``; what is not given is null."""
    size = len(next(iter(columns.values())))
    kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "block": pa.int32(), "at": pa.binary(), "cells": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)).cast(t) for c, t in kinds.items()], names=list(kinds))


#: Counts of phrases; without a phrase, of all words; with a block, places and values of counters.
_SCHEMA = "lang string, phrase string, n long, block int, at binary, cells binary"


def _tokens(langs: pa.Array, texts: list[bytes], separators: np.ndarray = _SEPARATORS) -> _Tokens:
    found = wordhash.split(texts, separators)
    raw = wordhash._LOWER[np.frombuffer(found.data, dtype=np.uint8)] if found.data else np.zeros(0, dtype=np.uint8)
    sizes = found.ends - found.starts
    inside = np.repeat(found.starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
    # a word is in another piece if a break or a text's end lies before it
    piece = np.cumsum(_BREAKS[raw])[found.starts] + owner if len(raw) else owner
    named = langs.dictionary_encode()
    lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
    lang_hash = np.array([xxhash.xxh64_intdigest(x) for x in named.dictionary.to_pylist()], dtype=np.uint64)
    return _Tokens(word, lang, found.hashes, lang_hash[lang] if len(lang) else lang.astype(np.uint64), piece, coded.dictionary.cast(pa.large_string()), named.dictionary)


def _place(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _has(bits: np.ndarray, size: int, hashes: np.ndarray) -> np.ndarray:
    at = _place(hashes, size)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Counters:
    """Hashed counters up to ``most``."""

    def __init__(self, size: int, most: int):
        self._size, self._most, self._cells = size, most, np.zeros(size, dtype=np.uint16)

    def add(self, hashes: np.ndarray) -> None:
        if len(hashes):
            at, n = np.unique(_place(hashes, self._size), return_counts=True)
            self._cells[at] = np.minimum(self._cells[at] + n, self._most)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for block in range(-(-self._size // BLOCK)):
            cells = self._cells[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(cells)
            if len(at):
                yield _rows(block=pa.array([block]), at=pa.array([at.astype("<u2").tobytes()]), cells=pa.array([cells[at].astype("<u2").tobytes()]))


def _bitmap(rows: DataFrame, size: int, least: int) -> np.ndarray:
    """The bits of the counters that reach ``least`` over all tasks; blocks are merged apart, as they come."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(block, np.zeros(min(BLOCK, size), dtype=np.uint32))
                place = np.frombuffer(at, dtype="<u2")
                own[place] = np.minimum(own[place] + np.frombuffer(cells, dtype="<u2"), least)
        for block, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(own >= least, bitorder="little").tobytes()])], names=["block", "bits"])

    out = np.zeros(size // 8, dtype=np.uint8)
    width = min(BLOCK, size) // 8
    # size / 8 bytes in all
    for r in rows.where("block IS NOT NULL").select("block", "at", "cells").repartition("block").mapInArrow(run, "block int, bits binary").collect():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _pass(documents: DataFrame, k: int, longest: int, least: int, buckets: int, known: Broadcast | None) -> DataFrame:
    """Counts of phrases of k words that may be frequent, and counters of those of k + 1; see ``_SCHEMA``."""

    def run(batches):
        counters = _Counters(buckets, min(least, 65535))
        for batch in pieces(batches, 1 << 14):
            tokens = _tokens(batch.column(0), as_bytes(batch.column(1)))
            if len(tokens.word) == 0:
                continue
            inside = tokens.starts(k)
            if known is None:
                lang, n = np.unique(tokens.lang, return_counts=True)
                yield _rows(lang=tokens.langs.take(pa.array(lang)), n=pa.array(n))
            else:
                frequent, full = known.value
                shorter = _has(frequent, FREQUENT_BITS, tokens.hashes(k - 1))
                inside = inside & shorter[:-1] & shorter[1:]
                inside[inside] = _has(full, buckets, tokens.hashes(k)[inside])
            at = np.flatnonzero(inside)
            if len(at):
                yield tokens.counted(k, at)
            if k < longest:
                # of the next length, only what begins and ends with phrases that are counted
                longer = tokens.starts(k + 1)
                longer &= inside[:-1] & inside[1:] if len(longer) else longer
                counters.add(tokens.hashes(k + 1)[longer])
        if k < longest:
            yield from counters.rows()

    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def _frequent_bits(frequent: DataFrame, k: int) -> np.ndarray:
    """A bit for each frequent phrase of k words."""
    blanks = wordhash.byte_table((0x20, 0x20))

    def run(batches):
        counters = _Counters(FREQUENT_BITS, 1)
        for batch in batches:
            tokens = _tokens(batch.column(0), as_bytes(batch.column(1)), blanks)
            counters.add(tokens.hashes(k)[::k])
        yield from counters.rows()

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(run, _SCHEMA), FREQUENT_BITS, 1)


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n) of all words; both stored.

    ``buckets`` is a power of two, 65,536 at least; more of them prune more where the corpus is large.
    """
    spark = documents.sparkSession
    if buckets < BLOCK or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two, 65,536 at least")
    paths = [new_path(spark, f"phrases-{k}") for k in range(longest + 1)]
    known: Broadcast | None = None
    for k in range(1, longest + 1):
        with scratch(spark):
            rows = stored(_pass(documents, k, longest, least, buckets, known), "pass")
            counts = rows.where("block IS NULL")
            if k == 1:
                counts.where("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n")).write.parquet(paths[0])
            sums = counts.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            sums.select("lang", "phrase", F.lit(k).alias("words"), "n").write.parquet(paths[k])
            if known is not None:
                known.unpersist()
            if k < longest:
                bits = _bitmap(rows, buckets, min(least, 65535))
                known = spark.sparkContext.broadcast((_frequent_bits(spark.read.parquet(paths[k]), k), bits))
    return spark.read.parquet(*paths[1:]), spark.read.parquet(paths[0])


def _part(n: str) -> Column:
    """The first n words of a phrase, or the last -n."""
    return F.expr(f"substring_index(phrase, ' ', {n})")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the candidates that no longer one stands for, by the cut that scores lowest."""
    every, words = frequent_phrases(documents, least, longest, buckets)
    candidates = every.where("words > 1")
    # an occurrence of a longer phrase is one of each part, so equal counts pass on word by word
    ends = F.explode(F.array(_part("words - 1"), _part("1 - words")))
    longer = candidates.where("words > 2").select("lang", ends.alias("phrase"), F.col("n").alias("by")).groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where("by IS NULL OR by < n").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    cuts = cuts.withColumns({"first": _part("k"), "rest": _part("k - words")})
    counts = stored(every.select("lang", "phrase", "n"), "counts")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(_salted(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))), ["lang", "salt", part])
    cuts = cuts.join(words, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    scored = cuts.withColumns({f"_{c}": x for c, x in wide.items()}).withColumn("score", F.expr("cast((cast(1000 AS decimal(38,0)) * _a * _n) div (_l * _r) AS long)"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def first(found: DataFrame, most: int = FIRST) -> DataFrame:
    """Each language's first ``most`` with their rank."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(collocations(table(spark, sf_dir, "documents")), "collocations")
    return first(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, piece, regexp_extract_all(text, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, text FROM (
      SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS text FROM documents))),
totals AS MATERIALIZED (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS n FROM (
    SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest(range(1, {LONGEST + 1})) AS words) WHERE len(w) >= words)
  GROUP BY ALL HAVING count(*) >= {LEAST}),
inside AS MATERIALIZED (
  SELECT lang, part AS phrase, max(n) AS longer FROM (
    SELECT lang, n, unnest(flatten(list_transform(range(2, words), lambda y: list_transform(range(1, words - y + 2), lambda x: array_to_string(w[x:x + y - 1], ' '))))) AS part
    FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 2))
  GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM f WHERE words > 1) c
  LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * c.n),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, l.n AS l, r.n AS r, totals.n AS n, (1000::HUGEINT * a * totals.n // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = p JOIN f r ON r.lang = cuts.lang AND r.phrase = q JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {FIRST}"""
