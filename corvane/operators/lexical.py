"""BM25 over chunks: term counts in each document's row, scored for many queries at once.

The index is sharded by document: a row holds its own terms and counts, so
building it shuffles nothing, and a task scores its documents alone. Query
terms go to the executors in blocks of bounded size; each task keeps its own
best k for each query, so what moves is tasks x queries x k rows, never all
matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.config import B, K1
from corvane.functions import text as T
from corvane.functions.terms import counted, pieces
from corvane.operators.best import CELLS, ENTRIES, Best, key_type
from corvane.storage import stored

#: (query, term) rows of one broadcast.
BLOCK_TERMS = 1_000_000
#: And rows of documents that are scored whatever their rank.
BLOCK_KEPT = 1_000_000


def forward(docs: DataFrame) -> DataFrame:
    """(id, surface) to (id, dl, terms): a document's length and its terms with their counts, in one pass within the row."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                n = part.num_rows
                row, code, tf, terms = counted(part.column(1))
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
                items = pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
                dl = np.bincount(row, weights=tf, minlength=n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dl), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["id", "dl", "terms"])

    return docs.select("id", F.lower(F.coalesce("surface", F.lit("")))).mapInArrow(run, f"id {kind}, dl int, terms array<struct<term:string,tf:int>>")


@dataclass(frozen=True)
class LexicalIndex:
    """docs(id, dl, terms), ids distinct; documents without terms count in n and avgdl."""

    docs: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, keep: bool = True) -> LexicalIndex:
        """From (id, surface). With ``keep`` the rows are written once and read by each consumer."""
        rows = forward(docs)
        return cls(stored(rows, "lexical") if keep else rows)

    @property
    def stats(self) -> DataFrame:
        """One row (n, avgdl)."""
        return self.docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    @property
    def postings(self) -> DataFrame:
        """(term, id, tf, dl)."""
        return self.docs.select("id", "dl", F.explode("terms").alias("t")).select("t.term", "id", "t.tf", "dl")

    @property
    def df(self) -> DataFrame:
        """(term, df)."""
        return self.docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def best(self, queries: DataFrame, k: int, keep: DataFrame | None = None, slack: float = 0.0) -> DataFrame:
        return best(self, queries, k, keep, slack)


class Searchable(Protocol):
    """An index of documents by terms: one that is made for a table, or a stored one."""

    def best(self, queries: DataFrame, k: int, keep: DataFrame | None = None, slack: float = 0.0) -> DataFrame:
        """See ``best``."""


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term) of (query_id, query)."""
    return _terms(queries).distinct()


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))


def asked(queries: DataFrame, keep: DataFrame | None) -> Iterator[tuple[list[tuple], list]]:
    """Queries in parts: distinct (query_id, term), and the rows of ``keep``, of bounded numbers in each."""
    rows, also = _terms(queries).take(BLOCK_TERMS + 1), [] if keep is None else keep.take(BLOCK_KEPT + 1)
    if len(rows) <= BLOCK_TERMS and len(also) <= BLOCK_KEPT:
        yield sorted({(r["query_id"], r["term"]) for r in rows if r["query_id"] is not None}), also
        return
    wanted = query_terms(queries).where("query_id IS NOT NULL")
    parts = max(-(-wanted.count() // BLOCK_TERMS), 0 if keep is None else -(-keep.count() // BLOCK_KEPT))
    for k in range(parts):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k
        yield [tuple(r) for r in wanted.where(mine).collect()], [] if keep is None else keep.where(mine).collect()


def idf(n, df):
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class _Block:
    """The queries of one broadcast: their ids, terms with idf, and the queries of each term."""

    ids: pa.Array
    vocabulary: pa.Array
    idf: np.ndarray
    start: np.ndarray
    queries: np.ndarray
    avgdl: float
    #: Documents whose score each query needs, whatever its rank: ids, and queries by id.
    kept_ids: pa.Array
    kept_start: np.ndarray
    kept_queries: np.ndarray

    @property
    def most(self) -> np.ndarray:
        """What no score of a query exceeds, over 1 + k1."""
        return np.bincount(self.queries, weights=np.repeat(self.idf, np.diff(self.start)), minlength=len(self.ids))


def _grouped(keys: list, values: list[int], kind: pa.DataType) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys, and the values of each as ranges of one array."""
    names = sorted(set(keys))
    number = {x: i for i, x in enumerate(names)}
    at = np.array([number[x] for x in keys], dtype=np.int64)
    return pa.array(names, kind), np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(names))))).astype(np.int64), np.array(values, dtype=np.int64)[np.argsort(at, kind="stable")]


def _frequencies(docs: DataFrame, terms: list[str]) -> dict[str, int]:
    """df of the given terms, of those that some document holds; a task gives a row for each term, documents are not taken apart."""
    names = docs.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def run(batches):
        counts = np.zeros(len(names.value), dtype=np.int64)
        for batch in batches:
            place = pc.index_in(batch.column(0).flatten(), value_set=names.value).drop_null()
            counts += np.bincount(place.to_numpy(zero_copy_only=False), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([names.value.take(pa.array(found)), pa.array(counts[found])], names=["term", "df"])

    rows = docs.select("terms.term").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


def _blocks(index: LexicalIndex, queries: DataFrame, keep: DataFrame | None) -> Iterator[Broadcast]:
    spark = queries.sparkSession
    q_type, id_type = key_type(queries, "query_id"), key_type(index.docs, "id")
    n, avgdl = index.stats.head()
    for rows, kept_rows in asked(queries, keep):
        found = _frequencies(index.docs, sorted({t for _, t in rows}))
        rows = [r for r in rows if r[1] in found]
        if not rows:
            continue
        ids = sorted({q for q, _ in rows})
        number = {x: i for i, x in enumerate(ids)}
        vocabulary, start, of = _grouped([t for _, t in rows], [number[q] for q, _ in rows], pa.string())
        df = np.array([found[t] for t in vocabulary.to_pylist()], dtype=np.float64)
        also = [r for r in kept_rows if r["query_id"] in number]
        kept = _grouped([r["id"] for r in also], [number[r["query_id"]] for r in also], id_type)
        yield spark.sparkContext.broadcast(_Block(pa.array(ids, q_type), vocabulary, np.log(1 + (n - df + 0.5) / (df + 0.5)), start, of, avgdl, *kept))


def _ranges(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries ``at`` of grouped values: how many each has, and the places of all of them."""
    size = start[at + 1] - start[at]
    return size, np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _scored(block: _Block, batches: Iterator[pa.RecordBatch], k1: float, b: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, scores rounded to 6 places as queries x rows, -inf where no term is shared) of bounded slices."""
    n_queries = len(block.ids)
    degree = np.diff(block.start)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows = min(batch.num_rows - at, max(1, min(1024, CELLS // n_queries)))
            part = batch.slice(at, rows)
            terms = part.column(2)
            sizes = pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = terms.flatten()
            place = pc.index_in(flat.field("term"), value_set=block.vocabulary)
            hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            term = place.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64)
            total = int(degree[term].sum())
            if total > 2 * ENTRIES and rows > 1:
                # few rows at a time where many queries share the terms
                rows = max(1, rows * ENTRIES // total)
                part = part.slice(0, rows)
                last = int(sizes[:rows].sum())
                keep = hit < last
                hit, term, sizes = hit[keep], term[keep], sizes[:rows]
                flat = flat.slice(0, last)
            owner = np.repeat(np.arange(rows), sizes)[hit]
            tf = flat.field("tf").to_numpy(zero_copy_only=False)[hit].astype(np.float64)
            dl = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[owner]
            weight = block.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / block.avgdl)) if len(hit) else tf
            size, where = _ranges(block.start, term)
            cell = block.queries[where] * rows + np.repeat(owner, size)
            scores = np.bincount(cell, weights=np.repeat(weight, size), minlength=n_queries * rows).reshape(n_queries, rows)
            yield part.column(0), np.where(scores > 0, np.round(scores, 6), -np.inf)
            at += rows


def score(index: LexicalIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of every document with a query term, rounded to 6 places."""
    q_kind, kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index.docs, "id")))
    out: DataFrame | None = None
    for block in _blocks(index, queries, None):

        def run(batches, block=block):
            for ids, scores in _scored(block.value, batches, k1, b):
                q, r = np.nonzero(scores > -np.inf)
                for x in range(0, len(q), 1 << 16):
                    yield pa.RecordBatch.from_arrays([block.value.ids.take(pa.array(q[x : x + (1 << 16)])), ids.take(pa.array(r[x : x + (1 << 16)])), pa.array(scores[q[x : x + (1 << 16)], r[x : x + (1 << 16)]])], names=["query_id", "id", "score"])

        part = index.docs.select("id", "dl", "terms").mapInArrow(run, f"query_id {q_kind}, id {kind}, score double")
        out = part if out is None else out.unionAll(part)
    return queries.sparkSession.createDataFrame([], f"query_id {q_kind}, id {kind}, score double") if out is None else out


_BEST = "query_id {}, id {}, score double, low double, high double"


def best(index: LexicalIndex, queries: DataFrame, k: int, keep: DataFrame | None = None, slack: float = 0.0, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, low, high): each query's k best documents, and those of ``keep`` (query_id, id) that match; ``low`` and ``high`` are over all its matches.

    The result holds more rows than these, none of which ranks before them; with
    ``slack``, all within that share of the highest score that a query can have.
    ``keep`` holds a bounded number of rows for each query.
    """
    q_kind, kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index.docs, "id")))
    schema = _BEST.format(q_kind, kind)
    id_type = key_type(index.docs, "id")
    out: DataFrame | None = None
    for block in _blocks(index, queries, keep):

        def run(batches, block=block):
            known: _Block = block.value
            n = len(known.ids)
            top_, low, high = Best(n, k, id_type, known.most * (1 + k1) * slack), np.full(n, np.inf), np.full(n, -np.inf)
            extra: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
            for ids, scores in _scored(known, batches, k1, b):
                np.maximum(high, scores.max(axis=1), out=high)
                np.minimum(low, np.where(scores > -np.inf, scores, np.inf).min(axis=1), out=low)
                place = pc.index_in(ids, value_set=known.kept_ids)
                rows = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                if len(rows):
                    size, where = _ranges(known.kept_start, place.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64))
                    q, r = known.kept_queries[where], np.repeat(rows, size)
                    match = scores[q, r] > -np.inf
                    q, r = q[match], r[match]
                    extra.append((q, scores[q, r], ids.take(pa.array(r)).cast(id_type)))
                    scores[q, r] = -np.inf
                top_.add(scores, ids)
            for q, s, ids in [top_.rows(), *extra]:
                none = pa.nulls(len(q), pa.float64())
                yield pa.RecordBatch.from_arrays([known.ids.take(pa.array(q)), ids, pa.array(s), none, none], names=["query_id", "id", "score", "low", "high"])
            seen = np.flatnonzero(high > -np.inf)
            yield pa.RecordBatch.from_arrays([known.ids.take(pa.array(seen)), pa.nulls(len(seen), id_type), pa.nulls(len(seen), pa.float64()), pa.array(low[seen]), pa.array(high[seen])], names=["query_id", "id", "score", "low", "high"])

        part = index.docs.select("id", "dl", "terms").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], schema)
    # tasks x queries x k rows, read twice
    found = stored(out, "best")
    limits = found.where("id IS NULL").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return found.where("id IS NOT NULL").select("query_id", "id", "score").join(limits, "query_id")


def _scaled(score: Column, low: Column, high: Column) -> Column:
    return F.round(F.when(high == low, 1.0).otherwise((score - low) / F.nullif(high - low, F.lit(0.0))), 6)


def min_max(scores: DataFrame) -> DataFrame:
    """Scores to 0..1 within a query; a flat query becomes 1."""
    limits = scores.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return scores.join(limits, "query_id").select("query_id", "id", _scaled(F.col("score"), F.col("low"), F.col("high")).alias("score"))


def best_scaled(index: Searchable, queries: DataFrame, k: int, keep: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """(query_id, id, score) as by ``min_max``, of what may rank among the k best when scores count ``weight`` and are rounded again, and of ``keep``."""
    # what differs by this share of the highest score can become equal by rounding twice
    slack = 1.0 if weight <= 0 else min(1.0, 4e-6 / weight + 4e-6)
    return index.best(queries, k, keep, slack).select("query_id", "id", _scaled(F.col("score"), F.col("low"), F.col("high")).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; ties by id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Searchable, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query."""
    return top(index.best(queries, k).select("query_id", "id", "score"), k)
