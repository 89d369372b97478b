"""A stored inverted index for BM25: posting blocks by term, with the bounds of each block.

The documents of a segment are numbered in the order of their ids and form
blocks of ``DOCS`` numbers. A row of the postings holds a term's documents in one
block, with counts and lengths, and the few (count, length) pairs that bound its
contributions from above and from below; as pairs, they hold for any average
length that later segments bring about. What is a list of numbers is stored as bytes. Terms are spread over folders by a hash, so a
search opens only the folders of its own terms, and rows of one term lie side by
side in them.

A search shuffles what it has read by block. A task goes through its blocks and
works out scores of those only that a query needs: where the sum of the bounds reaches the k-th
best score so far, or the lower bound the lowest score (normalising needs both ends),
or a document is asked for by name.

df is kept as signed counts of each segment: what a segment adds and what it
takes away; a search adds up those of its own terms and aggregates no documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import B, K1
from corvane.functions.terms import counted_by_term, pieces
from corvane.operators import lexical
from corvane.operators.best import CELLS, ENTRIES, Best, key_type
from corvane.storage import listed, new_path, scratch, stored

#: Documents of a block, and numbers that a task can give out.
DOCS = 2048
RANGE = 1 << 24
#: Bytes of texts of a block that are counted at once.
BLOCK_BYTES = 1 << 23
#: Numbers of one segment.
SEGMENT = 1 << 44
#: Folders of the terms of a large segment; one for each so many documents, up to a power of two.
FOLDERS = 256
FOLDER_DOCS = 4096
#: A task that writes postings has the rows of a folder for 1 << SPREAD blocks.
SPREAD = 8
#: Names that are pushed down to the files as single comparisons.
PUSHED = 200

_LISTS = ("pos", "tf", "dl", "top_tf", "top_dl", "low_tf", "low_dl")
_ROW = ("term", "block", "df", "total")
_KEYS = "term string, block long, df int, total long, "
POSTINGS = _KEYS + ", ".join(f"{c} array<int>" for c in _LISTS)
#: As stored: lists as bytes, since Spark takes several times as long to shuffle and write seven lists a row.
STORED = _KEYS + "entries binary, top binary, low binary"


def numbered(rows: DataFrame) -> DataFrame:
    """The rows, all columns, in the order of their ids, with ``doc``, a number that rises with the id; ids are distinct."""
    order = rows.repartitionByRange("id").sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("doc"), *(F.col(f"`{c}`") for c in rows.columns))
    # Spark's own number: 33 bits for the place within a task
    task, place = F.shiftrightunsigned("doc", 33), F.col("doc").bitwiseAND((1 << 33) - 1)
    return order.withColumn("doc", F.when(place < RANGE, task * RANGE + place).otherwise(F.raise_error(F.lit("too many documents in one task"))))


def folders(docs: int) -> int:
    """Folders of a segment's terms."""
    n = 1
    while n < FOLDERS and n * FOLDER_DOCS < docs:
        n *= 2
    return n


def folder(term: str, n: int) -> int:
    return zlib.crc32(term.encode()) % n


def _folder(n: int):
    return F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(n)).cast("int")


def _bounds(group: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first, second) of the pairs that no other pair of their group exceeds in the one and undercuts in the other, by group; nothing is negative.

    A pair is one number, as sorting numbers takes a fraction of sorting by three columns.
    """
    if len(group) == 0:
        return group, first, second
    most, wide = int(first.max()), int(second.max()).bit_length()
    deep = most.bit_length()
    pairs = np.sort((group << deep | most - first) << wide | second)
    group, second = pairs >> (deep + wide), pairs & ((1 << wide) - 1)
    best = np.minimum.accumulate(second - (group << wide))
    keep = np.concatenate(([True], best[1:] < best[:-1]))
    return group[keep], most - (pairs[keep] >> wide & ((1 << deep) - 1)), second[keep]


def _lists(group: np.ndarray, values: np.ndarray, groups: int, missing: np.ndarray | None = None) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)), mask=None if missing is None else pa.array(missing))


def _bytes(lists: list[pa.ListArray], kind: str) -> pa.Array:
    """The lists of each row, equally long, as bytes: the first of each, the second of each; nothing where they are null."""
    sizes = pc.list_value_length(lists[0]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.stack([x.flatten().to_numpy(zero_copy_only=False) for x in lists], axis=1).astype(kind)
    offsets = np.concatenate(([0], np.cumsum(sizes))) * (len(lists) * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """``POSTINGS`` as ``STORED``: numbers of two bytes where all fit, else of four."""
    entries, top, low = ([rows.column(c) for c in names] for names in (_LISTS[:3], _LISTS[3:5], _LISTS[5:]))
    wide = max((pc.max(x.flatten()).as_py() or 0 for x in entries), default=0) >= 1 << 16
    columns = [*(rows.column(c) for c in _ROW), _bytes(entries, "<i4" if wide else "<u2"), _bytes(top, "<i4"), _bytes(low, "<i4")]
    return pa.RecordBatch.from_arrays(columns, names=[*_ROW, "entries", "top", "low"])


def _raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and how many each row has."""
    whole = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    ends = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    return np.frombuffer(b"" if data is None else data, dtype=np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _unpacked(rows: pa.Table) -> pa.Table:
    """``STORED`` rows, at least one, as ``POSTINGS``, all with bounds."""
    df = rows.column("df").to_numpy().astype(np.int64)
    raw, sizes = _raw(rows.column("entries"))
    if (sizes == 6 * df).all():
        entries = raw.view("<u2").reshape(-1, 3)
    else:
        # few blocks hold numbers of both sizes
        ends = np.cumsum(sizes)
        entries = np.concatenate([raw[e - s : e].view("<u2" if s == 6 * n else "<i4").astype(np.int64).reshape(-1, 3) for e, s, n in zip(ends.tolist(), sizes.tolist(), df.tolist(), strict=True)])
    group = np.repeat(np.arange(len(df)), df)
    columns = [rows.column(c) for c in _ROW] + [_lists(group, entries[:, i], len(df)) for i in range(3)]
    single = df == 1
    for end in ("top", "low"):
        raw, sizes = _raw(rows.column(end))
        of = np.repeat(np.arange(len(df)), np.where(single, 1, sizes // 8))
        pairs = np.empty((len(of), 2), dtype=np.int64)
        pairs[single[of]] = entries[single[group], 1:]
        pairs[~single[of]] = raw.view("<i4").reshape(-1, 2)
        columns += [_lists(of, pairs[:, i], len(df)) for i in range(2)]
    return pa.table(columns, names=[*_ROW, *_LISTS])


def posting_rows(docs: DataFrame, packed: bool = False) -> DataFrame:
    """(doc, surface) to ``POSTINGS``, or to ``STORED``; a block that several batches or pieces share gives as many rows a term. Rows of one document have no bounds."""

    def run(batches):
        # a block at a time, so that no array grows with Spark's batches
        for batch in (part for whole in batches for part in pieces(whole, align=whole.column(0).to_numpy(zero_copy_only=False) // DOCS, limit=BLOCK_BYTES)):
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            if (doc[1:] < doc[:-1]).any():
                batch = batch.take(pa.array(np.argsort(doc)))
                doc = batch.column(0).to_numpy(zero_copy_only=False)
            code, row, tf, lengths, terms = counted_by_term(batch.column(1))
            if len(row) == 0:
                continue
            opens = np.concatenate(([True], code[1:] != code[:-1]))
            group, n, at = np.cumsum(opens) - 1, int(opens.sum()), np.flatnonzero(opens)
            block = np.full(n, doc[0] // DOCS)
            # lengths by their places among those of the piece
            known, place = np.unique(lengths, return_inverse=True)
            dl, most = place[row], int(tf.max())
            df, total = np.diff(np.append(at, len(code))), np.add.reduceat(tf, at)
            lists = [_lists(group, x, n) for x in ((doc % DOCS)[row], tf, known[dl])]
            # a single document is its own bound, and half the rows have one
            single = df == 1
            several = np.flatnonzero(~single[group])
            of, high, low = group[several], tf[several], dl[several]
            high, low = _bounds(of, high, low), _bounds(of, most - high, len(known) - 1 - low)
            ends = [_lists(of, x, n, single) for of, *pair in ((high[0], high[1], known[high[2]]), (low[0], most - low[1], known[len(known) - 1 - low[2]])) for x in pair]
            for start in range(0, n, 1 << 15):
                stop = min(n, start + (1 << 15))
                cut = slice(start, stop)
                columns = [terms.take(pa.array(code[at[cut]])), pa.array(block[cut]), pa.array(df[cut].astype(np.int32)), pa.array(total[cut].astype(np.int64)), *(x.slice(start, stop - start) for x in (*lists, *ends))]
                found = pa.RecordBatch.from_arrays(columns, names=[*_ROW, *_LISTS])
                yield _packed(found) if packed else found

    return docs.select("doc", F.lower(F.coalesce("surface", F.lit("")))).mapInArrow(run, STORED if packed else POSTINGS)


def write_postings(docs: DataFrame, path: str, n: int) -> None:
    """The postings of (doc, surface) in ``n`` folders, rows of a term side by side."""
    rows = posting_rows(docs, packed=True).withColumn("folder", _folder(n))
    # dealt by a hash, as ranges would have all texts counted twice; of many blocks, a folder's rows go to several tasks
    dealt = rows.coalesce(1) if n == 1 else rows.repartition("folder", F.shiftright("block", SPREAD))
    small_pages(dealt.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder")).option("parquet.enable.dictionary#entries", "false").parquet(path)


def write_frequencies(counts: DataFrame, path: str, n: int) -> None:
    """The sums of signed counts (term, df) in ``n`` folders."""
    sums = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("folder", _folder(n))
    dealt = sums.coalesce(1) if n == 1 else sums.repartition("folder")
    small_pages(dealt.sortWithinPartitions("folder", "term").write.partitionBy("folder")).parquet(path)


def write_terms(rows: DataFrame, path: str, size: int, counts: DataFrame | None = None) -> tuple[Segment, int]:
    """Postings and frequencies of ``size`` documents (doc, surface) under ``path``, and the sum of their lengths.

    counts: signed (term, df) that replace those of the documents.
    """
    spark, n = rows.sparkSession, folders(size)
    write_postings(rows, f"{path}/postings", n)
    found = read(spark, [f"{path}/postings"], STORED)
    write_frequencies(found.select("term", "df") if counts is None else counts, f"{path}/terms", n)
    return Segment.of_folder(spark, path, n), found.agg(F.coalesce(F.sum("total"), F.lit(0))).head()[0]


def small_pages(writer, rows: int = 256):
    """Pages of so few rows that a look-up reads little."""
    return writer.option("parquet.page.size", str(1 << 16)).option("parquet.page.row.count.limit", str(rows))


@dataclass(frozen=True)
class Segment:
    """What a search needs to know of a segment: its folder, and which folders of terms it has of either kind."""

    path: str
    folders: int
    postings: tuple[int, ...]
    terms: tuple[int, ...]

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    def of(self, kind: str, terms: list[str]) -> list[str]:
        """The folders in which the terms are."""
        wanted = {folder(t, self.folders) for t in terms} & set(self.postings if kind == "postings" else self.terms)
        return [f"{self.path}/{kind}/folder={f}" for f in sorted(wanted)]

    @classmethod
    def of_folder(cls, spark: SparkSession, path: str, n: int) -> Segment:
        have = [tuple(sorted(int(x.split("=")[1]) for x in listed(spark, f"{path}/{kind}") if x.startswith("folder="))) for kind in ("postings", "terms")]
        return cls(path, n, *have)


def _terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """As a table; of a Python list Spark would make it in Python workers, which then stay beside those of the search."""
    return F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())})))


def named(terms: list[str]):
    """A condition on ``term`` that reaches the files where there are few."""
    if len(terms) <= PUSHED:
        return reduce(lambda a, b: a | b, [F.col("term") == t for t in terms])
    return None


@dataclass(frozen=True)
class PostingIndex:
    """Segments with the number of their live documents and the sum of their lengths.

    docs: (segment, doc, id) of all documents; dead: (segment, doc) of those that
    no longer count, None where there are none.
    """

    spark: SparkSession
    segments: tuple[Segment, ...]
    docs: DataFrame
    n: int
    length: int
    dead: DataFrame | None = None
    id_type: str = field(default="string")

    @classmethod
    def build(cls, surfaces: DataFrame, keep: bool = True) -> PostingIndex:
        """One segment of (id, surface), written to the shared folder; without ``keep`` the surfaces, as of a stored table, are made twice instead of being written first."""
        spark = surfaces.sparkSession
        path = new_path(spark, "postings")
        with scratch(spark):
            # dealing rows out by ranges of ids goes through them twice
            rows = surfaces.select("id", "surface")
            numbered(stored(rows, "surfaces") if keep else rows).write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        size = rows.count()
        segment, length = write_terms(rows, path, size)
        return cls(spark, (segment,), rows.select(F.lit(segment.name).alias("segment"), "doc", "id"), size, length, None, surfaces.schema["id"].dataType.simpleString())

    def best(self, queries: DataFrame, k: int, keep: DataFrame | None = None, slack: float = 0.0) -> DataFrame:
        return best(self, queries, k, keep, slack)

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """df of the terms that some live document holds."""
        paths = [p for s in self.segments for p in s.of("terms", terms)]
        if not paths:
            return {}
        rows, few = self.spark.read.schema("term string, df long").parquet(*paths), named(terms)
        rows = rows.where(few) if few is not None else rows.join(_terms(self.spark, terms), "term", "left_semi")
        out: dict[str, int] = {}
        # segments x terms rows
        for r in rows.select("term", "df").collect():
            out[r["term"]] = out.get(r["term"], 0) + r["df"]
        return {t: df for t, df in out.items() if df > 0}

    def postings(self, terms: list[str]) -> DataFrame | None:
        """The posting rows of the terms as ``STORED``, with ``segment``."""
        paths = [p for s in self.segments for p in s.of("postings", terms)]
        if not paths:
            return None
        rows, few = self.spark.read.schema(STORED).parquet(*paths), named(terms)
        rows = rows.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/postings/", 1))
        return rows.where(few) if few is not None else rows.join(_terms(self.spark, terms), "term", "left_semi")


def read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


@dataclass
class _Group:
    """The posting rows of one block."""

    segment: str
    block: int
    rows: pa.RecordBatch | pa.Table


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[_Group]:
    """Rows sorted by (segment, block) in groups; a group may lie in several batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        names, blocks = batch.column("segment"), batch.column("block").to_numpy(zero_copy_only=False)
        codes = names.dictionary_encode()
        code = codes.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(code) != 0)) + 1
        for start, stop in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(blocks)])), strict=True):
            if stop == start:
                continue
            own = (codes.dictionary[int(code[start])].as_py(), int(blocks[start]))
            if own != key and held:
                yield _Group(*key, pa.Table.from_batches(held).combine_chunks())
                held = []
            key = own
            held.append(batch.slice(int(start), int(stop - start)))
    if held:
        yield _Group(*key, pa.Table.from_batches(held).combine_chunks())


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    column = rows.column(name).combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(rows: pa.Table, name: str) -> np.ndarray:
    return pc.list_value_length(rows.column(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def _weights(known, term: np.ndarray, tf: np.ndarray, dl: np.ndarray, k1: float, b: float) -> np.ndarray:
    tf = tf.astype(np.float64)
    return known.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl.astype(np.float64) / known.avgdl))


class _Scorer:
    """Goes through the blocks of one segment for the queries of a broadcast."""

    def __init__(self, known, k: int, slack: np.ndarray, k1: float, b: float, low: np.ndarray, high: np.ndarray):
        self.known, self.k1, self.b, self.low, self.high = known, k1, b, low, high
        self.slack = slack
        self.best = Best(len(known.ids), k, pa.int64(), slack)
        self.extra: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.blocks = self.scored = 0

    def add(self, group: _Group, dead: np.ndarray, first: int) -> None:
        known, rows = self.known, group.rows
        term = pc.index_in(rows.column("term"), value_set=known.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        self.blocks += 1
        # bounds of each row, and of each query that has its term
        ends = []
        for end, pick in (("top", np.maximum), ("low", np.minimum)):
            n = _sizes(rows, f"{end}_tf")
            w = _weights(known, np.repeat(term, n), _flat(rows, f"{end}_tf"), _flat(rows, f"{end}_dl"), self.k1, self.b)
            ends.append(pick.reduceat(w, np.cumsum(n) - n))
        degree, where = lexical._ranges(known.start, term)
        of, row = known.queries[where], np.repeat(np.arange(len(term)), degree)
        most = np.bincount(of, weights=ends[0][row], minlength=len(known.ids))
        least = np.full(len(known.ids), np.inf)
        np.minimum.at(least, of, ends[1][row])
        touched = most > 0
        # rounding may lift a score by half a step
        needed = touched & ((most + 1e-6 >= self.best.cut - self.slack) | (least < self.low))
        kept = self._kept(first)
        if kept is not None:
            needed[kept[0]] |= touched[kept[0]]
        if not needed.any():
            return
        self.scored += 1
        queries = np.flatnonzero(needed)
        place = np.full(len(known.ids), -1)
        place[queries] = np.arange(len(queries))
        pos, tf, dl = _flat(rows, "pos"), _flat(rows, "tf"), _flat(rows, "dl")
        sizes = _sizes(rows, "pos")
        start = np.cumsum(sizes) - sizes
        weight = _weights(known, np.repeat(term, sizes), tf, dl, self.k1, self.b)
        use = place[of] >= 0
        of, row = place[of[use]], row[use]
        # queries in parts, by their cells and by the postings of their terms
        order = np.argsort(of, kind="stable")
        of, row = of[order], row[order]
        n = sizes[row]
        entries = np.cumsum(np.bincount(of, weights=n, minlength=len(queries)).astype(np.int64))
        begin = 0
        while begin < len(queries):
            done = int(entries[begin - 1]) if begin else 0
            end = max(begin + 1, min(len(queries), begin + max(1, CELLS // DOCS), int(np.searchsorted(entries, done + ENTRIES, "right"))))
            a, b = np.searchsorted(of, [begin, end])
            own, some = n[a:b], row[a:b]
            flat = np.repeat(start[some] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            cell = np.repeat(of[a:b] - begin, own) * DOCS + pos[flat]
            scores = np.bincount(cell, weights=weight[flat], minlength=(end - begin) * DOCS).reshape(end - begin, DOCS)
            scores = np.where(scores > 0, np.round(scores, 6), -np.inf)
            scores[:, dead] = -np.inf
            self._take(queries[begin:end], scores, first, kept)
            begin = end

    def _kept(self, first: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(query, number) of the documents in the block that are asked for by name."""
        keys = self.known.kept_keys
        a, b = np.searchsorted(keys, first), np.searchsorted(keys, first + DOCS)
        if a == b:
            return None
        size, where = lexical._ranges(self.known.kept_start, np.arange(a, b))
        return self.known.kept_queries[where], np.repeat(keys[a:b], size)

    def _take(self, queries: np.ndarray, scores: np.ndarray, first: int, kept) -> None:
        n = len(self.known.ids)
        self.high[queries] = np.maximum(self.high[queries], scores.max(axis=1))
        self.low[queries] = np.minimum(self.low[queries], np.where(scores > -np.inf, scores, np.inf).min(axis=1))
        if kept is not None:
            q, key = kept
            inside = (key >= first) & (key < first + scores.shape[1])
            q, key = q[inside], key[inside]
            at = np.searchsorted(queries, q)
            found = scores[np.minimum(at, len(queries) - 1), key - first]
            match = (at < len(queries)) & (queries[np.minimum(at, len(queries) - 1)] == q) & (found > -np.inf)
            self.extra.append((q[match], found[match], key[match]))
            scores[at[match], key[match] - first] = -np.inf
        r, c = np.nonzero(scores >= (self.best.cut - self.slack)[queries][:, None])
        finite = scores[r, c] > -np.inf
        r, c = r[finite], c[finite]
        if n and len(r):
            self.best.add_pairs(queries[r], scores[r, c], pa.array(first + c))


@dataclass(frozen=True)
class _Known:
    """The queries of one broadcast, as ``lexical._Block``, and the documents to be scored by name."""

    ids: pa.Array
    vocabulary: pa.Array
    idf: np.ndarray
    start: np.ndarray
    queries: np.ndarray
    avgdl: float
    segments: tuple[str, ...]
    kept_keys: np.ndarray
    kept_start: np.ndarray
    kept_queries: np.ndarray


def _blocks(index: PostingIndex, queries: DataFrame, keep: DataFrame | None) -> Iterator[tuple[list[str], Broadcast]]:
    """Queries in parts of bounded terms and kept rows."""
    spark = queries.sparkSession
    names = tuple(s.name for s in index.segments)
    if index.n == 0 or index.length == 0:
        return
    for rows, also in lexical.asked(queries, keep):
        found = index.frequencies(sorted({t for _, t in rows}))
        rows = [r for r in rows if r[1] in found]
        if not rows:
            continue
        ids = sorted({q for q, _ in rows})
        number = {x: i for i, x in enumerate(ids)}
        vocabulary, start, of = lexical._grouped([t for _, t in rows], [number[q] for q, _ in rows], pa.string())
        df = np.array([found[t] for t in vocabulary.to_pylist()], dtype=np.float64)
        also = [r for r in also if r["query_id"] in number]
        keys, kept_start, kept_of = lexical._grouped([names.index(r["segment"]) * SEGMENT + r["doc"] for r in also], [number[r["query_id"]] for r in also], pa.int64())
        idf = np.log(1 + (index.n - df + 0.5) / (df + 0.5))
        known = _Known(pa.array(ids, key_type(queries, "query_id")), vocabulary, idf, start, of, index.length / index.n, names, keys.to_numpy(zero_copy_only=False), kept_start, kept_of)
        yield vocabulary.to_pylist(), spark.sparkContext.broadcast(known)


def _dead_rows(dead: DataFrame) -> DataFrame:
    """As posting rows without a term: they come with their block."""
    rows = dead.select("segment", F.floor(F.col("doc") / DOCS).cast("long").alias("block"), F.array((F.col("doc") % DOCS).cast("int")).alias("pos"))
    return rows.groupBy("segment", "block").agg(F.flatten(F.collect_list("pos")).alias("pos"))


_FOUND = "query_id {}, segment string, doc long, score double, low double, high double, blocks long, scored long"


def found(index: PostingIndex, queries: DataFrame, k: int, keep: DataFrame | None = None, slack: float = 0.0, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, segment, doc, score) of what may be among each query's k best and of ``keep`` (query_id, segment, doc).

    In rows without a document: ``low`` and ``high`` over a task's matches of a
    query; in rows without a query: blocks met and blocks scored.
    """
    spark = queries.sparkSession
    schema = _FOUND.format(queries.schema["query_id"].dataType.simpleString())
    out: DataFrame | None = None
    for terms, block in _blocks(index, queries, keep):
        rows = index.postings(terms)
        if rows is None:
            continue
        if index.dead is not None:
            rows = rows.unionByName(_dead_rows(index.dead), allowMissingColumns=True)
        # the rows of a block meet; the dead come first
        rows = rows.repartition("segment", "block").sortWithinPartitions("segment", "block", "term")

        def run(batches, block=block):
            known: _Known = block.value
            n = len(known.ids)
            low, high = np.full(n, np.inf), np.full(n, -np.inf)
            most = np.bincount(known.queries, weights=np.repeat(known.idf, np.diff(known.start)), minlength=n)
            scorer, own = None, None
            met = scored = 0

            def results(scorer: _Scorer, name: str):
                for q, s, key in [scorer.best.rows(), *((q, s, pa.array(key)) for q, s, key in scorer.extra)]:
                    doc = pc.subtract(key.cast(pa.int64()), known.segments.index(name) * SEGMENT)
                    yield _result(query_id=known.ids.take(pa.array(q)), segment=pa.array([name] * len(q), pa.string()), doc=doc, score=pa.array(s))

            for group in _groups(batches):
                if group.segment != own:
                    if scorer is not None:
                        yield from results(scorer, own)
                        met, scored = met + scorer.blocks, scored + scorer.scored
                    own, scorer = group.segment, _Scorer(known, k, most * (1 + k1) * slack, k1, b, low, high)
                has = group.rows.column("term").is_valid()
                gone = group.rows.filter(pc.invert(has))
                dead = _flat(gone, "pos") if gone.num_rows else np.zeros(0, dtype=np.int64)
                live = group.rows.filter(has)
                if live.num_rows:
                    scorer.add(_Group(group.segment, group.block, _unpacked(live)), dead, known.segments.index(own) * SEGMENT + group.block * DOCS)
            if scorer is not None:
                yield from results(scorer, own)
                met, scored = met + scorer.blocks, scored + scorer.scored
            seen = np.flatnonzero(high > -np.inf)
            yield _result(query_id=known.ids.take(pa.array(seen)), low=pa.array(low[seen]), high=pa.array(high[seen]))
            yield _result(query_id=pa.nulls(1, known.ids.type), blocks=pa.array([met]), scored=pa.array([scored]))

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def _result(**columns: pa.Array) -> pa.RecordBatch:
    size = len(columns["query_id"])
    kinds = {"query_id": columns["query_id"].type, "segment": pa.string(), "doc": pa.int64(), "score": pa.float64(), "low": pa.float64(), "high": pa.float64(), "blocks": pa.int64(), "scored": pa.int64()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)).cast(t) for c, t in kinds.items()], names=list(kinds))


def best(index: PostingIndex, queries: DataFrame, k: int, keep: DataFrame | None = None, slack: float = 0.0, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, low, high), as ``lexical.best``; keep: (query_id, id)."""
    if keep is not None:
        keep = stored(index.docs.join(keep.select("query_id", "id"), "id").select("query_id", "segment", "doc"), "kept")
    rows = stored(found(index, queries, k, keep, slack, k1, b), "best")
    limits = rows.where("low IS NOT NULL").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # tasks x segments x queries x k rows meet the ids
    own = rows.where("doc IS NOT NULL").select("query_id", "segment", "doc", "score")
    return index.docs.join(own, ["segment", "doc"]).select("query_id", "id", "score").join(limits, "query_id")
