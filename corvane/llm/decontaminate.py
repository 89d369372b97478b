"""Benchmark decontamination: which words of a document repeat a benchmark item.

Words are runs of digits, ASCII letters (A-Z read as a-z) and all non-ASCII
characters. A window is ``width`` consecutive words of an item, or the whole
item if it has fewer words but some. A document word inside any occurrence of
a window is hit.

The item windows go to the executors as sorted 64-bit hashes with the words
they stand for. Each broadcast holds at most ``BLOCK_WINDOWS`` windows; a
larger benchmark is scanned block by block over the same documents, each block
adding its hits to a stored table, so one bounded broadcast is alive at a time and
no window is left out. Every hash hit is verified against the window's words.

Defined results: a null or empty text has no words and is clean; a null item
text has no windows; repeated items count once per ``item_id``; an item with a
null id marks words but is not listed; repeated documents give repeated rows;
without items every document is clean. The documents' own columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import wordhash
from corvane.llm.arrow import as_bytes, by_place, pieces, record
from corvane.storage import stored, table

WIDTH = 13
#: A document is contaminated if this share of its words, or more, is hit: 1 in 20.
SHARE = 20
#: Windows of one broadcast; with about 100 bytes of words each, under 60 MB.
BLOCK_WINDOWS = 500_000
#: Slots of the bitmap that is asked before the sorted hashes.
_BITMAP = 1 << 22

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_windows(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[int, int, int, bytes]]:
    """(text number, words in the window, hash, lower-cased words joined by spaces)."""
    for begin, end in wordhash.blocks(texts):
        words = wordhash.split(texts[begin:end], wordhash.NOT_ALNUM)
        low = words.data.lower()
        runs = wordhash.windows(words.hashes, width)
        for i in range(end - begin):
            a, b = int(words.bounds[i]), int(words.bounds[i + 1])
            spans = [(k, k + width) for k in range(a, b - width + 1)] if b - a >= width else [(a, b)] * (b > a)
            for p, q in spans:
                value = int(runs[p]) if q - p == width else int(wordhash.windows(words.hashes[p:q], q - p)[0])
                yield begin + i, q - p, value, b" ".join(low[x:y] for x, y in zip(words.starts[p:q], words.ends[p:q], strict=True))


class Windows:
    """A bounded set of item windows, by length."""

    def __init__(self, rows: list[tuple[int, int, bytes, str | None]]):
        """rows: (words, hash, text, item id)."""
        self.items: dict[bytes, set[str | None]] = {}
        by_size: dict[int, set[int]] = {}
        for size, value, text, item in rows:
            self.items.setdefault(text, set()).add(item)
            by_size.setdefault(size, set()).add(value)
        self.by_size = {}
        for size, values in by_size.items():
            hashes = np.array(sorted(values), dtype=np.uint64)
            bitmap = np.zeros(_BITMAP, dtype=bool)
            bitmap[hashes >> np.uint64(42)] = True
            self.by_size[size] = (np.packbits(bitmap, bitorder="little"), hashes)

    def find(self, words: wordhash.Words) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first word, words, items) of each verified occurrence, in the block's word numbers."""
        low: bytes | None = None
        for size, (bitmap, hashes) in self.by_size.items():
            runs = wordhash.windows(words.hashes, size)
            slot = (runs >> np.uint64(42)).astype(np.int64)
            maybe = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if len(maybe) == 0:
                continue
            found = np.searchsorted(hashes, runs[maybe])
            maybe = maybe[(found < len(hashes)) & (hashes[np.minimum(found, len(hashes) - 1)] == runs[maybe])]
            # a run must not cross from one text into the next
            maybe = maybe[np.searchsorted(words.bounds, maybe, "right") == np.searchsorted(words.bounds, maybe + size - 1, "right")]
            for p in maybe.tolist():
                low = words.data.lower() if low is None else low
                text = b" ".join(low[x:y] for x, y in zip(words.starts[p : p + size], words.ends[p : p + size], strict=True))
                if items := self.items.get(text):
                    yield p, size, items


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each window and item: size, hash (as a signed long), words, item_id (string)."""

    def run(batches):
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            rows = {(size, int(np.uint64(h).view(np.int64)), text, ids[i]) for i, size, h, text in item_windows(as_bytes(batch.column(1)), width)}
            rows = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or ""))
            yield record(size=([r[0] for r in rows], pa.int32()), hash=([r[1] for r in rows], pa.int64()), words=([r[2] for r in rows], pa.binary()), item_id=([r[3] for r in rows], pa.string()))

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "size int, hash long, words binary, item_id string").distinct()


def window_blocks(benchmark: DataFrame, width: int = WIDTH, limit: int = BLOCK_WINDOWS) -> Iterator[Broadcast]:
    """The windows of the benchmark in broadcasts of at most about ``limit`` windows."""
    spark = benchmark.sparkSession
    rows = stored(windows_of(benchmark, width), "windows")
    blocks = -(-rows.count() // limit)
    for k in range(blocks):
        # one block at a time; the hash deals windows out evenly
        part = rows.where(F.pmod("hash", F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(Windows([(r["size"], r["hash"] & (2**64 - 1), bytes(r["words"]), r["item_id"]) for r in part]))


def word_hits(texts: list[bytes], known: Windows) -> Iterator[tuple[int, list[tuple[int, int]], set[str | None], np.ndarray, np.ndarray]]:
    """For each text: words, merged hit ranges of words, items, byte starts and ends of its words."""
    for begin, end in wordhash.blocks(texts):
        words = wordhash.split(texts[begin:end], wordhash.NOT_ALNUM)
        by_text: dict[int, list] = {}
        for p, size, items in known.find(words):
            by_text.setdefault(int(np.searchsorted(words.bounds, p, "right")) - 1, []).append((p, p + size, items))
        at = 0
        for i in range(end - begin):
            a, b = int(words.bounds[i]), int(words.bounds[i + 1])
            ranges, items = [], set()
            for p, q, ids in sorted(by_text.get(i, ()), key=lambda x: x[:2]):
                items |= ids
                if ranges and p - a <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(ranges[-1][1], q - a))
                else:
                    ranges.append((p - a, q - a))
            yield b - a, ranges, items, words.starts[a:b] - at, words.ends[a:b] - at
            at += len(texts[begin + i]) + 1


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p, q in sorted(ranges):
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], q))
        else:
            out.append((p, q))
    return out


def added(columns: list[str]) -> tuple[str, str, str]:
    """Names of the columns that ``scan`` adds to these: words, hits and items."""
    taken, tail = {c.lower() for c in columns}, ""
    while taken & {f"__cv_{x}{tail}" for x in ("words", "hits", "items")}:
        tail += "_"
    return f"__cv_words{tail}", f"__cv_hits{tail}", f"__cv_items{tail}"


def scan(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents' columns plus those named by ``added``: number of words, hits (ranges of word numbers, last exclusive) and items."""
    n_words_, hits_, items_ = added(documents.columns)
    out = documents.withColumns({n_words_: F.lit(None).cast("long"), hits_: F.array().cast("array<struct<first:long,last:long>>"), items_: F.array().cast("array<string>")})
    spark = documents.sparkSession
    at_text, at_hits, at_items = documents.columns.index("text"), len(documents.columns) + 1, len(documents.columns) + 2
    last: Broadcast | None = None
    for block in itertools.chain(window_blocks(benchmark, width, limit), [None]):
        if block is None:
            if last is not None:
                break
            block = spark.sparkContext.broadcast(Windows([]))
        elif last is not None:
            out = stored(out, "hits")
            last.destroy()

        def run(batches, block=block):
            known = block.value
            for batch in pieces(batches):
                before = [[(x["first"], x["last"]) for x in row] for row in batch.column(at_hits).to_pylist()]
                seen = batch.column(at_items).to_pylist()
                n_words, hits, found = [], [], []
                for k, (n, ranges, items, _, _) in enumerate(word_hits(as_bytes(batch.column(at_text)), known)):
                    n_words.append(n)
                    hits.append([{"first": p, "last": q} for p, q in (merged(before[k] + ranges) if before[k] else ranges)])
                    found.append(sorted({*seen[k], *(x for x in items if x is not None)}))
                new = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: at_hits - 1], *new], names=batch.schema.names)

        out, last = by_place(out, run), block
    return out


def _n_hit(hits: str) -> F.Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"])


def report(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """A row for each document, see SCHEMA."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_words, hits, items = added(rows.columns)
    found = scan(rows, benchmark, width)
    return found.select("doc_id", F.col(n_words).alias("n_words"), _n_hit(hits).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """The documents' own columns without contaminated documents (``remove="documents"``).

    With ``remove="spans"`` every row stays and the hit words go from its text,
    with what stands between the words of one hit range.
    """
    columns = documents.columns
    n_words, hits, _ = added(columns)
    found = scan(documents, benchmark, width)
    if remove == "documents":
        return found.where(~((_n_hit(hits) > 0) & (share * _n_hit(hits) >= F.col(n_words)))).select(*(F.col("`" + c.replace("`", "``") + "`") for c in columns))
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    at, at_hits = columns.index("text"), len(columns) + 1

    def cut(batches):
        for batch in pieces(batches):
            texts = batch.column(at).to_pylist()
            for i, ranges in enumerate(batch.column(at_hits).to_pylist()):
                if ranges:
                    raw = texts[i].encode()
                    words = wordhash.split([raw], wordhash.NOT_ALNUM)
                    kept, last = [], 0
                    for r in ranges:
                        kept.append(raw[last : words.starts[r["first"]]])
                        last = int(words.ends[r["last"] - 1])
                    texts[i] = b"".join([*kept, raw[last:]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(columns))], names=columns)

    return by_place(found, cut, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: The same report in SQL, for small tables.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM d, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) AS u(i)),
h AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (size, words)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
