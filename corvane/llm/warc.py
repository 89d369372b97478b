r"""WARC archives with revisit records and a globally ordered index.

Writing: rows are grouped by the SHA-256 of their payload; of equal payloads of
``REVISIT_BYTES`` or more, the row with the smallest id is the response and the
others are revisit records without a body that name it. Records are gzip
members, laid into segments of about ``SEGMENT_BYTES``; a segment is a whole
WARC file in a row of a Parquet table in the shared folder, so commits,
retries and stores are Spark's business (``export`` writes the files).

Reading: each segment is walked record by record, bodies are digested anew and
compared with their headers, and the index lines of a task's segments are
merged into one sorted run.

Index: the lines are dealt into ranges of (URL key, time, id) of about
``RANGE_LINES`` lines, so a hot URL's history lies over as many ranges as it
needs; borders come from a bounded sample of all lines. Runs are cut at the
borders into blocks, blocks are ordered by range, and each range merges its k
blocks with a loser tree: lines are never sorted again, and the table in
partition order is the global capture history. A task holds one range.

Defined results: null html is an empty payload; a null URL has the empty key;
null ids sort first and cannot be referred to: rows without an id are responses;
rows repeating the smallest id with the same payload are responses too; a
table without rows gives no records.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrow import record
from corvane.storage import stored, table

REVISIT_BYTES = 100
SEGMENT_BYTES = 4 << 20
#: Lines of a block that are Python rows at once while it is merged.
BLOCK_LINES = 4096
#: Lines of a range, ranges at most (beyond, ranges are larger), and lines at most that are looked at to find the borders, 50 a range.
RANGE_LINES = 10_000
RANGES = 20_000
SAMPLED = 100_000
#: Repeated payloads whose first records are broadcast.
BROADCAST_ROWS = 500_000
#: Stored bytes that a decompressor is given at once.
SLICE = 1 << 16
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

SEGMENTS = "segment string, warc binary"
INDEX = "url_key string, captured string, page_id long, segment string, offset long, stored_bytes long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_LINE = [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("segment", pa.string()), ("offset", pa.int64()), ("stored_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, without scheme, www and fragment; path and query as they are."""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    host, _, port = host.partition(":")
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    shown = ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "")
    return f"{shown}){path or '/'}" if host else ""


def _clean(value: str) -> str:
    """A header value holds no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def warc_record(page_id: int | None, url: str, captured: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record, a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]).encode("utf-8", "replace")
    return gzip.compress(b"".join((head, b"\r\n\r\n", payload, b"\r\n\r\n")), 1, mtime=0)


def records(warc: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, stored bytes, headers, body) of each member; raises on anything else."""
    at, view = 0, memoryview(warc)
    while at < len(warc):
        member, parts, end = zlib.decompressobj(31), [], at
        # bounded slices: what a member leaves unused is copied
        while not member.eof and end < len(warc):
            parts.append(member.decompress(view[end : end + SLICE]))
            end = min(end + SLICE, len(warc))
        if not member.eof:
            raise ValueError(f"cut-off record at {at}")
        raw = b"".join(parts)
        size = end - at - len(member.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        n = int(headers["content-length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError(f"wrong length of the record at {at}")
        yield at, size, headers, rest[:n]
        at += size


def _id(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return int(value) if value else None


def run_of(segment: str, warc: bytes) -> list[tuple]:
    """The sorted index lines of a segment, in the columns of INDEX."""
    out = []
    for offset, size, headers, body in records(warc):
        kind, digest, length = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["warc-payload-length"])
        refers = _id(headers["warc-refers-to"]) if kind == "revisit" else None
        if kind == "response":
            length, found = len(body), hashlib.sha256(body).hexdigest()
            if found != digest:
                raise ValueError(f"wrong digest in {segment} at {offset}")
        out.append((url_key(headers["warc-target-uri"]), headers["warc-date"], _id(headers["warc-record-id"]), segment, offset, size, length, digest, kind, refers))
    return sorted(out, key=_order)


def _order(line: tuple) -> tuple:
    return line[0], line[1], line[2] is not None, line[2] or 0, line[3], line[4]


class LoserTree:
    """k-way merge: each inner node holds the loser of its match, the root's winner is next."""

    def __init__(self, runs: list[Iterable[tuple]], key: Callable[[tuple], tuple] = _order):
        self._runs = [iter(r) for r in runs]
        self._key = key
        self._heads: list[tuple | None] = [None] * len(self._runs)
        self._keys: list[tuple] = [()] * len(self._runs)
        for i in range(len(self._runs)):
            self._advance(i)
        self._losers = [-1] * len(self._runs)
        for i in range(len(self._runs)):
            self._play(i, building=True)

    def _advance(self, i: int) -> None:
        self._heads[i] = line = next(self._runs[i], None)
        # a run that has ended loses against any line
        self._keys[i] = (1,) if line is None else (0, *self._key(line))

    def _play(self, i: int, building: bool = False) -> None:
        k, node = len(self._runs), (i + len(self._runs)) // 2
        while node:
            other = self._losers[node]
            if building and other < 0:
                self._losers[node] = i
                return
            if (self._keys[other], other) < (self._keys[i], i):
                self._losers[node], i = i, other
            node //= 2
        if k:
            self._losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self._runs:
            i = self._losers[0]
            line = self._heads[i]
            if line is None:
                return
            yield line
            self._advance(i)
            self._play(i)


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size and refers_to (null for responses).

    Repeated payloads are found by digest alone; pages are shuffled only where
    more than BROADCAST_ROWS payloads repeat.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    first = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    first = stored(first, "warc-first")
    refers = F.when((F.col("size") >= REVISIT_BYTES) & (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return rows.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, "digest", "left").select("page_id", "url", "html", "digest", "size", refers.alias("refers_to"))


def write(pages: DataFrame) -> DataFrame:
    """Segments of a WARC archive, see SEGMENTS; stored in the shared folder."""
    # revisits carry no payload from here on
    rows = with_references(pages).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))

    def run(batches):
        held: list[bytes] = []
        size = 0
        for batch in batches:
            html = batch.column(2).cast(pa.large_binary() if pa.types.is_large_string(batch.column(2).type) else pa.binary()).to_pylist()
            for page_id, url, digest, n, refers, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), html, strict=True):
                captured = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                held.append(warc_record(page_id, url, captured, payload, digest, n, refers))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield _segment(held)
                    held, size = [], 0
        if held:
            yield _segment(held)

    return stored(rows.mapInArrow(run, SEGMENTS), "warc")


def _segment(held: list[bytes]) -> pa.RecordBatch:
    whole = b"".join(held)
    return record(segment=([hashlib.sha256(whole).hexdigest()[:32]], pa.string()), warc=([whole], pa.binary()))


def sorted_runs(segments: DataFrame) -> DataFrame:
    """The index lines with ``run``; a run's lines are in order and stand together. Stored."""

    def runs(batches):
        held = [run_of(segment, warc) for batch in batches for segment, warc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        lines = LoserTree(held)
        # the name follows from the content, so a second attempt gives the same run
        name = hashlib.sha256("".join(sorted(x[0][3] for x in held if x)).encode()).hexdigest()[:32]
        for part in _parts(lines, 8192):
            yield _lines(part, run=name)

    return stored(segments.mapInArrow(runs, f"{INDEX}, run string"), "warc-runs")


def _parts(lines: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    out: list[tuple] = []
    for line in lines:
        out.append(line)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def borders(lines: DataFrame, size: int = RANGE_LINES) -> list[tuple]:
    """Keys that part all lines into ranges of about ``size`` lines."""
    n = lines.count()
    ranges = min(RANGES, -(-n // size))
    if ranges < 2:
        return []
    columns, wanted = [c for c, _ in _LINE], min(SAMPLED, 50 * ranges)
    sample = lines if n <= wanted else lines.where(F.pmod(F.xxhash64("segment", "offset"), F.lit(n)) < wanted)
    keys = sorted(_order(tuple(r)) for r in sample.select(*columns).collect())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


BLOCKS = "range int, block binary"


def blocks(lines: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Runs cut at the borders: packed lines of one run in one range."""
    shared = lines.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        known = shared.value
        held: list[pa.RecordBatch] = []
        where: tuple[int, str] | None = None
        for batch in batches:
            names, rows = batch.column(len(_LINE)).to_pylist(), batch.select([c for c, _ in _LINE])
            places = [bisect.bisect_right(known, _order(x)) for x in zip(*(c.to_pylist() for c in rows.columns), strict=True)]
            start = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or (places[i], names[i]) != (places[start], names[start]):
                    if where is not None and where != (places[start], names[start]):
                        yield record(range=([where[0]], pa.int32()), block=([_packed(held)], pa.binary()))
                        held = []
                    where = places[start], names[start]
                    held.append(rows.slice(start, i - start))
                    start = i
        if held:
            yield record(range=([where[0]], pa.int32()), block=([_packed(held)], pa.binary()))

    return lines.select(*(c for c, _ in _LINE), "run").mapInArrow(run, BLOCKS)


def _packed(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for part in parts:
            for start in range(0, part.num_rows, BLOCK_LINES):
                out.write_batch(part.slice(start, BLOCK_LINES))
    return sink.getvalue().to_pybytes()


def _read(block: bytes) -> Iterator[tuple]:
    for part in pa.ipc.open_stream(block):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def index(segments: DataFrame, size: int = RANGE_LINES) -> DataFrame:
    """The capture history in global order of (URL key, time, id), see INDEX."""
    lines = sorted_runs(segments)
    cuts = borders(lines, size)
    cut = stored(blocks(lines, cuts), "warc-blocks")

    def merge(batches):
        held: list[bytes] = []
        current: int | None = None
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and number != current:
                    for part in _parts(LoserTree([_read(x) for x in held]), 8192):
                        yield _lines(part)
                    held = []
                current = number
                held.append(block)
        for part in _parts(LoserTree([_read(x) for x in held]), 8192):
            yield _lines(part)

    return cut.repartitionByRange(len(cuts) + 1, "range").sortWithinPartitions("range").mapInArrow(merge, INDEX)


def _lines(lines: list[tuple], run: str | None = None) -> pa.RecordBatch:
    columns = list(zip(*lines, strict=True)) if lines else [[]] * len(_LINE)
    more = {} if run is None else {"run": ([run] * len(lines), pa.string())}
    return record(**{name: (list(values), kind) for (name, kind), values in zip(_LINE, columns, strict=True)}, **more)


def fetch(segments: DataFrame, segment: str, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index line."""
    warc = bytes(segments.where(F.col("segment") == segment).head()["warc"])
    _, _, headers, body = next(records(warc[offset:]))
    return headers, body


def export(segments: DataFrame, folder: str) -> DataFrame:
    """Writes each segment as <folder>/<segment>.warc.gz through Arrow's file systems; returns the paths."""

    def run(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for segment, warc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where.create_dir(base, recursive=True)
                paths.append(f"{base}/{segment}.warc.gz")
                # the name follows from the content: a second attempt writes the same file
                with where.open_output_stream(paths[-1], compression=None) as f:
                    f.write(warc)
            yield record(path=(paths, pa.string()))

    return segments.mapInArrow(run, "path string")


def report(lines: DataFrame) -> DataFrame:
    return lines.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(index(write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, octet_length(body) AS n, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
