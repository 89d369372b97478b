"""Vectors as short codes: product quantisation with partial-distance search.

Each component becomes the integer floor(4096 x); a vector is cut into equal
consecutive parts, each with a codebook of its own. An entry is looked for by
partial distances: dimensions are gone through by descending variance of the
codebook's entries, and of all rows of a batch at once those stay under a mask
whose accumulated integer distance does not strictly exceed the best complete
one. Equal distances stay in, so ties go to the lower entry, exactly.

A round is one scan of the stored integers: each task adds up its own parts,
one row for each entry, so what meets is tasks x entries rows whatever the
input; codebooks are the only thing that is broadcast, entries x dimension
numbers.

Defined results: a vector that is null or holds null or non-finite components is
dropped; a table without vectors gives no rows; fewer than ``ENTRIES`` distinct
ids give as many entries; of an id that occurs with several vectors the least
one seeds an entry; rows with a null id are coded and seed nothing, without any
id there are no entries and ``ValueError`` is raised; repeated rows are coded
and counted each. Vectors of several dimensions, a dimension that the parts do
not divide, and components so large that a squared distance could pass 64 bits
raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrow import record
from corvane.storage import stored, table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Rows gone through at once.
ROWS = 8192
#: Copies of each label's sum, over which rows of a frequent label are dealt.
SALTS = 16


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry and the squared distance of each column of ``x`` (dimensions x rows); book: entries x dimensions, both int64."""
    n = x.shape[1]
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[order], book[:, order]
    index, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if len(order) == 0 or n == 0:
        return index, best
    # what is nearest in the first dimension gives the first complete distance
    rank = np.argsort(book[:, 0], kind="stable")
    line = book[rank, 0]
    right = np.minimum(np.searchsorted(line, x[0]), len(line) - 1)
    left = np.maximum(right - 1, 0)
    index = rank[np.where(np.abs(x[0] - line[left]) <= np.abs(line[right] - x[0]), left, right)]
    for d in range(len(order)):
        best += (x[d] - book[index, d]) ** 2
    for e in range(len(book)):
        total = (x[0] - book[e, 0]) ** 2
        alive = np.flatnonzero(total <= best)
        total = total[alive]
        for d in range(1, len(order)):
            if len(alive) == 0:
                break
            total += (x[d, alive] - book[e, d]) ** 2
            stays = total <= best[alive]
            if not stays.all():
                alive, total = alive[stays], total[stays]
        wins = (total < best[alive]) | (e < index[alive])
        index[alive[wins]], best[alive[wins]] = e, total[wins]
    return index, best


def _matrix(column: pa.Array) -> np.ndarray:
    """dimensions x rows."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).T)


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, parts) of the usable vectors; ``parts`` holds floor(scale x)."""
    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        for batch in _slices(batches):
            column = batch.column(2)
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(owner[~np.isfinite(x)], minlength=len(sizes)) > 0
            good = column.is_valid().to_numpy(zero_copy_only=False) & ~bad
            x = x[good[owner]]
            if len(x) and np.abs(x).max() * scale >= 2.0**62:
                raise ValueError("components are too large for 64 bits")
            offsets = np.concatenate(([0], np.cumsum(sizes[good]))).astype(np.int32)
            values = pa.array(np.floor(x * scale).astype(np.int64))
            rows = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["vec_id", "label", "parts"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, parts array<long>")


@dataclass(frozen=True)
class Codebooks:
    """parts x entries x dimensions of a part, int64."""

    entries: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts x rows) entries, and squared distances; x: dimensions x rows."""
        width = self.entries.shape[2]
        found = [nearest(x[p * width : (p + 1) * width], book) for p, book in enumerate(self.entries)]
        return np.stack([i for i, _ in found]), np.stack([d for _, d in found])


def _dimension(rows: DataFrame, parts: int) -> int:
    """Of the table's vectors; 0 where it has none."""
    size, value = F.size("parts"), F.greatest(F.abs(F.array_max("parts")), F.abs(F.array_min("parts")))
    low, high, most = rows.agg(F.min(size), F.max(size), F.max(value)).head()
    if low is None:
        return 0
    if low != high:
        raise ValueError(f"vectors have dimensions from {low} to {high}")
    if low % parts:
        raise ValueError(f"{parts} parts do not divide the dimension {low}")
    if low * (2 * (most or 0)) ** 2 >= 2**63:
        raise ValueError("components are too large for 64 bits")
    return low


def seeds(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the least ids."""
    ids = [r[0] for r in rows.select("vec_id").where("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        raise ValueError("no vector has an id")
    # at most ``entries`` rows
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("parts").alias("parts")).orderBy("vec_id").collect()
    cut = np.array([r["parts"] for r in first], dtype=np.int64)
    return Codebooks(cut.reshape(len(first), parts, -1).transpose(1, 0, 2).copy())


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of the parts nearest to it; unused ones stay."""
    known = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = known.value
        parts, entries, width = own.entries.shape
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in _slices(batches):
            x = _matrix(batch.column(0))
            index, _ = own.codes(x)
            for p in range(parts):
                order = np.argsort(index[p], kind="stable")
                n = np.bincount(index[p], minlength=entries)
                used, starts = np.flatnonzero(n), (np.cumsum(n) - n)[n > 0]
                counts[p] += n
                sums[p, used] += np.add.reduceat(x[p * width : (p + 1) * width, order], starts, axis=1).T
        p, e = np.nonzero(counts)
        yield record(part=(p, pa.int32()), entry=(e, pa.int32()), n=(counts[p, e], pa.int64()), sums=(sums[p, e].tolist(), pa.list_(pa.int64())))

    each = rows.select("parts").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    # entries x dimension rows in all
    added = each.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = books.entries.copy()
    for r in added:
        out[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    known.unpersist()
    return Codebooks(out)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``integers``; rows should be stored, as each round reads them."""
    books = seeds(rows, parts, entries)
    for _ in range(rounds):
        books = improved(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code binary, error): an entry's number for each part in one byte, and the squared distance from what the code stands for."""
    known = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in _slices(batches):
            index, distance = known.value.codes(_matrix(batch.column(2)))
            codes = np.ascontiguousarray(index.T.astype(np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(distance.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select("vec_id", "label").schema]
    return rows.mapInArrow(run, f"{', '.join(kinds)}, code binary, error long")


def decoded(code: bytes, books: Codebooks, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middle of each component's interval."""
    return (np.concatenate([books.entries[p, c] for p, c in enumerate(code)]) + 0.5) / scale


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the errors of all rows of equal label, nulls together.

    A label's sum is one row, and rows of one label are dealt over ``SALTS``
    copies of it, so that a frequent label is no single task's; Spark broadcasts the
    sums where their stored size is small.
    """
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    salted = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col("salt") == F.col("copy")) & F.col("label").eqNullSafe(F.col("of"))).drop("salt", "copy", "of")


SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(integers(table(spark, sf_dir, "embeddings")), "integers")
    if _dimension(rows, PARTS) == 0:
        return spark.createDataFrame([], SCHEMA)
    books = fit(rows)
    coded = with_label_error(stored(encode(rows, books), "codes"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after the other; a distance and its entry are one number, so that ties go to the lower entry."""
    distance = f"min(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT * {ENTRIES} + entry)"
    ctes = [
        f"whole AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, label, p, w[p * (len(w) // {PARTS}) + 1:(p + 1) * (len(w) // {PARTS})] AS v FROM whole, (SELECT unnest(range({PARTS})) AS p))",
        f"book0 AS MATERIALIZED (SELECT p, entry, v AS c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole QUALIFY entry < {ENTRIES}) USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"near{r} AS MATERIALIZED (SELECT vec_id, label, p, v, {distance} AS m FROM cut JOIN book{r} USING (p) GROUP BY ALL)")
        if r < ROUNDS:
            floor = "(s - ((s % n) + n) % n) // n"
            ctes.append(f"sums{r} AS MATERIALIZED (SELECT p, entry, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT p, m % {ENTRIES} AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r}) GROUP BY ALL)")
            ctes.append(f"book{r + 1} AS MATERIALIZED (SELECT p, entry, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN (SELECT p, entry, list({floor} ORDER BY i) AS c FROM sums{r} GROUP BY ALL) n USING (p, entry))")
    coded = f"SELECT vec_id, label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY ALL"
    digest = f"SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, entry, i)) FROM (SELECT p, entry, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM book{ROUNDS})"
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, ({digest}) AS codebooks_sha256 FROM ({coded})"


ORACLE = _oracle()
